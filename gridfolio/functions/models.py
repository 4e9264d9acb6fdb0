"""Calls of injected models: retries with a delay, and progress of a plan."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Headers that name a delay, the shortest delay, and what is added to one that a service asks for.
DELAY_HEADERS = ["retry-after", "x-ratelimit-reset-requests"]
LEAST_DELAY, MARGIN = 1.5, 0.5


def retry_delay(attempt: int, headers: Mapping[str, str] | None = None, body: str = "", most: float = 60.0) -> float:
    """Seconds before the next attempt: what the service says, else twice as long each time."""
    said = [(headers or {}).get(name, "") for name in DELAY_HEADERS]
    said += re.findall(r"try again in ([\d.]+)s", body, re.I)
    for value in said:
        try:
            return max(LEAST_DELAY, float(value.rstrip("s")) + MARGIN)
        except ValueError:
            continue
    return min(most, LEAST_DELAY * 2 ** max(0, attempt - 1))


def with_retries(call: Callable, attempts: int = 3, wait: Callable[[float], None] = time.sleep) -> Callable:
    """``call`` repeated after errors; an error may carry ``headers`` and ``body`` that name the delay. The last one is raised."""

    def run(*args, **kwargs):
        for attempt in range(1, attempts + 1):
            try:
                return call(*args, **kwargs)
            except Exception as e:
                if attempt == attempts:
                    raise
                wait(retry_delay(attempt, getattr(e, "headers", None), getattr(e, "body", "") or str(e)))

    return run


def observed(df: DataFrame, stage: str, report: Callable[[str, dict], None], **metrics: Column) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` with counters that Spark collects while an action runs, and a function that reports them afterwards.

    The counters are rows, and any further aggregates that are given by name.
    """
    own = Observation(stage)
    watched = df.observe(own, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in metrics.items()])
    return watched, lambda: report(stage, dict(own.get))

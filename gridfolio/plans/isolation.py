"""Parts of an answer as jobs of their own: one that fails or takes too long costs no other."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

from gridfolio.session import written

#: Seconds that a part may take, and that a cancelled one is waited for.
DEADLINE, GRACE = 60.0, 5.0


def run(spark: SparkSession, parts: dict[str, Callable[[], DataFrame | None]], deadline: float = DEADLINE) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """The results of the parts that ended well, each written, and what went wrong in the others.

    A part is planned and run in a thread of its own under a tag of its own, all at once. Its result is written to the shared folder, so
    that no reader of it meets the part's failures again: give parts whose results are bounded. A part that isn't done by the deadline
    is cancelled by its tag, with its tasks. A part that gives None has no result and no failure.
    """
    context = spark.sparkContext
    done: dict[str, DataFrame] = {}
    failed: dict[str, str] = {}

    def work(name: str, tag: str, make: Callable[[], DataFrame | None]) -> None:
        context.addJobTag(tag)
        context.setInterruptOnCancel(True)
        try:
            found = make()
            if found is not None:
                found = written(found, "part")
                if name not in failed:
                    done[name] = found
        except Exception as e:
            failed.setdefault(name, f"{type(e).__name__}: {str(e).strip().splitlines()[0] if str(e).strip() else ''}")
        finally:
            context.removeJobTag(tag)

    ends = time.monotonic() + deadline
    threads = {}
    for name, make in parts.items():
        tag = f"part-{uuid.uuid4().hex}"
        threads[name] = (InheritableThread(target=work, args=(name, tag, make), daemon=True), tag)
    for thread, _ in threads.values():
        thread.start()
    for name, (thread, tag) in threads.items():
        thread.join(max(0.0, ends - time.monotonic()))
        if thread.is_alive():
            failed.setdefault(name, f"not done in {deadline:g} seconds")
            context.cancelJobsWithTag(tag)
    late = time.monotonic() + GRACE
    for thread, _ in threads.values():
        thread.join(max(0.0, late - time.monotonic()))
    return {n: done[n] for n in parts if n in done and n not in failed}, {n: failed[n] for n in parts if n in failed}

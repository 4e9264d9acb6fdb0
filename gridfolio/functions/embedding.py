"""A deterministic embedder for work without a model: hashed words as a unit vector, in built-in functions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfolio.functions import numeric, text

DIMENSIONS = 64


def hashed(column: Column, dimensions: int = DIMENSIONS) -> Column:
    """Each word adds +1 or -1 to one dimension by its hash; the sum is scaled to length 1. A text without words has zeros."""
    words = F.filter(F.split(text.label(column), " "), lambda w: w != "")
    place = lambda w: F.pmod(F.xxhash64(w), F.lit(dimensions))
    sign = lambda w: F.when(F.pmod(F.shiftright(F.xxhash64(w), 20), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    raw = F.transform(
        F.sequence(F.lit(0), F.lit(dimensions - 1)),
        lambda d: F.aggregate(words, F.lit(0.0), lambda acc, w: acc + F.when(place(w) == d, sign(w)).otherwise(0.0)),
    )
    return _unit(raw)


def _unit(vector: Column) -> Column:
    length = F.sqrt(numeric.dot(vector, vector))
    return F.transform(vector, lambda x: F.when(length > 0, x / length).otherwise(0.0))


def embedded(df: DataFrame, text_col: str, embed: Callable[[list[str]], list] | None = None, name: str = "embedding") -> DataFrame:
    """Adds a unit vector per row: by an injected model in Arrow batches, else by hashed words.

    The vector stays on its own row, so a row without text can't shift those after it.
    """
    if embed is None:
        return df.withColumn(name, hashed(F.col(text_col)))

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        made = np.asarray(embed([t or "" for t in texts]), dtype=float)
        return pd.Series((made / np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-12)).tolist())

    return df.withColumn(name, run(F.col(text_col)))

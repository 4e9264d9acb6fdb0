"""Pipeline runs: admission of files, names, states and removal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfolio.operators import catalog
from gridfolio.sources import documents, stores


def started(files: DataFrame, run_id: str, name: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A run over uploaded files (path): its row, and one item per file; files that aren't admitted have failed at once."""
    items = stores.with_id(documents.admitted(files.select("path")), "path", name="document_id").withColumn("run_id", F.lit(run_id))
    items = items.select("run_id", "document_id", "path", F.when(F.col("admitted"), "queued").otherwise("failed").alias("status"), F.when(~F.col("admitted"), F.concat(F.lit("unsupported type: ."), "extension")).alias("error"))
    run = items.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("status") == "failed").alias("n_rejected"))
    return run.withColumn("name", F.lit(name or f"run {run_id}")), items


def renamed(runs: DataFrame, run_id: str, name: str) -> DataFrame:
    """The runs with another name for one of them; a blank name changes nothing."""
    return runs.withColumn("name", F.when((F.col("run_id") == run_id) & F.lit(bool(name.strip())), F.lit(name.strip())).otherwise(F.col("name")))


def cleared(runs: DataFrame, items: DataFrame, run_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Runs without one of them (or without any), and the items, which stay and belong to no run then."""
    if run_id is None:
        return runs.limit(0), items.withColumn("run_id", F.lit(None).cast("string"))
    return runs.where(F.col("run_id") != run_id), catalog.detached(items, "run_id", run_id)


def overview(runs: DataFrame, items: DataFrame) -> DataFrame:
    """Runs with counts by status and the status that follows from them."""
    counts = catalog.status_rollup(runs.select("run_id"), items, "run_id", "status", "completed", "failed", "processing")
    return runs.join(counts, "run_id")

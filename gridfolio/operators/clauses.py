"""Clause extraction with an injected reader, its fallback, enrichment in batches, and logical units of a document."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridfolio.functions import text
from gridfolio.functions.nested import from_choice
from gridfolio.operators import chunking

SEGMENT_CHARS, OVERLAP_BLOCKS, LEAST_COVERAGE, MOST_FAILED = 5000, 2, 0.55, 0.5
#: Kinds of clauses and levels of risk.
CLAUSE_TYPES = (
    "obligation prohibition right definition liability indemnification termination confidentiality dispute_resolution force_majeure warranty penalty governing_law general"
).split()
RISKS = ["high", "medium", "low"]
CLAUSE = "struct<clause_number:string,clause_title:string,clause_text:string,clause_type:string,risk_level:string>"


def segments(blocks: DataFrame, by: str = "document_id", order: str = "position", most: int = SEGMENT_CHARS, overlap: int = OVERLAP_BLOCKS) -> DataFrame:
    """Runs of blocks of about ``most`` characters; each begins with the last ``overlap`` blocks of the one before."""
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length("text")).over(before), F.lit(0))
    cut = blocks.withColumn("segment", F.floor(used / most).cast("int"))
    tail = F.row_number().over(Window.partitionBy(by, "segment").orderBy(F.col(order).desc())) <= overlap
    last = F.max("segment").over(Window.partitionBy(by))
    shared = cut.withColumns({"__tail": tail, "__last": last})
    again = F.col("__tail") & (F.col("segment") < F.col("__last"))
    shared = shared.withColumn("segment", F.explode(F.when(again, F.array("segment", F.col("segment") + 1)).otherwise(F.array("segment"))))
    parts = F.sort_array(F.collect_list(F.struct(order, "text")))
    return shared.groupBy(by, "segment").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))


def read_segments(df: DataFrame, read: Callable[[str], list[dict]], by: str = "document_id") -> DataFrame:
    """Adds clauses (array) and failed by an injected reader of one segment; a failure isn't one of the others."""
    names = [f.split(":")[0] for f in CLAUSE[7:-1].split(",")]

    def run(batches):
        for pdf in batches:
            found, failed = [], []
            for t in pdf["text"]:
                try:
                    found.append([{k: c.get(k) for k in names} for c in read(t)])
                    failed.append(False)
                except Exception:
                    found.append([])
                    failed.append(True)
            yield pdf.assign(clauses=found, failed=failed)

    kind = df.schema[by].dataType.simpleString()
    return df.select(by, "segment", "text").mapInPandas(run, f"{by} {kind}, segment int, text string, clauses array<{CLAUSE}>, failed boolean")


def stitched(df: DataFrame, by: str = "document_id") -> DataFrame:
    """Clauses of read segments in order: one without number and title goes on with the clause before it; repeats go."""
    flat = df.select(by, "segment", F.posexplode("clauses").alias("at", "c")).select(by, "segment", "at", "c.*")
    named = (F.trim(F.coalesce("clause_number", F.lit(""))) != "") | (F.trim(F.coalesce("clause_title", F.lit(""))) != "")
    w = Window.partitionBy(by).orderBy("segment", "at")
    first = F.row_number().over(Window.partitionBy(by, text.fingerprint(F.col("clause_number"), F.col("clause_text"))).orderBy("segment", "at"))
    once = flat.withColumn("r", first).where("r = 1").drop("r")
    island = once.withColumn("island", F.sum(named.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.sort_array(F.collect_list(F.struct("segment", "at", "clause_number", "clause_title", "clause_type", "risk_level", "clause_text")))
    head = lambda c: F.element_at("p", 1)[c].alias(c)
    joined = island.groupBy(by, "island").agg(parts.alias("p"))
    body = F.array_join(F.transform("p", lambda x: F.trim(x["clause_text"])), " ").alias("clause_text")
    out = joined.select(by, F.col("island").alias("clause_index"), head("clause_number"), head("clause_title"), from_choice(F.element_at("p", 1)["clause_type"], CLAUSE_TYPES, "general").alias("clause_type"), from_choice(F.element_at("p", 1)["risk_level"], RISKS).alias("risk_level"), body)
    return out


def trusted(df: DataFrame, by: str = "document_id") -> DataFrame:
    """Per document: coverage of the segments' text by clauses, the share that failed, and whether the reading is good enough."""
    covered = F.aggregate(F.transform("clauses", lambda c: F.length(F.coalesce(c["clause_text"], F.lit("")))), F.lit(0), lambda a, x: a + x)
    out = df.groupBy(by).agg((F.sum(covered) / F.greatest(F.sum(F.length("text")), F.lit(1))).alias("coverage"), F.avg(F.col("failed").cast("double")).alias("failed_share"))
    return out.withColumn("trusted", (F.col("coverage") >= LEAST_COVERAGE) & (F.col("failed_share") <= MOST_FAILED))


def extracted(blocks: DataFrame, read: Callable[[str], list[dict]] | None = None, by: str = "document_id") -> DataFrame:
    """Clauses of documents: by the reader where it covers enough of a document, else by patterns."""
    shape = [by, "clause_index", "clause_number", "clause_title", "clause_type", "text"]
    by_pattern = chunking.clauses(blocks, by).select(*shape)
    if read is None:
        return by_pattern
    got = read_segments(segments(blocks, by), read, by)
    good = trusted(got, by).where("trusted").select(by)
    mine = stitched(got.join(good, by, "left_semi"), by).withColumnRenamed("clause_text", "text").select(*shape)
    return mine.unionByName(by_pattern.join(good, by, "left_anti"))


def enriched(df: DataFrame, enrich: Callable[[list[str]], list[dict]] | None = None, text_col: str = "text") -> DataFrame:
    """Adds clause_type and risk_level per clause from an injected model that takes a batch of texts in order.

    A batch that fails, or an answer that is too short, is padded: its clauses become ``general`` without a risk.
    """

    @F.pandas_udf("struct<clause_type:string,risk_level:string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        try:
            got = list(enrich(texts.tolist())) if enrich else []
        except Exception:
            got = []
        got += [{}] * (len(texts) - len(got))
        return pd.DataFrame({"clause_type": pd.Series([g.get("clause_type") for g in got], dtype=object), "risk_level": pd.Series([g.get("risk_level") for g in got], dtype=object)})

    out = df.withColumn("__e", run(F.col(text_col)))
    return out.withColumns({"clause_type": from_choice(F.col("__e.clause_type"), CLAUSE_TYPES, "general"), "risk_level": from_choice(F.col("__e.risk_level"), RISKS)}).drop("__e")


def typed_chunks(df: DataFrame, title: str = "section") -> DataFrame:
    """Adds semantic_type, clause_number, clause_title, clause_type and risk_level by rules, from text, title and block_types."""
    c = text.clause(F.col("text"), F.col(title))
    has = lambda kind: F.array_contains("block_types", kind)
    out = df.withColumn("__c", c)
    kind = F.when(F.col("__c.is_clause"), "legal_clause").when(has("list"), "list").when(has("image_analysis"), "image_analysis").otherwise("paragraph")
    return out.withColumns(
        {
            "semantic_type": kind,
            "clause_number": F.col("__c.number"),
            "clause_title": F.coalesce("__c.title", title),
            "clause_type": F.col("__c.type"),
            "risk_level": F.when(F.col("__c.is_clause"), "medium"),
        }
    ).drop("__c")


def section_paths(items: DataFrame, by: str = "document_id", order: str = "position", levels: int = 6) -> DataFrame:
    """Adds section_path: the headings above an item, outermost first. A heading ends all sections as deep as itself or deeper.

    Items have kind, level (of headings) and text.
    """
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    at = [F.max(F.when((F.col("kind") == "heading") & (F.col("level") == k), F.col(order))).over(w) for k in range(1, levels + 1)]
    name = [F.last(F.when((F.col("kind") == "heading") & (F.col("level") == k), F.col("text")), ignorenulls=True).over(w) for k in range(1, levels + 1)]
    df = items.withColumns({f"__a{k}": F.coalesce(a, F.lit(-1)) for k, a in enumerate(at)}).withColumns({f"__n{k}": n for k, n in enumerate(name)})
    parts = []
    for k in range(levels):
        outer = F.greatest(F.lit(-2), F.lit(-2), *[F.col(f"__a{j}") for j in range(k)])
        parts.append(F.when((F.col(f"__a{k}") >= 0) & (F.col(f"__a{k}") > outer), F.col(f"__n{k}")))
    path = F.filter(F.array(*parts), lambda x: x.isNotNull())
    return df.withColumn("section_path", path).drop(*[f"__{c}{k}" for k in range(levels) for c in "an"])


def units(items: DataFrame, by: str = "document_id", order: str = "position") -> DataFrame:
    """Logical units: neighbouring list items of one section are one unit, every other block that is no heading is its own."""
    rows = section_paths(items, by, order).where("kind <> 'heading'")
    w = Window.partitionBy(by).orderBy(order)
    joins = (F.col("kind") == "list") & (F.lag("kind").over(w) == "list") & F.col("section_path").eqNullSafe(F.lag("section_path").over(w))
    unit = F.sum((~F.coalesce(joins, F.lit(False))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    parts = F.sort_array(F.collect_list(F.struct(order, "text", "kind", "section_path")))
    out = rows.withColumn("unit", unit).groupBy(by, "unit").agg(parts.alias("p"))
    return out.select(by, "unit", F.element_at("p", 1)["kind"].alias("kind"), F.element_at("p", 1)["section_path"].alias("section_path"), F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))


def without_captions(blocks: DataFrame) -> DataFrame:
    """Blocks of a financial document for chunking: captions of tables and figures go."""
    return blocks.where(F.col("kind") != "caption")

"""Hard-negative mining by distributed radix selection over integer scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridfolio.session import scratch_path, written

POSITIVES, NEGATIVES = 5, 3
#: Hundredths of a positive's score between which its negatives score, and what both are compared in.
LOW, HIGH, WHOLE = 50, 95, 100
SCALE = 256
#: Anchors whose windows are selected together: their vectors and the state of their windows are broadcast, 4 MB at 64 dimensions.
GROUP = 4096
#: Bits of a digit, and scores that are worked on at once in a task.
DIGIT = 8
SCORES = 1_000_000
#: Rows that a window may gather beyond those it returns before its threshold needs no further digit.
SLACK = 64
SCORE_DIGITS, ID_DIGITS, SETTLED = 0, 1, 2
#: The id of a row without one, in the order of ids: after all others.
LAST = np.iinfo(np.int64).max


def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """row, vec_id, label, v: rows with a label and a finite vector, components as floor(256 x); where the id is divisible by 7, the next label of ten.

    A null id is divisible by nothing. Vectors that are shorter than the longest count as filled up with zeros.
    """
    vector = F.col(vector_col).cast("array<double>")
    fit = F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    i, label = F.col(id_col).cast("long"), F.col(label_col).cast("long")
    moved = F.when(i % 7 == 0, F.pmod(label + 1, F.lit(10))).otherwise(label)
    v = F.transform(vector, lambda x: F.floor(x * SCALE).cast("long"))
    return rows.where(fit).select(F.monotonically_increasing_id().alias("row"), i.alias("vec_id"), moved.alias("label"), v.alias("v"))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """The vectors of a batch as rows of a matrix, filled up with zeros."""
    ends = lists.offsets.to_numpy().astype(np.int64)
    size = np.diff(ends)
    out = np.zeros((len(size), width), dtype=np.int64)
    at = np.arange(size.sum()) - np.repeat(ends[:-1] - ends[0], size)
    inside = at < width
    out[np.repeat(np.arange(len(size)), size)[inside], at[inside]] = lists.values.to_numpy()[ends[0] : ends[-1]][inside]
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of two matrices: in floating point where no sum can leave its whole numbers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Windows:
    """The state of a group's windows: which rows each takes, and how far the place of its kth row is known.

    A window takes the rows of its anchor's label (but the anchor itself), or those of other labels, with a score in [low, high]. Best is the
    highest score, then the smallest id. ``base`` and ``shift`` give the digit that is counted next: of high - score, and, among
    rows of one score ``tie``, of id - first.
    """

    def __init__(self, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int, ids: tuple[int, int]):
        self.anchor, self.low, self.high, self.same, self.k = anchor, low, high, same, k
        self.first, self.ids = np.uint64(ids[0] & (2**64 - 1)), ids
        n = len(anchor)
        self.level, self.base, self.need = np.zeros(n, np.int8), np.zeros(n, np.uint64), np.full(n, k)
        span = [max(0, int(h) - int(lo)) for lo, h in zip(low, high, strict=True)]
        self.shift = np.array([max(0, s.bit_length() - DIGIT) for s in span], dtype=np.uint64)
        # A row qualifies below ``end`` of high - score, or at the score of ``tie`` with an id up to ``last``.
        self.end = np.array(span, dtype=np.uint64)
        self.tie, self.last = np.zeros(n, np.int64), np.zeros(n, np.uint64)
        self.tied = np.zeros(n, dtype=bool)

    def digits(self, w: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which (window, row) pairs take part in the count of this round, and their digits."""
        by_score = (self.high[w] - score).astype(np.uint64)
        by_id = vec_id.astype(np.uint64) - self.first
        level = self.level[w]
        key = np.where(level == ID_DIGITS, by_id, by_score) - self.base[w]
        digit = key >> self.shift[w]
        asked = (level != SETTLED) & (digit < 2**DIGIT) & np.where(level == ID_DIGITS, (score == self.tie[w]) & (by_id >= self.base[w]), by_score >= self.base[w])
        return asked, digit.astype(np.int64)

    def qualify(self, w: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> np.ndarray:
        by_score = (self.high[w] - score).astype(np.uint64)
        return np.where(self.tied[w], (score > self.tie[w]) | (score == self.tie[w]) & (vec_id.astype(np.uint64) - self.first <= self.last[w]), by_score <= self.end[w])

    def refine(self, counts: dict[int, list[tuple[int, int]]]) -> bool:
        """Take the counts of the best digits of each open window; whether any window is still open."""
        for w in np.flatnonzero(self.level != SETTLED).tolist():
            before, found = 0, None
            for digit, n in sorted(counts.get(w, ())):
                if before + n >= self.need[w]:
                    found = digit, n
                    break
                before += n
            if found is None:
                # Fewer rows than wanted: all that are left of the window qualify.
                self.level[w] = SETTLED
                continue
            digit, n = found
            self.need[w] -= before
            shift = int(self.shift[w])
            self.base[w] += np.uint64(digit << shift)
            top = int(self.base[w]) + (1 << shift) - 1
            if self.level[w] == SCORE_DIGITS:
                self.end[w] = min(int(self.end[w]), top)
                if n <= SLACK:
                    self.level[w] = SETTLED
                elif not shift:
                    self.level[w], self.tied[w] = ID_DIGITS, True
                    self.tie[w] = int(self.high[w]) - int(self.base[w])
                    span = self.ids[1] - self.ids[0]
                    self.base[w], self.shift[w], self.last[w] = 0, max(0, span.bit_length() - DIGIT), span
                    continue
            else:
                self.last[w] = min(int(self.last[w]), top)
                if n <= SLACK or not shift:
                    self.level[w] = SETTLED
            self.shift[w] = max(0, shift - DIGIT)
        return bool((self.level != SETTLED).any())


def _pairs(windows: Windows, anchors: dict, batch: pa.RecordBatch):
    """Windows, row places and scores of all pairs of a window with a row that it may take, in parts of bounded size."""
    v = _matrix(batch.column("v"), anchors["v"].shape[1])
    label, row = batch.column("label").to_numpy(), batch.column("row").to_numpy()
    order = np.argsort(label, kind="stable")
    # Windows by anchor: those of one anchor lie together.
    of = np.argsort(windows.anchor, kind="stable")
    begin = np.searchsorted(windows.anchor[of], np.arange(len(anchors["row"]) + 1))
    many = np.diff(begin)
    least, most = np.full(len(many), LAST), np.full(len(many), -LAST)
    np.minimum.at(least, windows.anchor, windows.low)
    np.maximum.at(most, windows.anchor, windows.high)
    asked = np.flatnonzero(many > 0)
    step = max(1, SCORES // max(1, len(asked)))
    edges = np.concatenate([[0], np.flatnonzero(np.diff(label[order])) + 1, [len(order)]])
    runs = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if windows.same else [(0, len(order))]
    for lo, hi in runs:
        if lo == hi:
            continue
        own = asked[anchors["label"][asked] == label[order[lo]]] if windows.same else asked
        if not len(own):
            continue
        for at in range(lo, hi, step):
            some = order[at : min(hi, at + step)]
            score = products(anchors["v"][own], v[some])
            fit = (score >= least[own, None]) & (score <= most[own, None])
            fit &= anchors["row"][own, None] != row[some] if windows.same else anchors["label"][own, None] != label[some]
            a, r = np.nonzero(fit)
            score = score[a, r]
            a, r = own[a], some[r]
            # Each pair once for every window of its anchor.
            n = many[a]
            pair = np.repeat(np.arange(len(a)), n)
            w = of[begin[a][pair] + np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)]
            score, r = score[pair], r[pair]
            inside = (score >= windows.low[w]) & (score <= windows.high[w])
            yield w[inside], r[inside], score[inside]


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("vec_id").fill_null(LAST).to_numpy()


def _counts(rows: DataFrame, anchors, windows) -> DataFrame:
    """window, digit, n: how many rows have each digit, of every open window, as far as its kth row can be.

    A task gives the digits up to that of its own kth row only: the kth of all rows is none beyond. So it gives k rows a window at most.
    """

    def run(batches):
        own, told = windows.value, anchors.value
        counts = np.zeros((len(own.anchor), 2**DIGIT), dtype=np.int64)
        for batch in batches:
            ids = _ids(batch)
            for w, r, score in _pairs(own, told, batch):
                asked, digit = own.digits(w, score, ids[r])
                counts += np.bincount(w[asked] * 2**DIGIT + digit[asked], minlength=counts.size).reshape(counts.shape)
        before = np.cumsum(counts, axis=1) - counts
        w, digit = np.nonzero((counts > 0) & (before < own.need[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(digit), pa.array(counts[w, digit])], names=["window", "digit", "n"])

    found = rows.mapInArrow(run, "window long, digit long, n long").groupBy("window", "digit").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy("window").orderBy("digit")) - F.col("n")
    return found.withColumn("before", before).where(F.col("before") < windows.value.k).select("window", "digit", "n")


def _gathered(rows: DataFrame, anchors, windows, k: int) -> DataFrame:
    """window, rank, vec_id, score of the best k rows of each window, of those that qualify: SLACK more a window at most."""

    def run(batches):
        own, told = windows.value, anchors.value
        for batch in batches:
            ids = _ids(batch)
            for w, r, score in _pairs(own, told, batch):
                good = own.qualify(w, score, ids[r])
                w, r, score = w[good], r[good], score[good]
                # A batch gives its best k of each window.
                order = np.lexsort((ids[r], -score, w))
                w, r, score = w[order], r[order], score[order]
                edge = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])) if len(w) else np.zeros(0, np.int64)
                best = np.arange(len(w)) - np.repeat(edge, np.diff(np.append(edge, len(w)))) < k
                yield pa.RecordBatch.from_arrays([pa.array(w[best]), batch.column("vec_id").take(pa.array(r[best])), pa.array(score[best])], names=["window", "vec_id", "score"])

    found = rows.mapInArrow(run, "window long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("window").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last()))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def select(rows: DataFrame, anchors, windows: Windows) -> DataFrame:
    """The best k rows of all windows. Each round is one job over ``rows`` and brings k counts a window to the driver at most."""
    spark = rows.sparkSession
    while True:
        sent = spark.sparkContext.broadcast(windows)
        counts: dict[int, list[tuple[int, int]]] = {}
        for r in _counts(rows, anchors, sent).toLocalIterator():
            counts.setdefault(r["window"], []).append((r["digit"], r["n"]))
        sent.unpersist()
        if not windows.refine(counts):
            return _gathered(rows, anchors, spark.sparkContext.broadcast(windows), windows.k)


def _of_group(rows: DataFrame, told: list, width: int, largest: int, ids: tuple[int, int], positives: int, negatives: int) -> DataFrame:
    """The triples of one group of anchors."""
    spark = rows.sparkSession
    v = np.zeros((len(told), width), dtype=np.int64)
    for i, r in enumerate(told):
        v[i, : len(r["v"])] = r["v"]
    anchors = {"row": np.array([r["row"] for r in told]), "label": np.array([r["label"] for r in told]), "v": v}
    sent = spark.sparkContext.broadcast(anchors)
    # No score of an anchor lies outside its bound.
    bound = np.abs(v).sum(axis=1) * largest
    near = select(rows, sent, Windows(np.arange(len(told)), -bound, bound, True, positives, ids))
    near = sorted((r["window"], r["rank"], r["vec_id"], r["score"]) for r in near.select("window", "rank", "vec_id", "score").toLocalIterator())
    at, score = np.array([r[0] for r in near], dtype=np.int64), np.array([r[3] for r in near], dtype=np.int64)
    # LOW p <= WHOLE s <= HIGH p, in whole numbers.
    windows = Windows(at, -((-LOW * score) // WHOLE), HIGH * score // WHOLE, False, negatives, ids)
    found = select(rows, sent, windows)
    names = spark.createDataFrame([(i, told[a]["vec_id"], p, s) for i, (a, _, p, s) in enumerate(near)], "window long, anchor_id long, positive_id long, positive_score long")
    return found.join(F.broadcast(names), "window").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(rows: DataFrame, is_anchor: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, group: int = GROUP) -> DataFrame:
    """The hardest negatives of each anchor and positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are taken in groups of bounded size. Of each group the windows are counted digit by digit over all rows, until the digit
    of every window's kth row leaves few others; then the rows that qualify are gathered. Rows never meet in one place: a task
    brings counts of its own, and k rows a window at the end. A vector that a third of the rows share costs digits of the id.

    Rows with a null label, a null vector or a component that is null or not finite take no part. Rows are told apart by
    themselves, so rows that repeat an id are positives of each other and anchors each; a null id is no anchor, and comes last among
    equal scores. Scores are exact while they fit 64 bits. Tables without a usable row or an anchor give no rows; other columns are not read.
    """
    spark = rows.sparkSession
    own = written(usable(rows).repartition(spark.sparkContext.defaultParallelism * 2), "vectors")
    about = own.agg(
        F.max(F.size("v")).alias("width"), F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))).alias("largest"),
        F.min(F.coalesce("vec_id", F.lit(int(LAST)))).alias("first"), F.max(F.coalesce("vec_id", F.lit(int(LAST)))).alias("last"),
    ).first()
    path = scratch_path(spark, "negatives")
    asked = own.where(F.col("vec_id") % 50 == 0 if is_anchor is None else is_anchor)
    # Groups are ranges of the number of a row, each of GROUP anchors at most: the driver holds one group at a time.
    told: list = []
    done = False

    def flush(told: list) -> None:
        out = _of_group(own, told, about["width"], about["largest"] or 0, (about["first"], about["last"]), positives, negatives)
        out.write.mode("append").parquet(path)

    for r in asked.toLocalIterator():
        told.append(r)
        if len(told) == group:
            flush(told)
            told, done = [], True
    if told:
        flush(told)
        done = True
    return spark.read.schema(SCHEMA).parquet(path) if done else spark.createDataFrame([], SCHEMA)


#: The same in SQL, by comparing every anchor with every row.
ORACLE = """
    WITH u AS (
        SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    ), s AS (
        SELECT a.row AS a, a.vec_id AS anchor_id, r.row AS r, r.vec_id AS other_id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
        FROM u a, u r WHERE a.vec_id % 50 = 0 AND a.row <> r.row
    ), p AS (
        SELECT a, anchor_id, r, other_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY a ORDER BY score DESC, other_id) AS i
        FROM s WHERE same
    ), n AS (
        SELECT p.anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score,
               row_number() OVER (PARTITION BY p.a, p.r ORDER BY score DESC, other_id) AS rank
        FROM p JOIN s ON p.a = s.a AND NOT s.same AND p.i <= 5 AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
    )
    SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

"""N-gram Jaccard join with Bayesian candidate pruning."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfolio.llm.components import connected_components
from gridfolio.llm.text import BROADCAST_ROWS, by_size, give_back, hashes, hot_join, shingles, small_batches, without_rows, word_memo, words
from gridfolio.session import written

SHINGLE = 5
THRESHOLD = 0.8
#: MinHash values: BANDS x ROWS. A pair at the threshold shares no band with probability
#: (1 - 0.8^5)^30 < 1e-5.
BANDS, ROWS = 30, 5
#: MinHash values compared between two decisions.
STEP = 15
#: A pair is dropped when its chance of reaching the threshold falls below this.
TOLERANCE = 1e-5
#: Members on either side of a block of signatures, and of a block of shingle sets; larger groups are cut into blocks.
SKETCH_BLOCK = 1024
SET_BLOCK = 1024
#: Bytes of shingle sets on either side of a block: groups of long texts are cut into more blocks.
SET_BYTES = 24 << 20
#: Sets whose common shingles are counted by one product of matrices.
TILE = 256
#: Groups of up to so many members are compared together with others of their task.
SMALL = 32

_N = BANDS * ROWS
_RNG = np.random.default_rng(20_240_501)
_A = (_RNG.integers(0, 2**32, _N, dtype=np.uint64) | 1).astype(np.uint32)
_B = _RNG.integers(0, 2**32, _N, dtype=np.uint64).astype(np.uint32)


def minhash(own: np.ndarray) -> np.ndarray:
    """The MinHash values of a set of 64-bit hashes, in pieces of bounded size."""
    out = np.full(_N, 0xFFFFFFFF, dtype=np.uint32)
    folded = (own ^ (own >> np.uint64(32))).astype(np.uint32)
    for i in range(0, len(folded), 4096):
        h = folded[i : i + 4096, None] * _A + _B
        h ^= h >> np.uint32(15)
        np.minimum(out, (h * np.uint32(0x2C1B3C6D)).min(axis=0), out=out)
    return out


def bands(signature: np.ndarray) -> list[int]:
    """One 64-bit key a band; the band's number is part of it."""
    raw = signature.astype("<u4").tobytes()
    width = 4 * ROWS
    return [xxhash.xxh3_64_intdigest(raw[i * width : (i + 1) * width], seed=i) - 2**63 for i in range(BANDS)]


@lru_cache(maxsize=None)
def needed(compared: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """The fewest equal values among ``compared`` with which a pair still may reach the threshold.

    With a uniform prior the similarity given m of n equal values is Beta(m + 1, n - m + 1), whose mass above
    the threshold is the binomial sum P(X <= m) for n + 1 trials at the threshold.
    """
    total = 0.0
    for m in range(compared + 1):
        total += math.comb(compared + 1, m) * threshold**m * (1 - threshold) ** (compared + 1 - m)
        if total >= tolerance:
            return m
    return compared


def survivors(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs (rows i of left, j of right) keep a chance after each STEP of compared MinHash values."""
    alive = np.arange(len(i))
    same = np.zeros(len(i), dtype=np.int32)
    for at in range(0, _N, STEP):
        if not len(alive):
            break
        same[alive] += (left[i[alive], at : at + STEP] == right[j[alive], at : at + STEP]).sum(1, dtype=np.int32)
        alive = alive[same[alive] >= needed(at + STEP)]
    return alive


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _text_key(text: Column) -> Column:
    """What tells a text from others, besides its row's id."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, copy_key (of the shingle set), n_shingles, signature (binary) per row; no text is carried on."""

    def run(batches):
        for pdf in by_size(batches, "text"):
            keys, sizes, signatures, memo = [], [], [], word_memo()
            for text in pdf["text"]:
                own = shingles(hashes(words(text), memo), SHINGLE)
                keys.append(xxhash.xxh3_128_digest(own.tobytes()))
                sizes.append(len(own))
                signatures.append(minhash(own).astype("<u4").tobytes())
            out = pd.DataFrame({"doc_id": pdf["doc_id"], "text_key": pdf["text_key"], "copy_key": keys, "n_shingles": sizes, "signature": signatures})
            yield out.astype({"doc_id": "Int64"})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id long, text_key binary, copy_key binary, n_shingles long, signature binary")


def _blocks(members: DataFrame, counts: DataFrame, group: str) -> DataFrame:
    """Members dealt over pairs of blocks: left, right, in_left, and the members' columns.

    ``counts`` has the members ``n`` and the number of blocks of each group, ``blocks``. A group of one block is one pair (0, 0). In a larger
    one each member goes to as many pairs as there are blocks, so that any two members meet in exactly one task. Members of
    a large group are dealt where they are, never gathered first.
    """
    counts = written(counts.select(group, "blocks", "n"), f"{group}-blocks")
    cut = hot_join(members, counts, group, "n", counts.agg(F.sum("n")).first()[0] or 0)
    cut = cut.withColumn("__own", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int"))
    cut = cut.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return cut.withColumns({"left": F.least("__own", "__other"), "right": F.greatest("__own", "__other"), "in_left": F.col("__own") <= F.col("__other")})


def _sides(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the two sides that meet in a block pair; the same array twice for a block with itself."""
    if part["left"].iat[0] == part["right"].iat[0]:
        rows = np.arange(len(part))
        return rows, rows
    side = part["in_left"].to_numpy(dtype=bool)
    return np.flatnonzero(side), np.flatnonzero(~side)


def _whole_groups(batches: Iterator[pd.DataFrame], group: str) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Rows sorted by (group, left, right) in portions of whole block pairs, with their starts and sizes."""
    held: pd.DataFrame | None = None

    def portion(rows: pd.DataFrame):
        key = rows[[group, "left", "right"]].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
        return rows, starts, np.diff(np.append(starts, len(rows)))

    for pdf in batches:
        held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        key = held[[group, "left", "right"]].to_numpy()
        other = np.flatnonzero((key != key[-1]).any(1))
        if len(other):
            yield portion(held.iloc[: other[-1] + 1])
            held = held.iloc[other[-1] + 1 :].reset_index(drop=True)
    if held is not None and len(held):
        yield portion(held)


def _small_pairs(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within groups of few members, as row numbers, group size by group size in pieces."""
    for n in np.unique(sizes):
        if n > 1:
            i, j = np.triu_indices(n, 1)
            at = starts[sizes == n][:, None]
            left, right = (at + i).ravel(), (at + j).ravel()
            for k in range(0, len(left), 50_000):
                yield left[k : k + 50_000], right[k : k + 50_000]


def _signatures(pdf: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(pdf["signature"]), dtype="<u4").reshape(len(pdf), _N)


def _block_edges(part: pd.DataFrame, sigs: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a block pair's pairs that survive pruning, as row numbers."""
    rows, cols = _sides(part)
    tree, out = np.arange(len(part)), []
    for i in rows:
        # Pairs inside a tree already are of no use for the components.
        other = cols[tree[cols] != tree[i]] if cols is not rows else cols[(cols > i) & (tree[cols] != tree[i])]
        if len(other):
            for at in survivors(sigs, sigs, np.full(len(other), i), other):
                a, b = tree[i], tree[other[at]]
                if a != b:
                    tree[tree == max(a, b)] = min(a, b)
                    out.append((int(i), int(other[at])))
    return out


def _candidate_edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges between members of one bucket that survive pruning, from rows that are sorted by bucket.

    The pairs of all small buckets of a batch are compared together; a large bucket is compared block by block.
    Of the surviving pairs of a batch only those are written that join two trees, as many as members at most.
    """
    for pdf, starts, sizes in _whole_groups(batches, "band"):
        node, sigs = pdf["node"].to_numpy(), _signatures(pdf)
        small = (sizes <= SMALL) & (pdf["left"].to_numpy()[starts] == pdf["right"].to_numpy()[starts])
        pairs: list[tuple[int, int]] = []
        for left, right in _small_pairs(starts[small], sizes[small]):
            kept = survivors(sigs, sigs, left, right)
            pairs += zip(left[kept].tolist(), right[kept].tolist(), strict=True)
        for start, n in zip(starts[~small].tolist(), sizes[~small].tolist(), strict=True):
            pairs += [(start + a, start + b) for a, b in _block_edges(pdf.iloc[start : start + n], sigs[start : start + n])]
        known, code = np.unique(node, return_inverse=True)
        union = _Union(len(known))
        out = [(node[i], node[j]) for i, j in pairs if union.join(int(code[i]), int(code[j]))]
        yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def _reaches(shared, either):
    """Whether |A & B| / |A | B| is at least the threshold, in whole numbers, so that exactly the threshold counts."""
    return shared * 1000 >= either * round(1000 * THRESHOLD)


def _common(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """How many shingles each set of ``rows`` has in common with each of ``cols``, by products of bit matrices of bounded width."""
    members = np.unique(np.concatenate([rows, cols]))
    place = {int(m): i for i, m in enumerate(members)}
    flat = np.concatenate([sets[m] for m in members])
    owner = np.repeat(np.arange(len(members)), [len(sets[m]) for m in members])
    _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    keep = times[code] > 1
    _, code = np.unique(code[keep], return_inverse=True)
    owner = owner[keep]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    left, right = np.array([place[int(r)] for r in rows]), np.array([place[int(c)] for c in cols])
    out = np.zeros((len(rows), len(cols)), dtype=np.float32)
    width, start = max(256, 4_000_000 // len(members)), 0
    top = int(code[-1]) + 1 if len(code) else 0
    for lo in range(0, top, width):
        end = int(np.searchsorted(code, lo + width))
        grid = np.zeros((len(members), min(width, top - lo)), dtype=np.float32)
        grid[owner[start:end], code[start:end] - lo] = 1
        out += grid[left] @ grid[right].T
        start = end
    return out.astype(np.int64)


def _block_links(part: pd.DataFrame, sigs: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of each member in this block pair, and a spanning forest of them, as row numbers.

    Tile by tile, MinHash values prune the pairs first; exact similarities are computed for the members that have a surviving
    pair left, and only surviving pairs count.
    """
    rows, cols = _sides(part)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    links = np.zeros(len(part), dtype=np.int64)
    union, forest = _Union(len(part)), []
    for a in range(0, len(rows), TILE):
        for b in range(a if cols is rows else 0, len(cols), TILE):
            left, right = rows[a : a + TILE], cols[b : b + TILE]
            i, j = (x.ravel() for x in np.meshgrid(np.arange(len(left)), np.arange(len(right)), indexing="ij"))
            if cols is rows and a == b:
                i, j = i[i < j], j[i < j]
            kept = survivors(sigs, sigs, left[i], right[j])
            if not len(kept):
                continue
            alive = np.zeros((len(left), len(right)), dtype=bool)
            alive[i[kept], j[kept]] = True
            own, other = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
            left, right, alive = left[own], right[other], alive[np.ix_(own, other)]
            shared = _common(sets, left, right)
            linked = alive & _reaches(shared, size[left][:, None] + size[right][None, :] - shared)
            np.add.at(links, left, linked.sum(1))
            np.add.at(links, right, linked.sum(0))
            for x, y in zip(*np.nonzero(linked), strict=True):
                if union.join(int(left[x]), int(right[y])):
                    forest.append((int(left[x]), int(right[y])))
    return links, forest


def _exact_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Exact links of the members of families, from rows sorted by family and block pair: node, parent, links, root.

    A row with links has how many the member has in this block pair. In a family of one block it also has the root of its group of
    links, which is known there; of a larger family the edges of a spanning forest are written, with a parent. No
    other pair is written, so there are as many as members at most.
    """
    for pdf, starts, sizes in _whole_groups(batches, "family"):
        give_back()
        node, sigs = pdf["node"].to_numpy(), _signatures(pdf)
        sets = [np.frombuffer(x, dtype="<u8") for x in pdf["shingles"]]
        links = np.zeros(len(pdf), dtype=np.int64)
        edges: list[tuple[int, int]] = []
        whole = pdf["blocks"].to_numpy() == 1
        small = (sizes <= SMALL) & (pdf["left"].to_numpy()[starts] == pdf["right"].to_numpy()[starts])
        union = _Union(len(pdf))
        for left, right in _small_pairs(starts[small], sizes[small]):
            kept = survivors(sigs, sigs, left, right)
            for i, j in zip(left[kept].tolist(), right[kept].tolist(), strict=True):
                shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if _reaches(shared, len(sets[i]) + len(sets[j]) - shared):
                    links[i] += 1
                    links[j] += 1
                    union.join(i, j)
        for start, n in zip(starts[~small].tolist(), sizes[~small].tolist(), strict=True):
            own, forest = _block_links(pdf.iloc[start : start + n], sigs[start : start + n], sets[start : start + n])
            links[start : start + n] += own
            for a, b in forest:
                if whole[start]:
                    union.join(start + a, start + b)
                else:
                    edges.append((start + a, start + b))
        out = [(node[i], None, int(links[i]), node[union.find(int(i))] if whole[i] else None) for i in np.flatnonzero(links)]
        out += [(node[i], node[j], 0, None) for i, j in edges]
        yield pd.DataFrame(out, columns=["node", "parent", "links", "root"]).astype({"node": "int64", "parent": "Int64", "links": "int64", "root": "Int64"})


def _copies(known: DataFrame) -> DataFrame:
    """One row per distinct shingle set: node (a number of its own), copy_key, rep (smallest id), row (one of its rows), n_copies, n_shingles, signature."""
    copies = known.groupBy("copy_key").agg(
        F.min("doc_id").alias("rep"),
        F.min(F.struct("doc_id", "text_key")).alias("row"),
        F.count(F.lit(1)).alias("n_copies"),
        F.first("n_shingles").alias("n_shingles"),
        F.first("signature").alias("signature"),
    )
    # The numbers are fixed by writing them.
    return written(copies.withColumn("node", F.monotonically_increasing_id()), "copies")


def _classes(docs: DataFrame, copies: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per distinct shingle set: copy_key, class_node (the class's own number), class_id, copy_id, n_copies, n_links."""
    groups = connected_components(_candidates(copies.where("n_shingles > 0").select("node", "signature")))
    families = written(groups.select("node", F.col("component").alias("family")), "families")
    with small_batches(docs.sparkSession):
        found = written(_verified(docs, copies, families, id_col, text_col), "links")
    links = found.where("links > 0").groupBy("node").agg(F.sum("links").alias("n_links"))
    trees = found.where("root is not null").select("node", F.col("root").alias("component"))
    # Only the links of families of several blocks are still in pieces.
    pieces = found.where("parent is not null").select(F.col("node").alias("a"), F.col("parent").alias("b"))
    if pieces.limit(1).count():
        trees = trees.unionByName(connected_components(pieces))
    # Components are numbered by node; the class is named by the smallest id of all its members.
    named = written(trees.join(copies.select("node", "rep"), "node"), "classes")
    smallest = named.groupBy("component").agg(F.min("rep").alias("class_id"), F.count(F.lit(1)).alias("n"))
    total = named.count()
    classes = hot_join(named.select("node", "component"), smallest, "component", "n", total).withColumnRenamed("component", "class_node")
    labelled = copies.select("node", "copy_key", "rep", "n_copies").join(links, "node", "left").join(classes, "node", "left")
    return labelled.select(
        "copy_key",
        F.coalesce("class_node", "node").alias("class_node"),
        F.coalesce("class_id", "rep").alias("class_id"),
        F.col("rep").alias("copy_id"),
        "n_copies",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, copy_id, n_copies, n_links, n_shingles.

    Two texts link when the sets of their runs of five words (lower case, without punctuation; a text of fewer
    words is one run) have a Jaccard similarity of at least 0.8. copy_id is the smallest id with the same set,
    n_copies how many rows have it, n_links with how many other sets it links, and class_id the smallest id in
    its connected group of links.

    1. A sketch of each document; documents with equal sets are one representative from here on.
    2. Representatives that share a MinHash band are compared MinHash value by value, and pairs are dropped when
       the posterior probability of reaching the threshold falls below TOLERANCE. What survives joins candidate groups.
    3. Within candidate groups the same pruning decides which pairs are verified, by their exact similarity, in blocks.

    No step writes out the pairs of a group or gathers a group in one task. Sets are told apart by their content and
    not by ids, so texts that share an id are grouped each for itself. Null and empty texts have the empty
    set: one copy class without links. A null id is never the name of a class that has another id; a class of null ids
    has none. Repeated rows count in n_copies; other columns are not read; an empty table gives no rows.
    """
    with small_batches(docs.sparkSession):
        known = written(sketches(docs, id_col, text_col), "sketches")
    labelled = _classes(docs, _copies(known), id_col, text_col)
    return _spread(known.select("doc_id", "copy_key", "n_shingles"), written(labelled, "labelled")).select(
        "doc_id", "class_id", "copy_id", "n_copies", "n_links", "n_shingles"
    )


def _spread(rows: DataFrame, labelled: DataFrame) -> DataFrame:
    """Labels of copies given to their rows; one set may have very many."""
    total = labelled.agg(F.sum("n_copies")).first()[0] or 0
    return hot_join(rows, labelled.withColumn("__n", F.col("n_copies")), "copy_key", "__n", total)


def _candidates(reps: DataFrame) -> DataFrame:
    """Edges (a, b) between representatives that share a band and survive the pruning: spanning forests per bucket."""

    def run(batches):
        for pdf in batches:
            sigs = [np.frombuffer(s, dtype="<u4") for s in pdf["signature"]]
            yield pd.DataFrame({"node": np.repeat(pdf["node"].to_numpy(), BANDS), "band": np.array([bands(s) for s in sigs], dtype=np.int64).reshape(-1)})

    keys = written(reps.mapInPandas(run, "node long, band long"), "bands")
    counts = keys.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / SKETCH_BLOCK).cast("int"))
    # Members of large buckets are dealt over blocks before their signatures are attached.
    dealt = _blocks(keys, counts, "band").select("band", "left", "right", "in_left", "node").join(reps, "node")
    columns = ["band", "left", "right", "in_left", "node", "signature"]
    dealt = dealt.select(*columns).repartition("band", "left", "right").sortWithinPartitions("band", "left", "right")
    return dealt.mapInPandas(_candidate_edges, "a long, b long")


def _verified(docs: DataFrame, copies: DataFrame, families: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Exact links of the members of each family: node, parent, links, root.

    Of the rows that share a set one is read again, told by its id and text.
    """
    n = families.count()
    members = copies.select("node", "row", "signature").join(families, "node")
    wanted = written(members.select(F.col("row.doc_id").alias("__id"), F.col("row.text_key").alias("__key"), "node", "family"), "wanted")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key"))
    texts = rows.join(F.broadcast(wanted) if n <= BROADCAST_ROWS else wanted, same).select("node", "family", "text")

    def run(batches):
        for pdf in by_size(batches, "text"):
            memo = word_memo()
            sets = [shingles(hashes(words(t), memo), SHINGLE) for t in pdf["text"]]
            yield pd.DataFrame({"node": pdf["node"], "family": pdf["family"], "size": [8 * len(x) for x in sets], "shingles": [x.astype("<u8").tobytes() for x in sets]})

    # Rows that repeat id and text give their set twice.
    sets = written(texts.mapInPandas(run, "node long, family long, size long, shingles binary"), "shingles")
    if sets.count() > n:
        sets = written(sets.dropDuplicates(["node"]), "shingles")
    counts = sets.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).where("n > 1")
    counts = counts.withColumn("blocks", F.greatest(F.ceil(F.col("n") / SET_BLOCK), F.ceil(F.col("bytes") / SET_BYTES)).cast("int"))
    dealt = _blocks(sets.join(members.select("node", "signature"), "node"), counts, "family")
    columns = ["family", "left", "right", "in_left", "blocks", "node", "signature", "shingles"]
    dealt = dealt.select(*columns).repartition("family", "left", "right").sortWithinPartitions("family", "left", "right")
    return dealt.mapInPandas(_exact_links, "node long, parent long, links long, root long")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each near-duplicate class of ``docs``, that with the smallest id (null last), with all its columns.

    Rows are told by id and text together, so of rows that share an id those with a text of another class stay.
    Among equal ids of a class the smallest text digest stays; of rows that repeat id and text, one.
    """
    with small_batches(docs.sparkSession):
        known = written(sketches(docs, id_col, text_col), "sketches")
    labelled = written(_classes(docs, _copies(known), id_col, text_col).select("copy_key", "class_node", "n_copies"), "labelled")
    own = known.select("doc_id", "text_key", "copy_key")
    rows = written(_spread(own, labelled).groupBy("doc_id", "text_key", "class_node").agg(F.count(F.lit(1)).alias("n")), "near-rows")
    first = rows.groupBy("class_node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("row"))
    stay = written(first.select(F.col("row.doc_id").alias("__id"), F.col("row.text_key").alias("__key")), "near-stay")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key"))
    drop = written(rows.join(stay, same, "left_anti").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")), "near-drop")
    repeated = written(rows.where("n > 1").join(stay, same, "left_semi").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")), "near-repeated")
    return without_rows(docs, drop, repeated, id_col, text_col, _text_key(F.col(text_col)))

"""Benchmark decontamination: spaced seeds of documents and benchmark are joined, and hits verified with substitutions allowed."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfolio.llm.text import BROADCAST_ROWS, Memo, by_size, free_names, hashes, held, hot_join, small_batches, word_hash, word_memo, words
from gridfolio.session import written

#: Fixed masks: 1 is a token that counts, 0 one that is ignored. Together they hit every overlap of MIN_TOKENS tokens or
#: more, wherever a fifth of its tokens is substituted: a test enumerates all placements up to 25 tokens, and of a longer
#: overlap some part of 12 to 25 tokens has no more than its share of substitutions.
MASKS = ("11011001", "1010110101", "1100100111", "111000100011")
#: Masks for benchmark texts of fewer than MIN_TOKENS tokens, which MASKS would not always hit.
SHORT_MASKS = ("111", "1101", "1011")
#: An overlap counts from so many aligned tokens, or the whole benchmark text if that is shorter ...
MIN_TOKENS = 12
#: ... of which such a share is equal.
MIN_SHARE = 0.8
#: Bits of the filter that seeds of documents pass before they are joined, as a power of two: 2 MB for any benchmark.
FILTER_BITS = 24
#: Seeds of the benchmark that may be broadcast to the documents' seeds, about 40 bytes each; more are joined by a shuffle.
BROADCAST_SEEDS = 1_000_000
_MULTIPLIERS = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 2**64) for i in range(16)], dtype=np.uint64)


def seed_hashes(tokens: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the tokens under ``mask`` for each place where the mask fits."""
    n = len(tokens) - len(mask) + 1
    out = np.zeros(max(0, n), dtype=np.uint64)
    if n > 0:
        for i, bit in enumerate(mask):
            if bit == "1":
                out += tokens[i : i + n] * _MULTIPLIERS[i]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
    return out


def masks_of(n: int) -> tuple[str, ...]:
    """The masks that find a benchmark text of ``n`` tokens; one of fewer than three can't be found."""
    return MASKS if n >= MIN_TOKENS else SHORT_MASKS if n >= 3 else ()


def slots(seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each seed in the filter."""
    low = np.uint64((1 << FILTER_BITS) - 1)
    return (seeds >> np.uint64(64 - FILTER_BITS)).astype(np.int64), ((seeds >> np.uint64(8)) & low).astype(np.int64)


def best_overlap(text: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """The longest aligned overlap in which at least MIN_SHARE of the tokens are equal: start in the item, tokens, equal tokens.

    ``shift`` is where the item's first token would stand in the text. Of all windows whose share is high enough
    the longest wins; prefix sums of (equal - MIN_SHARE) and their running minima find it in one sweep.
    """
    lo, hi = max(0, -shift), min(len(item), len(text) - shift)
    if hi <= lo:
        return None
    equal = item[lo:hi] == text[lo + shift : hi + shift]
    # Scaled to whole numbers, so that a share of exactly MIN_SHARE isn't lost to rounding.
    gain = np.concatenate([[0], np.cumsum(np.where(equal, 100, 0) - round(100 * MIN_SHARE))])
    lows = np.minimum.accumulate(gain)
    best = None
    ends = np.searchsorted(-lows, -gain, side="left")
    i = int(np.argmax(np.arange(len(gain)) - ends))
    a, b = int(ends[i]), i
    if b > a:
        best = (lo + a, b - a, int(equal[a:b].sum()))
    return best


def _key(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _items(benchmark: DataFrame) -> DataFrame:
    """item_row (a number of its own), item_id, tokens (binary hashes) of benchmark texts that have any."""

    def run(batches):
        memo = Memo(word_hash)
        for pdf in by_size(batches, "text"):
            tokens = [hashes(words(t), memo) for t in pdf["text"]]
            found = [(i, t.astype("<u8").tobytes()) for i, t in zip(pdf["item_id"], tokens, strict=True) if len(t)]
            yield pd.DataFrame(found, columns=["item_id", "tokens"]).astype({"item_id": "Int64"})

    texts = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).where("text is not null")
    return written(texts.mapInPandas(run, "item_id long, tokens binary").withColumn("item_row", F.monotonically_increasing_id()), "benchmark-items")


def _seeds(items: DataFrame) -> DataFrame:
    """seed, item_row, place, mask of every seed of the benchmark."""

    def run(batches):
        for pdf in batches:
            for row, raw in zip(pdf["item_row"], pdf["tokens"], strict=True):
                own = np.frombuffer(raw, dtype="<u8")
                for mask in masks_of(len(own)):
                    h = seed_hashes(own, mask)
                    yield pd.DataFrame({"seed": h.view(np.int64), "item_row": row, "place": np.arange(len(h)), "mask": mask})

    return written(items.select("item_row", "tokens").mapInPandas(run, "seed long, item_row long, place long, mask string"), "benchmark-seeds")


def _filter(seeds: DataFrame) -> bytes:
    """The filter's bits. The executors combine them into words of 32 bits, so the driver gets half a million numbers at most."""
    top, low = F.shiftrightunsigned("seed", 64 - FILTER_BITS), F.shiftrightunsigned("seed", 8).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    places = seeds.select(F.explode(F.array(top, low)).alias("slot"))
    words_ = places.select(F.shiftright("slot", 5).alias("word"), F.expr("shiftleft(1L, cast(slot & 31 as int))").alias("bit"))
    out = np.zeros(1 << (FILTER_BITS - 5), dtype="<u4")
    for r in words_.groupBy("word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        out[r["word"]] = r["bits"]
    return out.tobytes()


def _hits(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """text_key, seed, at: the places of texts whose seed passes the filter."""
    masks = sorted(r["mask"] for r in seeds.select("mask").distinct().collect())
    shared = rows.sparkSession.sparkContext.broadcast(pickle.dumps((masks, _filter(seeds))))

    def state():
        own, bits = pickle.loads(shared.value)
        return own, np.unpackbits(np.frombuffer(bits, dtype=np.uint8), bitorder="little").astype(bool)

    def run(batches):
        own, flags = held(hash(shared.value), state)
        memo = Memo(word_hash)
        for pdf in by_size(batches, "text"):
            keys, found, places = [], [], []
            for key, text in zip(pdf["text_key"], pdf["text"], strict=True):
                tokens = hashes(words(text), memo)
                for mask in own:
                    h = seed_hashes(tokens, mask)
                    first, second = slots(h)
                    at = np.flatnonzero(flags[first])
                    at = at[flags[second[at]]]
                    if len(at):
                        keys += [key] * len(at)
                        found.append(h[at].view(np.int64))
                        places.append(at)
            if keys:
                yield pd.DataFrame({"text_key": keys, "seed": np.concatenate(found), "at": np.concatenate(places)})

    return rows.select("text_key", "text").mapInPandas(run, "text_key binary, seed long, at long")


def _candidates(rows: DataFrame, items: DataFrame) -> DataFrame:
    """text_key, found: for each text with common seeds the items, with their tokens, and where they would begin in it.

    Seeds of the documents that pass the filter are joined with the benchmark's. Copies of a text give the same rows,
    which are combined where they are read; a seed that very many texts have is hot on the documents' side only,
    where adaptive execution splits it if the benchmark is too large to be broadcast.
    """
    seeds = _seeds(items)
    hits = _hits(rows, seeds)
    known = seeds.select("seed", "item_row", "place")
    joined = hits.join(F.broadcast(known), "seed") if seeds.count() <= BROADCAST_SEEDS else hits.distinct().join(known, "seed")
    starts = written(joined.groupBy("text_key", "item_row").agg(F.collect_set(F.col("at") - F.col("place")).alias("shifts")), "benchmark-candidates")
    # A passage that very many texts have is a hot key here.
    uses = starts.groupBy("item_row").agg(F.count(F.lit(1)).alias("n"))
    named = hot_join(starts, written(items.join(uses, "item_row"), "benchmark-used"), "item_row", "n", starts.count())
    return named.groupBy("text_key").agg(F.collect_list(F.struct("item_row", "item_id", "tokens", "shifts")).alias("found"))


def _verify(text: str, found: list, memo: Memo) -> list[tuple]:
    """(item row, item id, start in the text, start in the item, tokens, equal tokens) of each item's best verified overlap."""
    tokens, out = hashes(words(text), memo), []
    for item in found:
        own, best = np.frombuffer(item["tokens"], dtype="<u8"), None
        for shift in sorted(item["shifts"]):
            got = best_overlap(tokens, own, shift)
            if got and got[1] >= min(MIN_TOKENS, len(own)) and (best is None or got[1:] > best[4:]):
                best = (item["item_row"], item["item_id"], shift + got[0], *got)
        if best:
            out.append(best)
    return sorted(out)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    return rows.withColumn("text_key", _key(F.col("text")))


def _verified(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_key and the overlap, per document row and benchmark item."""
    rows = _rows(docs, id_col, text_col)
    with small_batches(docs.sparkSession):
        found = written(_candidates(rows, _items(benchmark)), "benchmark-texts")
    keys = found.select("text_key")
    # Only texts with candidates are read again in full and shuffled.
    near = rows.join(F.broadcast(keys) if found.count() <= BROADCAST_ROWS else keys, "text_key", "left_semi")

    def run(batches):
        memo = word_memo()
        for pdf in by_size(batches, "text"):
            out = []
            for doc_id, key, text, own in zip(pdf["doc_id"], pdf["text_key"], pdf["text"], pdf["found"], strict=True):
                out += [(doc_id, key, *rest) for _, *rest in _verify(text, own, memo)]
            yield pd.DataFrame(out, columns=["doc_id", "text_key", "item_id", "doc_start", "item_start", "n_tokens", "n_equal"]).astype({"doc_id": "Int64", "item_id": "Int64"})

    # Each row carries its text and the tokens of its candidates: few go to a worker at once, so the result is made here, in small batches.
    with small_batches(docs.sparkSession):
        return written(near.join(found, "text_key").mapInPandas(run, "doc_id long, text_key binary, item_id long, doc_start int, item_start int, n_tokens int, n_equal int"), "benchmark-overlaps")


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row and benchmark item that overlap: doc_id, item_id, doc_start, item_start, n_tokens, n_equal.

    An overlap is an alignment without gaps of at least MIN_TOKENS tokens (or the whole item if it is shorter)
    of which at least MIN_SHARE are equal; starts are token positions, and of several overlaps of a pair the
    longest is given. Tokens are lower-case words, so punctuation and white space don't matter.

    The documents are scanned for seeds once, whatever the benchmark's size, and those with a seed in common once
    more to verify. Null texts overlap nothing, and neither do items of fewer than three tokens; items
    with a null id are given as null. Repeated rows give repeated results; an empty table on either side none.
    """
    return _verified(docs, benchmark, id_col, text_col).drop("text_key")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text overlaps no benchmark item, with all their columns.

    It is the text that decides: a row that shares its id, or the lack of one, with a row that goes stays.
    """
    own, key = free_names(docs, "own", "hit")
    found = _verified(docs, benchmark, id_col, text_col).select(F.col("text_key").alias(key))
    with small_batches(docs.sparkSession):
        hit = written(found.distinct(), "benchmark-hits")
    few = hit.count() <= BROADCAST_ROWS
    return docs.withColumn(own, _key(F.col(text_col))).join(F.broadcast(hit) if few else hit, F.col(own) == F.col(key), "left_anti").drop(own)

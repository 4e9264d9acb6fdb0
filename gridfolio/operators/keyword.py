"""Full-text search: tokens with positions, boolean queries with phrases, and a cover-density rank."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridfolio.operators import per_text

WORD = re.compile("[a-z0-9]+")
#: Words that are neither indexed nor searched for.
STOP_WORDS = frozenset(
    "a an and are as at be been but by for from had has have he her his i if in into is it its me my no not of on or our she so than that the their "
    "them then there these they this to too very was we were what when where which who will with you your".split()
)


@dataclass(frozen=True)
class Query:
    """OR of ANDs of terms and phrases (tuples of words), and what must not occur."""

    any_of: tuple[tuple[tuple[str, ...], ...], ...]
    none_of: tuple[tuple[str, ...], ...]

    def words(self) -> list[str]:
        return sorted({w for branch in self.any_of for phrase in branch for w in phrase})


def stem(word: str) -> str:
    """A light English stem: plural s, es, ies and the endings ing and ed."""
    for end, put in (("ies", "y"), ("sses", "ss"), ("ing", ""), ("ed", ""), ("es", "e"), ("s", "")):
        if word.endswith(end) and len(word) - len(end) >= 3 and not word.endswith("ss"):
            return word[: len(word) - len(end)] + put
    return word


def stem_column(word: Column) -> Column:
    """The same stem as a Column."""
    out = word
    for end, put in reversed((("ies", "y"), ("sses", "ss"), ("ing", ""), ("ed", ""), ("es", "e"), ("s", ""))):
        cut = F.concat(F.left(word, F.greatest(F.length(word) - len(end), F.lit(0))), F.lit(put))
        out = F.when(F.endswith(word, F.lit(end)) & (F.length(word) - len(end) >= 3) & ~F.endswith(word, F.lit("ss")), cut).otherwise(out)
    return out


def parse(text: str, stem: Callable[[str], str] = stem) -> Query:
    """Web-search syntax: words are joined by AND, ``or`` makes alternatives, "..." is a phrase, -word excludes."""
    branches, none_of = [[]], []
    for minus, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text):
        if not quoted and word.lower() == "or":
            branches.append([])
            continue
        terms = tuple(stem(w) for w in re.findall(r"[a-z0-9]+", (quoted or word).lower()) if w not in STOP_WORDS)
        if terms and minus:
            none_of.append(terms)
        elif terms:
            branches[-1].append(terms)
    return Query(tuple(tuple(b) for b in branches if b), tuple(none_of))


def tokens(text: Column) -> Column:
    """Stems of the indexed words of a text in order; a stop word keeps its place as an empty string."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.transform(found, lambda w: F.when(w.isin(*STOP_WORDS), F.lit("")).otherwise(stem_column(w)))


def _has(token_array: Column, phrase: tuple[str, ...]) -> Column:
    if len(phrase) == 1:
        return F.array_contains(token_array, phrase[0])
    joined = F.concat(F.lit(" "), F.array_join(F.filter(token_array, lambda t: t != ""), " "), F.lit(" "))
    return F.contains(joined, F.lit(" " + " ".join(phrase) + " "))


def matches(token_array: Column, query: Query) -> Column:
    out = F.lit(False)
    for branch in query.any_of:
        every = F.lit(True)
        for phrase in branch:
            every = every & _has(token_array, phrase)
        out = out | every
    for phrase in query.none_of:
        out = out & ~_has(token_array, phrase)
    return out


def may_match(text: Column, query: Query) -> Column:
    """A cheap condition that every match fulfils: the raw text contains the beginnings of a branch's words.

    It is evaluated before the texts are cut into tokens, which costs far more.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for branch in query.any_of:
        every = F.lit(True)
        for word in sorted({w for phrase in branch for w in phrase}):
            every = every & F.contains(low, F.lit(word[:-1] if len(word) > 3 else word))
        out = out | every
    return out


def cover_density(token_array: Column, query: Query) -> Column:
    """Each occurrence of a query word counts 1 / (1 + gap to the occurrence before it); the first counts 1.

    Dense covers of the query words rank higher, as in cover-density ranking; the sum is what orders results.
    """
    wanted = query.words()
    places = F.filter(F.transform(token_array, lambda t, i: F.when(t.isin(*wanted), i)), lambda x: x.isNotNull()) if wanted else F.array()
    return density(places)


def density(places: Column) -> Column:
    """The rank that sorted places of query words give."""
    gaps = F.transform(places, lambda x, i: F.when(i == 0, F.lit(0)).otherwise(x - F.get(places, i - 1) - 1))
    return F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + 1.0 / (1.0 + g))


def search(df: DataFrame, text: str, k: int, by: str = "store", id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """The best k rows of each store: rank, and distance = 1 - rank / best rank of the store. An empty query finds nothing."""
    query = parse(text)
    rows = df.where(may_match(F.col(text_col), query)).withColumn("__t", tokens(F.col(text_col))).where(matches(F.col("__t"), query)).withColumn("rank", cover_density(F.col("__t"), query)).drop("__t")
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.col("rank").desc(), id_col))
    top = rows.withColumn("__place", place).where(F.col("__place") <= k).drop("__place")
    best = F.max("rank").over(Window.partitionBy(by))
    return top.withColumn("distance", 1 - F.col("rank") / best)


def placed(batches: Iterator[pa.RecordBatch], stem: Callable[[str], str]) -> Iterator[pa.RecordBatch]:
    """The postings of batches of store, id and lower-case text, a slice of texts at a time."""
    for part in per_text.slices(batches, "text"):
        terms, at, positions, ordinals, sizes = [], [], [], [], []
        for row, text in enumerate(part.column("text").to_pylist()):
            found: dict[str, list[int]] = {}
            words = WORD.findall(text)
            for place, word in enumerate(words):
                if word not in STOP_WORDS:
                    found.setdefault(word, []).append(place)
            # Counting all words that aren't left out gives their ordinals.
            kept = [w not in STOP_WORDS for w in words]
            ordinal = list(accumulate(kept, initial=0))
            merged: dict[str, list[int]] = {}
            for word, places in found.items():
                term = stem(word)
                merged[term] = sorted(merged[term] + places) if term in merged else places
            for term, places in merged.items():
                terms.append(term)
                at.append(row)
                sizes.append(len(places))
                positions += places
                ordinals += [ordinal[p] for p in places]
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        places = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (positions, ordinals)]
        rows_of = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays([part.column("store").take(rows_of), part.column("id").take(rows_of), pa.array(terms, pa.string()), *places], names=["store", "id", "term", "positions", "ordinals"])


def postings(df: DataFrame, by: str, id_col: str, text_col: str, stem: Callable[[str], str] = stem) -> DataFrame:
    """store, id, term, positions, ordinals: where each term of a text stands, counting all words and counting those that aren't left out.

    A row's terms are put together where it is read, in slices of texts, so that memory doesn't follow the size of a batch.
    """
    rows = df.select(F.col(by).alias("store"), F.col(id_col).alias("id"), F.lower(text_col).alias("text")).where("text is not null")

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(partial(placed, stem=stem), f"store {kinds['store']}, id {kinds['id']}, term string, positions array<int>, ordinals array<int>")


def inverted_index(df: DataFrame, by: str = "store", id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """store, term, id, positions: the stored form for repeated searches.

    The terms of a text are put together where it is read; only rows that share store and id with others are grouped.
    """
    once, again = per_text.apart(df.select(by, id_col, text_col), [by, id_col])
    names = [F.col("store").alias(by), "term", F.col("id").alias(id_col)]
    own = postings(once, by, id_col, text_col).select(*names, "positions")
    if again is None:
        return own
    shared = postings(again, by, id_col, text_col).groupBy("store", "term", "id").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    return own.unionByName(shared.select(*names, "positions"))

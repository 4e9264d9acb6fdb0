"""The stored text index against a scan that analyses every text."""

import random
import re

import pytest
from gridfolio.functions.stemming import english
from gridfolio.operators import keyword, text_index
from gridfolio.operators.text_index import TextIndex
from gridfolio.session import scratch_path
from pyspark.sql import functions as F

#: Words of the algorithm's published vocabulary with their stems.
STEMS = {
    "consign": "consign", "consigned": "consign", "consistency": "consist", "consistently": "consist", "consolation": "consol", "consolatory": "consolatori", "consolidate": "consolid",
    "consolingly": "consol", "consonant": "conson", "conspicuously": "conspicu", "conspiracy": "conspiraci", "conspirators": "conspir", "constable": "constabl", "knavery": "knaveri",
    "kneaded": "knead", "kneeling": "kneel", "knife": "knife", "knighthood": "knighthood", "knocked": "knock", "knots": "knot", "skies": "sky", "dying": "die", "relational": "relat",
    "conditional": "condit", "happy": "happi", "hoping": "hope", "hopping": "hop", "generous": "generous", "generally": "general", "communism": "communism", "licenses": "licens",
    "agreed": "agre", "feed": "feed", "cries": "cri", "ties": "tie", "gas": "gas", "kiwis": "kiwi", "say": "say", "by": "by", "cry": "cri", "youth": "youth", "fulfill": "fulfil", "roll": "roll",
    "controlling": "control", "conflated": "conflat", "troubled": "troubl", "hissing": "hiss", "fizzed": "fizz", "filing": "file", "analogies": "analog", "decisiveness": "decis", "cease": "ceas",
    "rate": "rate", "proceeds": "proceed", "added": "ad", "beds": "bed", "news": "news", "atlas": "atlas", "only": "onli", "early": "earli", "rationalization": "ration", "is": "is",
}


def test_stems():
    got = {w: english(w) for w in STEMS}
    assert got == STEMS


def test_stems_of_any_letters():
    """No word fails, and a stem is never longer than its word and one letter."""
    r = random.Random(1)
    for _ in range(5000):
        word = "".join(r.choice("aeiouysltnged'") for _ in range(r.randint(1, 10)))
        assert len(english(word)) <= len(word) + 1


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return df.select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("store"), "text")


@pytest.fixture(scope="module")
def english_index(spark, docs):
    return TextIndex.build(docs, scratch_path(spark, "texts"))


def scanned(rows, query, k, stem):
    """store -> [(id, rank)] by reading every text."""
    found = {}
    for i, store, text in rows:
        terms = [(at, stem(w)) for at, w in enumerate(re.findall("[a-z0-9]+", (text or "").lower())) if w not in keyword.STOP_WORDS]
        line = " " + " ".join(t for _, t in terms) + " "
        has = lambda p: " " + " ".join(p) + " " in line
        if not any(all(has(p) for p in branch) for branch in query.any_of) or any(has(p) for p in query.none_of):
            continue
        wanted, rank, before = set(query.words()), 0.0, None
        for at, t in terms:
            if t in wanted:
                rank += 1.0 if before is None else 1 / (at - before)
                before = at
        found.setdefault(store, []).append((-round(rank, 9), i))
    return {s: [(i, -r) for r, i in sorted(x)[:k]] for s, x in found.items()}


def shown(df):
    out = {}
    for r in df.orderBy("store", F.col("rank").desc(), "id").collect():
        out.setdefault(r["store"], []).append((r["id"], round(r["rank"], 9)))
    return out


QUESTIONS = ["apache licenses", "licensing", '"apache license"', "the license or idiot", "license -apache", 'version "apache license" or moron', "the", "nosuchword", "nosuchword or license", "-license", "and the", ""]


@pytest.mark.parametrize("question", QUESTIONS)
@pytest.mark.parametrize("k", [3, 50])
def test_search_equals_a_scan(english_index, docs, question, k):
    rows = [tuple(r) for r in docs.collect()]
    assert shown(english_index.search(question, k)) == scanned(rows, english_index.parse(question), k, english)


def test_frequent_words_of_the_texts(english_index, docs):
    """Words that most texts have, one by one and together."""
    counts = english_index.postings().groupBy("term").count().orderBy(F.col("count").desc(), "term").limit(4).collect()
    words = [r["term"] for r in counts]
    rows = [tuple(r) for r in docs.collect()]
    for question in [words[0], " ".join(words[:2]), f"{words[1]} or {words[2]} -{words[3]}"]:
        query = english_index.parse(question)
        assert shown(english_index.search(question, 5)) == scanned(rows, query, 5, english)


def test_blocks_that_cannot_enter_are_skipped(spark, monkeypatch):
    """Small blocks, one of them with long texts: the others can't reach the threshold and aren't read."""
    monkeypatch.setattr(text_index, "BLOCK_DOCUMENTS", 4)
    monkeypatch.setattr(text_index, "FIRST_BLOCKS", 2)
    rows = [(i, "s", "word " * (200 if i < 3 else 1 + i % 3) + f"other{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "chunk_id long, store string, text string")
    index = TextIndex.build(df, scratch_path(spark, "texts"))
    told = index.read_for("word", 2)
    assert told["may match"] > 50 and told["read"] <= 5
    assert shown(index.search("word", 2)) == scanned(rows, index.parse("word"), 2, english)
    # A rare word names few blocks at all.
    assert index.read_for("word other17", 2)["may match"] <= 2
    assert shown(index.search("word other17", 2)) == scanned(rows, index.parse("word other17"), 2, english)


def test_only_the_columns_of_bounds_are_read(english_index):
    plan = english_index.bounds(english_index.parse("apache license"))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<term:string,store:string,block:bigint,top:int>" in plan and "In(term, [apach,licens])" in plan


def test_added_texts_and_light_stems(spark, docs):
    index = TextIndex.build(docs.where("chunk_id % 3 <> 1"), scratch_path(spark, "texts"), analyser="light")
    index.add(docs.where("chunk_id % 3 = 1"))
    again = TextIndex(spark, index.path)
    got = again.search("apache licenses", 20).select(F.col("store"), F.col("id"), F.round("rank", 9).alias("rank"), F.round("distance", 9).alias("distance"))
    want = keyword.search(docs, "apache licenses", 20).select("store", F.col("chunk_id").alias("id"), F.round("rank", 9).alias("rank"), F.round("distance", 9).alias("distance"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_nulls_blanks_and_repeated_ids(spark):
    clash = {c: F.lit("clash") for c in ("term", "block", "docs", "n", "top", "id", "positions")}
    rows = [("a", None, "one word"), ("b", "s", None), ("c", "s", ""), ("d", "s", "word " * 5000), ("e", "s", "WORD, word!"), ("a", "s", "a word")]
    df = spark.createDataFrame(rows, "chunk_id string, store string, text string").withColumns(clash)
    index = TextIndex.build(df, scratch_path(spark, "texts"))
    assert shown(index.search("words", 5).orderBy("id")) == {None: [("a", 1.0)], "s": [("d", 5000.0), ("e", 2.0), ("a", 1.0)]}
    with pytest.raises(ValueError):
        TextIndex.build(df.unionByName(df.limit(1)), scratch_path(spark, "texts"))
    empty = TextIndex.build(df.limit(0), scratch_path(spark, "texts"))
    assert empty.search("word", 5).count() == 0


def test_no_posting_is_shuffled(spark, docs):
    """Texts are added in one stage: postings are stored by the tasks that read the texts."""
    index = TextIndex.build(docs.limit(0), scratch_path(spark, "texts"))
    context = spark.sparkContext
    context.setJobGroup("added-texts", "")
    try:
        index.add(docs)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup("added-texts") for s in tracker.getJobInfo(j).stageIds]
    assert len(stages) == 1
    assert index.postings().count() == keyword.postings(docs, "store", "chunk_id", "text", english).count()


def test_small_segments_lose_nothing(spark, docs, monkeypatch):
    """Many segments a task: each posting is stored once, terms are in order, and a document has one block of few documents."""
    monkeypatch.setattr(text_index, "BLOCK_DOCUMENTS", 30)
    monkeypatch.setattr(text_index, "SEGMENT_BYTES", 200_000)
    rows = docs.withColumn("store", F.when(F.col("store") != "fr", F.col("store")))
    index = TextIndex.build(rows, scratch_path(spark, "texts"), analyser="light")
    stored = index._read()
    each = stored.select("store", "term", "block", "top", F.explode("docs").alias("d")).select("*", "d.*")
    same = ["store", "term", "id", "positions", "ordinals"]
    want = keyword.postings(rows, "store", "chunk_id", "text")
    assert each.select(same).exceptAll(want.select(same)).count() == 0 == want.select(same).exceptAll(each.select(same)).count()
    assert stored.groupBy("store", "term", "block").count().where("count > 1").count() == 0
    assert each.where(F.col("top") < F.size("positions")).count() == 0 == stored.where(F.col("top") > F.array_max(F.transform("docs", lambda d: F.size(d["positions"])))).count()
    assert each.groupBy("id").agg(F.count_distinct("block").alias("n")).where("n > 1").count() == 0
    blocks = each.groupBy("block").agg(F.count_distinct("id").alias("n")).agg(F.max("n"), F.count(F.lit(1))).first()
    assert blocks[0] <= 30 and blocks[1] > 30


def test_a_search_reads_the_pages_of_its_terms(english_index):
    """Every file has all terms, in order: of the stored rows only those in the pages of a term are read for it, wherever it stands."""
    every = english_index._read().count()
    names = [r["term"] for r in english_index._read().select("term").distinct().orderBy("term").collect()]
    for term in [names[0], "apach", "licens", names[len(names) // 2], names[-1]]:
        found = english_index._read([term]).select("block", "docs")
        assert found.collect()
        scan = found._jdf.queryExecution().executedPlan().collectLeaves().head()
        read = scan.metrics().apply("numOutputRows").value()
        assert 0 < read <= every // 4, (term, read, every)

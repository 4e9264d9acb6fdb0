"""The pipeline's stages, each against a brute-force reading of its own input."""

import re
from collections import defaultdict

import corpus_pipeline
import pytest
from gridfolio.llm import packing

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / "x")
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_all_but_the_last_return_documents(staged):
    for _, before, after in staged[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes and ids(after) <= ids(before)


def test_toxic_documents_go(spark, staged):
    _, before, after = staged[0]
    toxic = re.compile(r"\b(idiot|moron|scum|loser|stupid|trash|clown|pathetic|worthless|disgusting)\b", re.I)
    gone = before.join(after, "doc_id", "left_anti").collect()
    assert gone and sum(bool(toxic.search(r["text"])) for r in gone) >= 0.95 * len(gone)
    assert not [r for r in after.collect() if toxic.search(r["text"])]


def test_one_of_each_exact_copy_stays(staged):
    _, before, after = staged[1]
    groups = defaultdict(list)
    for r in before.collect():
        groups[re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")].append((-len(r["text"] or ""), r["doc_id"]))
    assert ids(after) == {min(g)[1] for g in groups.values()}


def test_one_of_each_near_copy_stays(staged):
    _, before, after = staged[2]
    sets = {}
    for r in before.collect():
        w = re.findall(r"\w+", r["text"].lower())
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    where = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            where[x].add(i)
    for i, s in sets.items():
        for j in {j for x in s for j in where[x] if j < i}:
            if 5 * len(s & sets[j]) >= 4 * len(s | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    assert ids(after) == {find(i) for i in sets}


def test_benchmark_passages_go(spark, staged):
    _, before, after = staged[3]
    norm = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    items = [norm(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {r["doc_id"] for r in before.collect() if any(f" {x} " in f" {norm(r['text'])} " for x in items)}
    assert leaks and not leaks & ids(after) and len(ids(before) - ids(after) - leaks) <= 0.02 * before.count()


def test_all_that_stays_is_packed(staged):
    _, before, after = staged[4]
    assert ids(after) == ids(before)
    counts = defaultdict(int)
    for r in after.collect():
        counts[r["length"]] += 1
    assert after.select("sequence_id").distinct().count() <= packing.lower_bound(counts, 4096) + 1


def test_stages_take_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_stages_take_nasty_documents(spark, nasty):
    docs = nasty.select("doc_id", "text", "lang", "source", "n_chars", "rank", "score")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns and after.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count()

"""Language identification and toxicity: held-out accuracy, methods and edge cases."""

import numpy as np
import pytest
from gridfolio.llm import language, toxicity
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


@pytest.fixture(scope="module")
def model():
    return language.train([("the cat and the dog are in the house with them", "en"), ("le chat et le chien sont dans la maison avec eux", "fr"), ("это кошка и собака в доме", "ru")] * 20)


def test_spans_follow_the_text(spark, model):
    df = spark.createDataFrame([(1, "the dog and the cat in the house le chien et le chat dans la maison avec eux"), (2, "собака в доме"), (3, None), (4, "12 34 !?"), (5, "漢字")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language.spans(df, model).collect()}
    assert [s["lang"] for s in got[1]["spans"]] == ["en", "fr"] and [s["words"] for s in got[1]["spans"]] == [8, 10]
    assert got[2]["lang_pred"] == "ru" and got[2]["score"] == 1
    assert got[3]["lang_pred"] == got[4]["lang_pred"] == "und" and got[3]["score"] == 0
    assert got[5]["lang_pred"] in model.langs


def test_script_narrows_candidates(model):
    points, starts, _ = language.codes(["кот cat"])
    scores = model.word_scores(points, starts)
    assert scores[0].argmax() == model.langs.index("ru") and scores[0, model.langs.index("en")] == -language.WORST


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=6), st.integers(0, 2**32 - 1))
def test_viterbi_is_optimal(lengths, seed):
    rng = np.random.default_rng(seed)
    lengths = np.array([min(n, 5) for n in lengths])
    scores = rng.normal(size=(int(lengths.sum()), 3)).astype(np.float32)
    label = language.viterbi(scores, lengths, 1.0)
    value = lambda s, path: sum(s[i, k] for i, k in enumerate(path)) - sum(a != b for a, b in zip(path, path[1:]))
    at = 0
    for n in lengths:
        own = scores[at : at + n]
        best = max((value(own, p) for p in np.ndindex(*[3] * int(n))), default=0)
        assert value(own, label[at : at + n].tolist()) == pytest.approx(best, abs=1e-4)
        at += n


def test_language_edges(nasty, none):
    got = language.identify(nasty).collect()
    assert len(got) == nasty.count() and {r["lang_pred"] for r in got if r["doc_id"] in (3, 4, 5)} == {"und"}
    assert all(r["held_out"] is not None for r in got)
    assert language.identify(none).count() == 0
    assert language.identify(nasty.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect() == [("und",)]


def brute_distance(a, b):
    """Edits with swaps of neighbours, by the full table."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", min_size=3, max_size=10), min_size=1, max_size=6), st.text("abcd", max_size=11))
def test_automaton_finds_what_edit_distance_finds(terms, word):
    terms = sorted(set(terms))
    got = toxicity.LexiconAutomaton(terms, []).match(word)
    want = min(((d, t) for t in terms if (d := brute_distance(t, word)) <= toxicity.edits(len(t))), default=None)
    assert got == (want and (want[1], want[0]))


def test_stems_accept_any_ending():
    a = toxicity.LexiconAutomaton(["idiot"], ["lowei"])
    assert a.match("loweischaft") == ("lowei*", 0) and a.match("lowe") is None and a.match("idjot") == a.match("idoit") == ("idiot", 1)


def test_misspelt_stems_and_short_terms():
    a = toxicity.LexiconAutomaton(["scum"], ["lowei"])
    assert a.match("loewischaft") == a.match("loweschaft") == a.match("lwei") == ("lowei*", 1) and a.match("lowxyschaft") is None
    assert a.match("scumm") == a.match("skum") == a.match("sucm") == ("scum", 1) and a.match("skumm") is None


def test_an_ordinary_neighbour_does_not_make_a_term_exact():
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("bdfgkpv"), 5)) + str(rng.choice(["a", "e", "i"]))
    line = lambda *more: " ".join([*(word() for _ in range(15)), *more, *(word() for _ in range(15))])
    rows = [(line("oron") if i % 2 else line(), 0) for i in range(300)] + [(line(("moron", "scum")[i % 2]), 1) for i in range(60)]
    s = toxicity.Scorer(toxicity.train(rows))
    p = lambda t: s.score(s.hits(t))
    assert p("an oron here") < 0.5
    assert all(p(f"you are a {w}") > 0.5 for w in ("moron", "morron", "mroon", "scum", "scumm", "skum"))


@pytest.fixture(scope="module")
def toxic_model():
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("lmnprst"), 4)) + str(rng.choice(["a", "o", "u"]))
    clean = [(" ".join(word() for _ in range(40)), 0) for _ in range(300)]
    bad = [(" ".join([word() for _ in range(20)] + [str(rng.choice(["idiot", "disgusting"]))] + [word() for _ in range(20)]), 1) for _ in range(80)]
    return toxicity.train(clean + bad)


def test_misspellings_and_quotations(toxic_model):
    s = toxicity.Scorer(toxic_model)
    p = lambda t: s.score(s.hits(t))
    assert toxic_model.terms == ["disgusting", "idiot"]
    assert p("you are an idiot") > 0.5 and p("you are an idjot, you know") > 0.5 and p("so disgsting, you") > 0.5
    assert p("a plain text") < 0.1 and p("what an idoit, 1d10t and idiooot") > 0.5
    assert p('they wrote the word "idiot" in a quote') < 0.5 < p("you are an idiot")


@pytest.mark.parametrize(
    ("text", "inside"),
    [
        ("he said: «x idiot y»", True), ("he said \"you idiot\".", True), ("'idiot' he said", True), ("“idiot”", True), ("„idiot“ sagte er", True),
        ("I don't care you are an idiot and it's known", False), ("\"a quote\" you idiot \"another\"", False), ("\"Stop.\" you idiot", False), ("idiot", False), ("the dogs' idiot, the cats' way", False),
    ],
)
def test_quotation_marks_are_paired(text, inside):
    at = text.index("idiot")
    assert toxicity.quoted(text, at, at + 5) == inside


def test_apostrophes_are_no_quotation(toxic_model):
    s = toxicity.Scorer(toxic_model)
    p = lambda t: s.score(s.hits(t))
    assert p("I don't care you are an idiot and it's known") > 0.5 and p("you are an idiot and everyone knows") > 0.5
    assert p('he said "you idiot" and left') < 0.5


def test_automaton_forgets_states(monkeypatch):
    monkeypatch.setattr(toxicity, "STATES", 50)
    a = toxicity.LexiconAutomaton(["disgusting", "worthless"], [])
    rng = np.random.default_rng(1)
    for _ in range(300):
        a.match("".join(rng.choice(list("abcdegorst"), 9)))
        assert len(a.states) < 200
    assert a.match("disgustng") == ("disgusting", 1)


def test_the_sample_is_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda rows: seen.extend(rows) or toxicity.ToxicityModel())
    docs = spark.range(400).selectExpr("id % 40 AS doc_id", "repeat(concat('w', id, ' '), 50) AS text")
    labels = spark.range(40).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS toxic")
    toxicity.fit(docs, labels, rows=40)
    assert len(seen) <= 100
    seen.clear()
    toxicity.fit(docs, labels, rows=10**6, chars=20_000)
    assert 0 < sum(len(t) for t, _ in seen) < 40_000
    seen.clear()
    toxicity.fit(docs.unionAll(docs), labels, rows=10**6)
    assert len(seen) == 400


def test_toxicity_precision_and_recall():
    """Fitted and held out as the query does, on more rows. Of the toxic rows 6 in 100 hold no term that any other has."""
    import zlib

    import pyarrow.parquet as pq

    big = SF.replace("0.01", "0.1")
    docs = pq.read_table(f"{big}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    text = dict(zip(docs["doc_id"], docs["text"], strict=True))
    labels = pq.read_table(f"{big}/labels.parquet").to_pydict()
    rows = [(text[i], y, zlib.crc32(str(i).encode()) % 5 == 0) for i, y in zip(labels["doc_id"], labels["toxic"], strict=True) if i in text]
    s = toxicity.Scorer(toxicity.train([(t, y) for t, y, out in rows if not out]))
    got = [(s.score(s.hits(t or "")) >= 0.5, y) for t, y, out in rows if out]
    caught, right = sum(p for p, y in got if y), sum(p for p, y in got)
    assert caught / right >= 0.97 and caught / sum(y for _, y in got) >= 0.9


def test_copies_make_no_lexicon():
    text = "these are some ordinary words of one text that was copied often"
    assert toxicity.train([(text, 1)] * 60 + [(f"other text number {i}", 0) for i in range(300)]).terms == []


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    hit = [(r["predicted"], r["toxic"]) for r in rows]
    assert sum(a == b for a, b in hit) / len(hit) > 0.93


def test_toxicity_edges(spark, nasty, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (8, None), (6, 0)], "doc_id long, toxic int")
    got = toxicity.classify(nasty, labels).collect()
    assert len(got) == nasty.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] is not None for r in got) and not [r for r in got if r["doc_id"] is None and r["held_out"]]
    assert toxicity.classify(none, labels).count() == 0
    empty = spark.createDataFrame([], labels.schema)
    assert toxicity.classify(nasty, empty).count() == nasty.count()
    assert toxicity.keep_clean(nasty, toxicity.ToxicityModel()).columns == nasty.columns


def test_language_sample_is_bounded_whatever_the_ids(spark, monkeypatch):
    """Two thirds of the rows share an id, others repeat one text, and some are long: the sample stays within its bounds."""
    rows = [(7 if i % 3 else i, f"text number {i} of many in one tongue", "en") for i in range(6000)] + [(i, "the same words again", "de") for i in range(3000)]
    rows += [(i, f"long text {i} " * 2000, "fr") for i in range(40)] + [(None, None, "en"), (1, "no language", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = []
    monkeypatch.setattr(language, "train", got.extend)
    language.fit(df, documents=50, chars=200_000)
    by = {lang: [t for t, x in got if x == lang] for lang in ("en", "de", "fr")}
    assert 20 <= len(by["en"]) <= 100 and len(by["de"]) <= 1 and sum(map(len, by["fr"])) <= 2 * 200_000
    assert len(got) == len(set(got))

"""Fill-in-middle, piece encoding and hard negatives against brute force, the library and SQL."""

import hashlib
import re

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from gridfolio.llm import fim, hard_negatives, piece_bpe, queries
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

PIECE = public_tokenizers.path("piece_bpe_32k.model")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def key(row):
    return tuple((x is None, 0 if x is None else x) for x in row)


def drawn(doc_id):
    digest = sha(f"1:{'' if doc_id is None else doc_id}")
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def cut(text, h):
    """n, form, prefix_chars, middle_chars and output of one text, by its tokens."""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    spm = h[3] % 100 < 20
    return n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_equals_brute_force(nasty, small):
    for docs in (nasty, small):
        got = sorted(map(tuple, fim.digests(fim.fill_in_middle(docs)).collect()), key=key)
        want = []
        for r in docs.collect():
            *head, out = cut(r["text"] or "", drawn(r["doc_id"]))
            want.append((r["doc_id"], *head, sha(out), sha(r["text"] or "")))
        assert got == sorted(want, key=key)


MARKED = st.text(alphabet=st.characters(codec="utf-8"), max_size=30) | st.text("aB <PSM>é漢\n", max_size=30)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(MARKED, st.lists(st.integers(0, 2**32 - 1), min_size=4, max_size=4)), min_size=1, max_size=6))
def test_the_kernel_takes_all_rows_together(rows):
    data, offsets = fim.text_buffers(pa.array([t for t, _ in rows]))
    n, form, prefix, middle, out, ends = fim.transform(data, offsets, np.array([h for _, h in rows]), 10, 20)
    texts = fim.string_array(out, ends).to_pylist()
    for i, (text, h) in enumerate(rows):
        kind = fim.FORMS[int(form[i])].as_py()
        chars = (None, None) if kind == "plain" else (prefix[i], middle[i])
        assert (n[i], kind, *chars, texts[i]) == cut(text, h)


def test_texts_come_back_from_their_outputs(spark):
    texts = ["<", "<P", "P>", "a<S", "S>b", "<<M", "<P<S<M", "x>y<z", "<M>", "a b <S> c"]
    docs = spark.createDataFrame([(100 * k + i, t) for k in range(30) for i, t in enumerate(texts)], "doc_id long, text string")
    made = fim.fill_in_middle(docs).join(docs, "doc_id")
    assert made.where(fim.restored(F.col("output"), F.col("form")) != F.col("text")).count() == 0
    assert {r["form"] for r in made.select("form").distinct().collect()} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_nothing(none):
    assert fim.fill_in_middle(none).count() == 0


def test_chunks_cover_all_rows():
    offsets = np.array([0, 0, 5, 5, 30, 31, 31])
    for limit in (1, 4, 10, 100):
        got = list(fim.chunks(offsets, limit))
        assert [x for lo, hi in got for x in range(lo, hi)] == list(range(6))


@pytest.fixture(scope="module")
def own():
    return piece_bpe.PieceModel(PIECE)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECE)


def encoded(own, texts):
    ids, ends = own.encode(*fim.text_buffers(pa.array(texts, pa.string())))
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)], ids, ends


def decoded(own, ids, ends):
    data, upto = own.decode(ids, ends)
    return fim.string_array(data, upto).to_pylist()


def same_as_library(own, library, texts):
    got, ids, ends = encoded(own, texts)
    assert got == library.encode(texts, add_eos=True)
    assert decoded(own, ids, ends) == library.decode(got)


TEXT = st.text(alphabet=st.characters(codec="utf-8"), max_size=60) | st.text("aabthe in\n ▁é漢", max_size=60) | st.text(" ▁", max_size=40)


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6))
def test_ids_and_texts_are_the_librarys(texts):
    same_as_library(piece_bpe.model(PIECE), sentencepiece.SentencePieceProcessor(model_file=PIECE), texts)


@pytest.mark.parametrize(
    "text",
    ["", " ", "▁", "a\0b", "<s></s><unk><0x41>", "x" * 5000, " " * 3000, " " * 700, "ab" * 2000, "漢字かな" * 500, "\U0001f600" * 300, "a" + " " * 700 + "b", "-" * 999 + "=" * 998, "ａ＃﻿​"],
)
def test_special_and_long_words(own, library, text):
    same_as_library(own, library, [text, "b", text])


def test_equal_words_with_one_hash_are_told_apart(own, library, monkeypatch):
    # All words share a hash: no word may be taken for another.
    monkeypatch.setattr(piece_bpe.pd, "factorize", lambda h: (np.zeros(len(h), np.int64), h[:1]))
    same_as_library(own, library, ["some words of different length", "and same same"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([0, 1, 2, 28705, 259, 28789]) | st.integers(3, 258) | st.integers(0, 31_999), max_size=8), max_size=5))
def test_any_ids_decode_as_in_the_library(lists):
    ids = np.array([i for x in lists for i in x], dtype=np.int32)
    ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    assert decoded(piece_bpe.model(PIECE), ids, ends) == [library.decode(x) for x in lists]


def test_round_trip_of_documents(nasty, small, library):
    for docs in (nasty, small):
        got = sorted(map(tuple, piece_bpe.digests(piece_bpe.encode(docs, PIECE), PIECE).collect()), key=key)
        want = []
        for r in docs.collect():
            ids = library.encode(r["text"] or "", add_eos=True)
            want.append((r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
        assert got == sorted(want, key=key)


def test_decoding_keeps_other_columns_and_nulls(spark, none):
    rows = spark.createDataFrame([(1, [259, 2], "x"), (2, None, "y"), (3, [], None)], "doc_id long, ids array<int>, `text_too` string")
    assert [(r["doc_id"], r["text_too"], r["text"]) for r in piece_bpe.decode(rows, PIECE).orderBy("doc_id").collect()] == [(1, "x", " "), (2, "y", None), (3, None, "")]
    assert piece_bpe.decode(piece_bpe.encode(none, PIECE), PIECE).count() == 0


def test_other_models_are_refused(tmp_path):
    raw = open(PIECE, "rb").read()
    # A normaliser that removes blanks: field 4 of field 3 set to 1.
    assert raw.count(b"\x18\x01\x20\x00") == 1
    other = tmp_path / "other.model"
    other.write_bytes(raw.replace(b"\x18\x01\x20\x00", b"\x18\x01\x20\x01"))
    with pytest.raises(ValueError):
        piece_bpe.PieceModel(str(other))


def negatives_by_sql(df, tmp_path):
    df.select("vec_id", "embedding", "label").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "e"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    return sorted(c.execute(queries.ORACLE_SQL["op13_hard_negatives"]).fetchall(), key=key)


def vectors(spark, n, hot, seed, ids=400):
    """Rows with nulls, repeated ids, few different vectors and a vector that ``hot`` of them share."""
    r = np.random.default_rng(seed)
    common, few = [0.3, -0.2, 0.5], r.uniform(-1, 1, (20, 3)).round(2).tolist()
    rows = []
    for _ in range(n):
        v = common if r.random() < hot else few[r.integers(20)] if r.random() < 0.5 else r.uniform(-1, 1, 3).tolist()
        rows.append((None if r.random() < 0.02 else int(r.integers(0, ids)), None if r.random() < 0.02 else v, None if r.random() < 0.05 else int(r.choice([0, 1, 3, 3, 3]))))
    rows += [(50, [float("nan"), 1.0, 2.0], 1), (100, [1.0, None, 2.0], 1), (150, [float("inf"), 1.0, 2.0], 1), (-50, [0.5, 0.5, 0.5], 3), (0, [0.0, 0.0, 0.0], 3)]
    clash = {c: F.lit("clash") for c in ("row", "v", "window", "digit", "n", "rank", "anchor_id", "positive_id", "score", "before")}
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns(clash)


@pytest.mark.parametrize(("n", "hot", "seed", "group"), [(40, 0.0, 1, 4096), (600, 0.0, 2, 3), (2500, 0.4, 3, 4096), (1500, 0.95, 4, 7)])
def test_hard_negatives_equal_all_comparisons(spark, tmp_path, n, hot, seed, group):
    df = vectors(spark, n, hot, seed)
    got = sorted(map(tuple, hard_negatives.mine(df, group=group).collect()), key=key)
    assert got == negatives_by_sql(df, tmp_path)


def test_ties_cost_digits_of_the_id(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hard_negatives, "SLACK", 1)
    df = vectors(spark, 1200, 0.8, 5, ids=2**40)
    df = df.withColumn("vec_id", F.when(F.rand(1) < 0.02, F.col("vec_id") - F.col("vec_id") % 50).otherwise(F.col("vec_id")))
    assert sorted(map(tuple, hard_negatives.mine(df).collect()), key=key) == negatives_by_sql(df, tmp_path)


def test_hard_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(empty).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(50, [1.0], 1), (51, None, 1)], empty.schema)).count() == 0


def test_products_are_exact():
    r = np.random.default_rng(1)
    a, b = r.integers(-(2**30), 2**30, (5, 8)), r.integers(-(2**30), 2**30, (6, 8))
    assert hard_negatives.products(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]
    assert (hard_negatives.products(a % 256, b % 256) == (a % 256) @ (b % 256).T).all()

"""Packing, token counts and decontamination against the libraries and brute force."""

import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from gridfolio.llm import decontamination, packing, token_counts
from gridfolio.llm.text import words
from gridfolio.session import scratch_path
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def texts(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]


def test_pieces_are_the_librarys(nasty, small):
    own = Tokenizer.from_file(WORD)
    for df in (nasty, small):
        got = sorted(str((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])) for r in packing.cut(df, WORD).collect())
        want = []
        for i, t in texts(df):
            ids = np.array([*own.encode(t, add_special_tokens=False).ids, 1], dtype="<u4")
            want += [str((i, k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes()))) for k, s in enumerate(range(0, len(ids), 4096))]
        assert got == sorted(want)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60) | st.text("ab'sdt1 <|>endoftx\n", max_size=60))
def test_encoder_equals_the_library(text):
    own = packing.encoder(WORD)
    assert own.encode([text])[0] == np.array(own.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "İstanbul ΣΑΣ ß", "don't 12½ naïve…", "é", "\x1c\x85", "漢字"])
def test_encoder_special_cases(text):
    own = packing.encoder(WORD)
    assert own.encode([text])[0] == np.array(own.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def brute_bins(sizes, capacity):
    """The fewest bins, by trying for each item every bin so far and a new one."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity and bins[k] not in bins[:k]:
                place(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_small_instances_are_optimal(sizes):
    patterns = packing.solve(dict(Counter(sizes)), 20)
    used = Counter()
    for p, n in patterns:
        assert sum(p) <= 20
        for s in p:
            used[s] += n
    assert used == Counter(sizes) and sum(n for _, n in patterns) == brute_bins(sizes, 20)


def check_packing(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_is_gapless_and_tight(nasty, small, none):
    for df in (nasty, small):
        rows = packing.pack_documents(df, WORD).collect()
        n = check_packing(rows, 4096)
        counts = Counter(r["length"] for r in rows)
        assert n <= packing.lower_bound(counts, 4096) + 1
    assert packing.pack_documents(none, WORD).count() == 0


def test_packing_of_many_equal_lengths(spark):
    pieces = spark.range(9000).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "CASE WHEN id < 7000 THEN 1000L ELSE 96L END AS length", "id AS ids_crc32")
    rows = packing.pack(pieces).collect()
    assert len(rows) == 9000 and check_packing(rows, 4096) == packing.lower_bound({1000: 7000, 96: 2000}, 4096)


@pytest.mark.parametrize(("n", "bins"), [(1, 3), (8, 24), (50, 150), (1000, 3000), (100_000, 300_000)])
def test_search_does_not_end_with_the_size(n, bins):
    counts = {k: m * n for k, m in Counter([2720, 1190, 2550, 510, 1020, 2380, 850, 850]).items()}
    patterns = packing.solve(counts)
    used = Counter()
    for p, times in patterns:
        assert sum(p) <= 4096
        used.update({s: m * times for s, m in Counter(p).items()})
    assert used == Counter(counts) and sum(times for _, times in patterns) == bins


@pytest.mark.parametrize("counts", [{1: 5000}, {1: 5000, 4000: 3}, {1: 3000, 3: 4000, 2000: 10}, {1: 10**7}])
def test_sequences_of_very_many_short_pieces(counts):
    patterns = packing.solve(counts)
    used = Counter()
    for p, n in patterns:
        assert sum(p) <= 4096
        used.update({s: m * n for s, m in Counter(p).items()})
    assert used == Counter(counts) and sum(n for _, n in patterns) == packing.lower_bound(counts, 4096)


def test_sixty_pieces_and_equal_lengths_end_at_the_bound():
    rng = np.random.default_rng(1)
    for _ in range(20):
        counts = dict(Counter(rng.integers(50, 211, 60).tolist()))
        assert sum(n for _, n in packing.solve(counts)) == packing.lower_bound(counts, 4096)
    for counts in ({1366: 9000}, {1365: 9000}, {3: 10**5}, {4096: 7, 1: 10**5}, {1: 10**10, 2000: 10**9}):
        assert sum(n for _, n in packing.solve(counts)) == packing.lower_bound(counts, 4096)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=12))
def test_the_bound_is_one(sizes):
    assert packing.lower_bound(dict(Counter(sizes)), 20) <= brute_bins(sizes, 20)


def test_ranks_run_on_over_blocks_of_salts(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_SALT", 10)
    monkeypatch.setattr(packing, "SALTS_PER_BLOCK", 3)
    pieces = spark.range(2000).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "IF(id < 1700, 900L, 77L) AS length", "id AS ids_crc32")
    assert check_packing(packing.pack(pieces).collect(), 4096) == packing.lower_bound({900: 1700, 77: 300}, 4096)


def test_words_that_share_a_hash_are_told_apart(monkeypatch):
    own = packing.PieceEncoder(WORD)
    own.factors = np.ones(64, dtype=np.uint64)
    for text in ("stop pots tops spot", "stop", "pots"):
        assert own.encode([text])[0] == np.array(own.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_words_are_forgotten_in_bounds(monkeypatch):
    monkeypatch.setattr(packing, "KEPT_WORDS", 5)
    own = packing.PieceEncoder(WORD, limit=12)
    for k in range(6):
        text = " ".join(f"word{chr(97 + i)}x" for i in range(k, k + 9))
        assert own.encode([text])[0] == np.array(own.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert len(own.number) <= 5 + 9
        own.keep(5)
        assert len(own.number) <= 5


def test_other_vocabularies_go_through_the_library():
    own = packing.PieceEncoder(BYTE)
    assert not own.known and own.encode(["Some text"])[0] == np.array(own.tokenizer.encode("Some text", add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_completion_wastes_least():
    rng = np.random.default_rng(3)
    for _ in range(200):
        counts = Counter(rng.integers(2, 40, rng.integers(1, 9)).tolist())
        room = int(rng.integers(1, 90))
        sums = {0}
        for k in counts.elements():
            sums |= {x + k for x in sums if x + k <= room}
        got = packing.completion(sorted(counts), dict(counts), room)
        assert not Counter(got) - counts and sum(got) == max(sums)


def test_several_thousand_empty_texts(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN '' WHEN id % 1000 = 1 THEN repeat('some words ', 300) END AS text")
    rows = packing.pack_documents(docs, WORD).collect()
    assert len(rows) == 6000 and check_packing(rows, 4096) == packing.lower_bound(Counter(r["length"] for r in rows), 4096)


def test_token_counts_and_cache(spark, nasty, small, none):
    own = Tokenizer.from_file(BYTE)
    cache = scratch_path(spark, "cache-test")
    for df in (nasty, small, nasty):
        got = sorted(str((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"])) for r in token_counts.count_tokens(df, BYTE, cache).collect())
        counted = [(i, len(t.encode()), len(own.encode(t, add_special_tokens=False).ids)) for i, t in texts(df)]
        assert got == sorted(str((i, b, n, n > 1024)) for i, b, n in counted)
    stored = token_counts.read_cache(spark, cache)
    assert stored.count() == stored.select("content_digest").distinct().count() == len({t for df in (nasty, small) for _, t in texts(df)})
    assert token_counts.count_tokens(none, BYTE, cache).count() == 0


def test_cache_is_trusted_and_versioned(spark):
    cache = scratch_path(spark, "cache-test")
    df = spark.createDataFrame([(1, "some text"), (2, "<|endoftext|>")], "doc_id long, text string")
    token_counts.count_tokens(df, BYTE, cache).collect()
    one = token_counts.read_cache(spark, cache).where("n_tokens = 1").withColumn("n_tokens", token_counts.F.lit(77).cast("long"))
    other = scratch_path(spark, "cache-test")
    one.write.parquet(other)
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(df, BYTE, other).collect()} == {1: 2, 2: 77}
    model = public_tokenizers.path("piece_bpe_32k.model")
    assert token_counts.tokenizer_digest(model) != token_counts.tokenizer_digest(BYTE)
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(df, model, other).collect()}[1] == 2


def brute_overlap(a, b):
    """Whether some alignment without gaps has a long enough window with enough equal tokens."""
    least = min(decontamination.MIN_TOKENS, len(b))
    for shift in range(-len(b) + 1, len(a)):
        lo, hi = max(0, -shift), min(len(b), len(a) - shift)
        same = np.array([a[k + shift] == b[k] for k in range(lo, hi)])
        for n in range(least, hi - lo + 1):
            if any(10 * int(same[k : k + n].sum()) >= 8 * n for k in range(hi - lo - n + 1)):
                return True
    return False


def substitutions(n):
    """All placements of the substituted tokens that an overlap of n tokens may have, as bit sets."""
    return np.array([sum(1 << i for i in c) for c in combinations(range(n), n // 5)], dtype=np.int64)


@pytest.mark.parametrize("n", range(3, 26))
def test_masks_hit_every_placement_of_substitutions(n):
    placed = substitutions(n)
    hit = np.zeros(len(placed), dtype=bool)
    for mask in decontamination.masks_of(n):
        own = sum(1 << i for i, bit in enumerate(mask) if bit == "1")
        for shift in range(n - len(mask) + 1):
            hit |= (placed & (own << shift)) == 0
    assert hit.all()


def test_decontamination_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vocab = [f"w{i}" for i in range(400)]
    items = [[str(rng.choice(vocab)) for _ in range(int(rng.integers(3, 40)))] for _ in range(25)]
    docs = []
    for k in range(120):
        body = [str(rng.choice(vocab)) for _ in range(60)]
        if k % 2:
            part = list(items[k % 25])
            for i in range(0, len(part), 9):
                part[i] = "swap"
            at = int(rng.integers(0, 60))
            body[at:at] = part
        docs.append((k, " ".join(body)))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.overlaps(df, bench).collect()}
    want = {(d, i) for d, t in docs for i, x in enumerate(items) if brute_overlap(words(t), x)}
    assert got == want
    assert decontamination.decontaminate(df, bench).count() == 120 - len({d for d, _ in got})
    for name in ("BROADCAST_SEEDS", "BROADCAST_ROWS"):
        monkeypatch.setattr(decontamination, name, 0)
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.overlaps(df, bench).collect()} == got
    assert decontamination.decontaminate(df, bench).count() == 120 - len({d for d, _ in got})


def test_the_text_decides_and_not_the_id(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight")], "item_id long, text string")
    bad = "so one two three four five six seven eight it is"
    rows = [(None, bad), (None, "a clean text without an id"), (3, bad), (3, "a clean text with the id of another"), (4, bad), (4, bad), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(map(str, ((r["doc_id"], r["text"]) for r in decontamination.decontaminate(df, bench).collect())))
    assert kept == sorted(map(str, [rows[1], rows[3], rows[6]]))
    assert decontamination.overlaps(df, bench).count() == 4


def test_decontamination_edges(spark, nasty, none):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (4, "lorem ipsum dolor sit amet lorem ipsum dolor sit amet lorem ipsum"), (None, "unique text number eight stands alone")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.overlaps(nasty, bench).collect()}
    assert got == {(6, 4), (7, 4), (8, None)}
    assert decontamination.overlaps(none, bench).count() == 0
    assert decontamination.overlaps(nasty, bench.limit(0)).count() == 0
    assert decontamination.decontaminate(nasty, bench).columns == nasty.columns

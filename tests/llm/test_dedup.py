"""Exact dedup, line dedup and the n-gram join against brute force, and their edge cases."""

import hashlib
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from gridfolio.llm import components, exact_dedup, line_dedup, ngram_join, text
from gridfolio.llm.text import words


def python_workers(df):
    return re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())


def brute_exact(rows):
    groups = defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    for i, t in rows:
        groups[norm(t)].append((i, t or ""))
    out = []
    for key, own in groups.items():
        keep = min(own, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))[0]
        out += [(i, keep, len(own), i == keep, hashlib.sha256(key.encode()).hexdigest()) for i, _ in own]
    return sorted(map(str, out))


def test_exact_matches_brute_force(nasty, small):
    for df in (nasty, small):
        got = [tuple(r) for r in exact_dedup.exact_duplicates(df).collect()]
        assert sorted(map(str, got)) == brute_exact([(r["doc_id"], r["text"]) for r in df.collect()])


def test_exact_is_native_and_empty(none, small):
    df = exact_dedup.exact_duplicates(small)
    assert not python_workers(df)
    assert exact_dedup.exact_duplicates(none).count() == 0


def test_exact_keeps_one_row_each(nasty):
    kept = exact_dedup.drop_exact_duplicates(nasty)
    assert kept.columns == nasty.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [2, 5, 6, 8, None, 9, 10]))


LOST = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (5, "one two three four five six seven eight nine ten"), (7, "quite another text that nobody else has ever written down here"), (None, "quite another text that nobody else has ever written down here"), (None, "a text that only rows without an id have so far"), (None, "a text that only rows without an id have so far")]


@pytest.mark.parametrize("keep", [exact_dedup.drop_exact_duplicates, ngram_join.keep_one])
def test_no_text_is_lost_for_its_id(spark, keep):
    df = spark.createDataFrame(LOST, "doc_id long, text string")
    kept = [tuple(r) for r in keep(df).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [LOST[0], LOST[2], LOST[3], LOST[5]]))
    blanks = spark.createDataFrame([(1, "a  b c"), (1, "a b c"), (1, None), (1, "")], "doc_id long, text string")
    left = [r["text"] or "" for r in keep(blanks).collect()]
    assert len(left) == 2 and "" in left and (keep is ngram_join.keep_one or "a  b c" in left)
    again = keep(df.unionAll(df))
    assert sorted(map(str, map(tuple, again.collect()))) == sorted(map(str, kept))


def test_hot_keys_are_joined_alike(spark, monkeypatch, small):
    want = {f.__name__: sorted(map(str, f(small).collect())) for f in (exact_dedup.exact_duplicates, ngram_join.near_duplicates)}
    monkeypatch.setattr(text, "HOT_ROWS", 1)
    for f in (exact_dedup.exact_duplicates, ngram_join.near_duplicates):
        assert sorted(map(str, f(small).collect())) == want[f.__name__]


def test_a_digest_of_two_contents_is_matched_by_content(nasty, monkeypatch):
    want = brute_exact([(r["doc_id"], r["text"]) for r in nasty.collect()])
    real = exact_dedup.F.sha2
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: exact_dedup.F.when(exact_dedup.F.length(c) % 2 == 0, "same").otherwise(real(c, n)))
    got = [tuple(r)[:4] for r in exact_dedup.exact_duplicates(nasty).collect()]
    assert sorted(map(str, got)) == sorted(x.rsplit(", ", 1)[0] + ")" for x in want)


def test_salts_do_not_change_the_result(small):
    a, b = (sorted(map(str, exact_dedup.exact_duplicates(small, salts=n).collect())) for n in (1, 7))
    assert a == b


def brute_links(rows):
    sets = defaultdict(list)
    for i, t in rows:
        w = words(t)
        sets[frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()].append(i)
    reps = {min(x for x in ids if x is not None): s for s, ids in sets.items() if any(x is not None for x in ids)}
    return {(a, b) for a, b in combinations(sorted(reps), 2) if reps[a] and reps[b] and 5 * len(reps[a] & reps[b]) >= 4 * len(reps[a] | reps[b])}


def edited(base, rng, n):
    w = list(base)
    for i in rng.choice(len(w), n, replace=False):
        w[i] = f"edit{rng.integers(10**9)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def near(spark):
    """Groups of near copies of different sizes and distances, above one block, with shared passages."""
    rng = np.random.default_rng(5)
    passage = [f"p{i}" for i in range(60)]
    rows, k = [], 0
    for size, n in ((300, 2), (40, 3), (5, 1), (2, 0), (12, 6)):
        base = [f"w{rng.integers(10**9)}" for _ in range(140)] + passage
        for _ in range(size):
            rows.append((k, edited(base, rng, int(rng.integers(0, n + 1)))))
            k += 1
    rows += [(k, None), (k + 1, ""), (k + 2, "one two"), (k + 3, "One, two!"), (None, "no id here")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_near_duplicates_lose_no_link(near):
    rows = [tuple(r) for r in near.collect()]
    links = brute_links(rows)
    got = {r["doc_id"]: r for r in ngram_join.near_duplicates(near).collect()}
    counts = defaultdict(int)
    for a, b in links:
        counts[a] += 1
        counts[b] += 1
    assert {i: r["n_links"] for i, r in got.items() if i is not None and r["copy_id"] == i and r["n_links"]} == dict(counts)
    up = {i: i for i in got}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    assert all(r["class_id"] == find(r["copy_id"]) for i, r in got.items() if i is not None)
    n = max(i for i in got if i is not None)
    assert got[n]["copy_id"] == n - 1 and got[n - 2]["copy_id"] == n - 3


def test_links_of_all_documents(spark):
    """On sf0.1, all documents against all others, through those that share a shingle."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    sets = {}
    for r in docs.toLocalIterator():
        w = words(r["text"])
        key = frozenset(hash(tuple(w[k : k + 5])) for k in range(max(1, len(w) - 4))) if w else frozenset()
        sets[r["doc_id"]] = key
    got = {r["doc_id"]: r for r in ngram_join.near_duplicates(docs).collect()}
    first = {key: min(i for i in ids) for key, ids in _by_value(sets).items()}
    where = defaultdict(list)
    for key, i in first.items():
        for x in key:
            where[x].append(i)
    n = found = 0
    for i in sorted(first.values()):
        if sets[i]:
            near = {j for x in sets[i] for j in where[x]} - {i}
            links = [j for j in near if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
            n += len(links)
            found += sum(got[i]["class_id"] == got[j]["class_id"] for j in links)
            assert got[i]["n_links"] <= len(links)
            n += len(links)
            found += got[i]["n_links"]
    assert n > 100 and found >= 0.99 * n, (n, found)


def _by_value(sets):
    out = defaultdict(list)
    for i, key in sets.items():
        out[key].append(i)
    return out


def test_near_duplicate_edges(nasty, none):
    got = ngram_join.near_duplicates(nasty).collect()
    assert len(got) == nasty.count()
    by = {r["doc_id"]: r for r in got}
    assert by[2]["class_id"] == 1 and by[7]["class_id"] == 6 and by[8]["n_copies"] == 2 and by[5]["copy_id"] == 3
    assert ngram_join.near_duplicates(none).count() == 0
    kept = ngram_join.keep_one(nasty)
    assert kept.columns == nasty.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 3, 6, 8, None, 9, 10]))


def test_pruning_keeps_what_may_reach_the_threshold():
    n = ngram_join._N
    assert ngram_join.needed(n) < 0.8 * n and ngram_join.needed(15) < 12
    left = np.zeros((1, n), dtype=np.uint32)
    right = left.copy()
    right[0, : n // 2] = 1
    assert len(ngram_join.survivors(left, left, np.array([0]), np.array([0]))) == 1
    assert len(ngram_join.survivors(left, right, np.array([0]), np.array([0]))) == 0


def test_components(spark, monkeypatch):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    for hot in (1000, 2):
        monkeypatch.setattr(text, "HOT_ROWS", hot)
        got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {x: find(x) for x in list(up)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_lines(rows):
    """Lines in order of their documents, each compared with every earlier beginning of a group in its leaf that has a segment in common."""
    lines = []
    for i, t in rows:
        for pos, line in enumerate((t or "").split("\n")):
            tokens = tuple(x for x in re.split(r"[ \t\r\f\x0b]+", line) if x)
            if len(tokens) >= 5:
                tokens = tuple("<*>" if re.search("[0-9]", x) else x for x in tokens)
            if i is not None and tokens:
                lines.append((i, pos, tokens))
    first = {}
    for i, pos, tokens in sorted(lines):
        first.setdefault(tokens, (i, pos))
    by_segment, candidates = {}, {}
    for tokens in sorted(first, key=first.get):
        if len(tokens) < 5:
            continue
        parts, rest = len(tokens) * 3 // 10 + 1, len(tokens) - 3
        for k in range(parts):
            key = (len(tokens), tokens[:3], k, tokens[3 + rest * k // parts : 3 + rest * (k + 1) // parts])
            other = by_segment.setdefault(key, tokens)
            if other != tokens and sum(a != b for a, b in zip(tokens, other)) <= 0.3 * len(tokens):
                candidates.setdefault(tokens, []).append(other)
    root = {}
    for tokens in first:
        free = [o for o in candidates.get(tokens, []) if o not in candidates]
        root[tokens] = min(free, key=first.get) if free else tokens
    begins = {}
    for tokens in first:
        begins[root[tokens]] = min(begins.get(root[tokens], first[tokens][0]), first[tokens][0])
    return {(i, pos) for i, pos, tokens in lines if i > begins[root[tokens]]}


def test_lines_of_a_leaf_form_groups(spark):
    """Three templates in one leaf, near copies that each differ elsewhere, and short lines: all by hand."""
    three = [f"log of the {what} {name} was {end} by the guard" for what, end in (("front door", "opened again"), ("left window", "shut tightly"), ("old garden", "swept out")) for name in ("anna", "bert", "carl")]
    base = "in the end it all came down to one small word that nobody said".split()
    near = [" ".join([*base[:k], "other", *base[k + 1 :]]) for k in range(4, 12)]
    rows = [(i, line) for i, line in enumerate([*three, *near, "All rights reserved.", "All rights reserved.", "one two 3", "one two 4", "", ""])]
    dropped = {r["doc_id"] for r in line_dedup.recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    kept = sorted(set(range(len(rows))) - dropped)
    # The first of each template, of the near copies, of the short line; lines without a token.
    assert kept == [0, 3, 6, 9, 17, 19, 20, 21, 22]
    made = {r["template"] for r in line_dedup.templates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "log of the front door <*> was opened again by the guard" in made and "All rights reserved." in made


def whole_groups(lines):
    """The lines in their order, each compared with every beginning of a group so far."""
    begins, dropped = [], set()
    for i, line in enumerate(lines):
        tokens = line.split()
        alike = any(len(b) == len(tokens) and b[:3] == tokens[:3] and sum(x != y for x, y in zip(b, tokens)) * 10 <= 3 * len(tokens) for b in begins)
        dropped |= {i} if alike else set()
        begins += [] if alike else [tokens]
    return dropped


def lines_of_one_leaf_each():
    """Lines whose segments are begun by lines that aren't alike or are in a group themselves, a chain of alike lines, and many of few words."""
    base = "a b c d e f g h i j k l m".split()
    but = lambda head, *at: " ".join([head, *(f"{x}{x}" if i in at else x for i, x in enumerate(base) if i)])
    # The third has but one segment in common with the second, which is alike to it; the first begins that segment.
    hidden = [but("x", *range(5, 13)), but("x"), but("x", 5, 8, 10)]
    chain = [but("y", *range(13 - k, 13)) for k in (0, 3, 6, 8)]
    r = np.random.default_rng(5)
    return list(dict.fromkeys([*hidden, *chain, *(" ".join(["n", "o", "p", *r.choice(["u", "v", "w"], 10, p=[0.6, 0.2, 0.2])]) for _ in range(300))]))


def test_a_line_finds_its_group_behind_others_of_its_segment(spark):
    lines = lines_of_one_leaf_each()
    want = whole_groups(lines)
    assert 2 in want and want - brute_lines(list(enumerate(lines)))
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert {r["doc_id"] for r in line_dedup.recurring_lines(df).collect()} == want


def test_lines_by_sql(spark, nasty):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = sorted(map(str, con.execute(f"SELECT doc_id, n_lines, n_dropped, text FROM ({line_dedup.ORACLE})").fetchall()))
    got = line_dedup.dedup_lines(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).select("doc_id", "n_lines", "n_dropped", "text")
    assert sorted(str(tuple(r)) for r in got.collect()) == want


def test_line_dedup_matches_brute_force(spark, nasty, small):
    extra = [(1, "keep this line that is only here\nPage 3 of 10 was printed on Monday"), (2, "another line of its own in here\nPage 4 of 10 was printed on Monday"), (3, "user anna logged in from the office today\nshort one"), (4, "user bert logged in from the office today\nshort one"), (5, "user carl logged in from the office today")]
    for df in (spark.createDataFrame(extra, "doc_id long, text string"), nasty, small):
        gone = brute_lines([(r["doc_id"], r["text"]) for r in df.collect()])
        rows = {(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()}
        want = sorted(str((i, "\n".join(x for p, x in enumerate((t or "").split("\n")) if (i, p) not in gone))) for i, t in rows)
        got = sorted({str((r["doc_id"], r["text"])) for r in line_dedup.dedup_lines(df).collect()})
        assert got == want


def test_line_dedup_is_native_and_empty(none, small):
    assert not python_workers(line_dedup.dedup_lines(small))
    assert line_dedup.dedup_lines(none).count() == 0


def test_rows_of_hot_and_null_keys_are_spread(spark, monkeypatch):
    """A third of the rows has one key and a third has none: each task of the join gets a part of them."""
    monkeypatch.setattr(text, "HOT_ROWS", 50)
    monkeypatch.setattr(text, "hot_limit", lambda total: 50)
    rows = spark.createDataFrame([(7 if i % 3 == 0 else None if i % 3 == 1 else i, f"t{i}", "clash") for i in range(3000)], "k long, t string, __n string")
    table = spark.createDataFrame([(k, k * 2) for k in range(0, 3000, 7)], "k long, v long")
    got = text.spread_left_join(rows, table, "k")
    assert got.columns == ["k", "t", "__n", "v"]
    want = sorted((r["k"] is None, r["k"] or 0, r["t"], r["k"] is not None and r["k"] % 7 == 0 and 2 * r["k"]) for r in rows.collect())
    assert sorted((r["k"] is None, r["k"] or 0, r["t"], r["v"] if r["v"] is not None else False) for r in got.collect()) == want
    conf = "spark.sql.adaptive.enabled"
    spark.conf.set(conf, "false")
    try:
        sizes = [n for n in text.spread_left_join(rows, table, "k").rdd.glom().map(len).collect()]
    finally:
        spark.conf.set(conf, "true")
    assert len(sizes) >= 4 and max(sizes) <= 2 * 3000 / len(sizes)


def test_lines_are_the_same_by_shuffles(spark, nasty, small, monkeypatch):
    """Without a broadcast, with hot ids and with rows that have no id."""
    from pyspark.sql import functions as F

    docs = small.select("doc_id", "text").unionByName(small.limit(50).select(F.lit(None).cast("long").alias("doc_id"), "text")).unionByName(small.limit(60).select(F.lit(3).cast("long").alias("doc_id"), "text"))
    docs = docs.unionByName(nasty.select("doc_id", "text"))
    want = sorted(map(str, line_dedup.dedup_lines(docs).collect()))
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(text, "hot_limit", lambda total: 20)
    df = line_dedup.dedup_lines(docs)
    assert not python_workers(df) and sorted(map(str, df.collect())) == want

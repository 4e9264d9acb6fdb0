"""Containment of names and expansion by hops against brute force."""

import random

import pytest
from gridfolio.operators import containment, graph, hops
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def clean(x):
    return " ".join(x.lower().split()) if x is not None else ""


def brute(left, right):
    a, b = ({clean(x) for x in side} - {""} for side in (left, right))
    hit = lambda x, y: x == y or min(len(x), len(y)) >= 3 and (x in y or y in x)
    return sorted((x, y) for x in a for y in b if hit(x, y))


def pairs(spark, left, right):
    a, b = (spark.createDataFrame([(x, "clash") for x in side], f"{c} string, gram string") for side, c in ((left, "l"), (right, "r")))
    return sorted(map(tuple, containment.contained_pairs(a, b, "l", "r").collect()))


NAME = st.text("abA c", max_size=7) | st.none()


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(NAME, max_size=12), st.lists(NAME, max_size=12))
def test_pairs_equal_all_comparisons(spark, left, right):
    assert pairs(spark, left, right) == brute(left, right)


def test_thousands_of_names(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(1, 6)))
    left, right = [" ".join(word() for _ in range(r.randint(1, 3))) for _ in range(1500)], [word() for _ in range(1500)]
    assert pairs(spark, left, right) == brute(left, right)


def test_no_product_in_the_plan(spark):
    df = spark.createDataFrame([("abc",)], "n string")
    plan = containment.contained_pairs(df, df, "n", "n")._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "Join Inner\n" not in plan


def test_seeds_equal_those_by_literals(spark):
    nodes = spark.createDataFrame([("red",), ("dark red",), ("re",), ("blue",), ("the red one is big",), (" ",), (None,)], "entity_key string")
    names = spark.createDataFrame([("Dark  Red",), ("re",), (None,)], "name string")
    got = sorted(r["node"] for r in containment.seeds(nodes, names).collect())
    assert got == sorted(r["node"] for r in graph.seeds_by_name(nodes, ["Dark  Red", "re"]).collect()) == ["dark red", "re", "red"]


def walk(log, seeds, n, k):
    """The same with sets."""
    mentions = {}
    for i, e in log:
        mentions.setdefault(i, set()).add(e)
    seen, frontier, out = set(seeds), set(seeds), []
    taken = set()
    for hop in range(n):
        shared = [(-len(m & frontier), i) for i, m in mentions.items() if m & frontier and i not in taken]
        own = [(i, hop, -s) for s, i in sorted(shared)[:k]]
        out += own
        taken |= {i for i, *_ in own}
        frontier = set().union(*[mentions[i] for i, *_ in own]) - seen if own else set()
        seen |= frontier
    return sorted(out)


@pytest.mark.parametrize(("seed", "n", "k"), [(1, 1, 5), (2, 3, 4), (3, 4, 100)])
def test_hops_equal_a_walk(spark, seed, n, k):
    r = random.Random(seed)
    log = [(r.randint(0, 80), f"e{min(r.randint(0, 60), r.randint(0, 60))}") for _ in range(200)]
    df = spark.createDataFrame(log, "chunk_id long, entity_key string").withColumns({c: F.lit("clash") for c in ("hop", "n_shared", "node")})
    seeds = spark.createDataFrame([("e3",), ("e7",), ("e7",), ("nowhere",)], "node string")
    assert sorted(map(tuple, hops.expanded(df, seeds, n, k).collect())) == walk(log, {"e3", "e7", "nowhere"}, n, k)


def test_hops_without_seeds(spark):
    df = spark.createDataFrame([(1, "a")], "chunk_id long, entity_key string")
    assert hops.expanded(df, spark.createDataFrame([], "node string")).count() == 0

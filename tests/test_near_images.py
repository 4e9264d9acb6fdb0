"""The first near image by both ways, against all pairs."""

import random

import pytest
from gridfolio.operators import images
from pyspark.sql import functions as F


def nearest(rows):
    out = {}
    for d, i, h in rows:
        before = [j for e, j, g in rows if e == d and j < i and h is not None and g is not None and ((h ^ g) % 2**64).bit_count() <= images.MAX_HAMMING]
        if before:
            out[d, i] = min(before)
    return out


@pytest.mark.parametrize(("bits", "n"), [([0, 3, 5, 8, 11, 13, 40, 63], 300), (range(64), 150), ([7], 20), ([], 5)])
def test_both_ways_equal_all_pairs(spark, bits, n):
    r = random.Random(len(bits))
    value = lambda: sum(1 << b for b in bits if r.random() < 0.5)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    base = [value() for _ in range(4)]
    rows = [(d, i, None if i % 17 == 16 else signed(r.choice(base) ^ sum(1 << b for b in r.sample(list(bits), min(len(bits), r.randint(0, 7)))))) for d in "ab" for i in range(n)]
    df = spark.createDataFrame(rows, "document_id string, image_index int, ahash long")
    want = nearest(rows)
    assert {(x["document_id"], x["image_index"]): x["duplicate_of"] for x in images.duplicates(df).collect()} == want
    first = df.where("ahash is not null").groupBy("document_id", "ahash").agg(F.min("image_index").alias("__first"))
    places, _ = images._varying(first, "document_id")
    if len(places) <= images.SPREAD_BITS:
        spread = {(x["document_id"], x["ahash"]): x["__near"] for x in images._spread(first, "document_id", places).collect()}
        assert all(spread[d, h] == min(i, want.get((d, i), i)) for d, i, h in rows if h is not None and (d, h) not in {(a, c) for a, b, c in rows if a == d and b < i})


def test_hashes_of_few_bits_are_not_compared_in_pairs(spark):
    """All 4096 hashes of twelve bits: pairs would be millions in a few groups."""
    df = spark.range(40960).select(F.lit("d").alias("document_id"), F.col("id").cast("int").alias("image_index"), F.pmod("id", F.lit(4096)).alias("ahash"))
    first = df.groupBy("document_id", "ahash").agg(F.min("image_index").alias("__first"))
    assert images._varying(first, "document_id") == (list(range(12)), True)
    found = images.duplicates(df)
    assert found.count() == 40959

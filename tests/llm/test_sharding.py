import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gramweave.llm import sharding
from gramweave.llm.sharding import Node, levels, numbered, op5_sharding, place, tree


def test_law_and_slots(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 100)
    rows = [(i, f"text {i % 7} é", "x") for i in range(1500)] + [(3, "text 3 é", "x"), (3, "text 3 é", "x"), (None, None, None), (9999, "", "x")]
    got = op5_sharding(spark.createDataFrame(rows, "doc_id long, text string, shard string")).collect()
    assert len(got) == len(rows)
    assert {r.shard for r in got} == set(range(16))
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    moved = [r for r in got if r.grown_shard != r.shard]
    assert moved and {r.grown_shard for r in moved} == {16}
    assert 0.03 < len(moved) / len(got) < 0.1
    assert len({r.shard for r in got if r.doc_id == 3}) == 1
    by = {r.doc_id: r for r in got}
    assert (by[None].size, by[None].text_crc32, by[None].law) == (1, 0, "key")
    assert (by[5].size, by[5].text_crc32) == (len("text 5 é".encode()) + 1, zlib.crc32("text 5 é".encode()))
    assert max(Counter(r.shard for r in got).values()) < 2 * len(got) / 16


def test_weight_change_stays_in_its_subtree(spark):
    leaf = lambda s, w=1.0: Node(f"s{s}", shard=s, own_weight=w)
    make = lambda w: Node("root", (Node("r0", (Node("k0", (leaf(0), leaf(1))), Node("k1", (leaf(2), leaf(3, w))))), Node("r1", (Node("k0", (leaf(4), leaf(5))),))))
    df = spark.range(4000).select(F.col("id").cast("string").alias("_key"))
    two = levels(levels(df, make(1.0), "a"), make(3.0), "b").withColumn("c", place(F.col("_key"), make(1.0)))
    got = two.collect()
    assert all(r.a == r.c for r in got)
    # Rows move only into the region, the rack and the shard that grew; whatever came from elsewhere may take any place in them.
    region = lambda s: s // 4
    assert all(region(r.b) == 0 for r in got if r.a != r.b)
    assert all(r.b in (2, 3) for r in got if r.a != r.b and region(r.a) == 0)


@pytest.mark.parametrize("n", [0, 1])
def test_small(spark, n):
    df = spark.createDataFrame([(1, "a")][:n], "doc_id long, text string")
    assert op5_sharding(df).count() == n
    assert numbered(df.withColumn("g", F.lit(1)), "g", ["doc_id"], "k").count() == n
    assert tree(3, grown=2).weight == 5

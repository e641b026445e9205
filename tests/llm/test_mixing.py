import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gramweave.llm import mixing
from gramweave.llm.mixing import emitted, mix, op11_mixing, targets

SCHEMA = "doc_id long, text string, source string, target string, copies int"


def water(sizes, weights=(5, 2, 1), cap=3):
    """Targets by resharing round after round, in plain Python; ``sizes`` by source, in the sources' order."""
    total, full = sum(sizes), set()
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    while True:
        spare, share = total - sum(cap * sizes[i] for i in full), sum(w for i, w in enumerate(weight) if i not in full)
        aims = [cap * s if i in full else weight[i] * spare / share for i, s in enumerate(sizes)]
        new = {i for i, s in enumerate(sizes) if aims[i] > cap * s}
        if not new:
            return aims
        full |= new


def corpus(seed, n=1200):
    draw = random.Random(seed)
    sources = ["b", "a", "é", "\U0001f600", "￿", None, "tiny", "hot"]
    rows = []
    for i in range(n):
        source = "hot" if draw.random() < 0.4 else draw.choice(sources[: 1 + i * len(sources) // n])
        text = draw.choice([None, "", " \t\n", "  x"]) if draw.random() < 0.1 else " ".join(["w"] * min(4000, int(draw.paretovariate(0.9) * 4)))
        rows.append((i, text, source, "x", 1))
    return [*rows, rows[0], rows[0], (None, "a b", "hot", "x", 1), (None, None, None, "x", 1), (n, "w " * 200_000, "tiny", "x", 1)]


@pytest.mark.parametrize("ranged", [7, 100_000])
def test_against_plain_python(spark, monkeypatch, ranged):
    monkeypatch.setattr(mixing, "RANGE_ROWS", ranged)
    rows = corpus(1, 300 if ranged == 7 else 1200)
    got = op11_mixing(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert len(got) == len(rows)
    source = {r[0]: r[2] for r in rows if r[0] is not None}
    size = {r[0]: len((r[1] or "").replace(" ", "x").split()) for r in rows if r[0] is not None}
    assert all(r.size == size[r.doc_id] for r in got if r.doc_id is not None)
    order = sorted({r[2] for r in rows if r[2] is not None}, key=lambda s: s.encode()) + [None]
    total = defaultdict(int)
    for r in rows:
        total[r[2]] += len((r[1] or "").replace(" ", "x").split())
    aims = dict(zip(order, water([total[s] for s in order]), strict=True))
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        s = source[r.doc_id] if r.doc_id is not None else "hot" if r.size else None
        assert r.source_size == total[s]
        assert math.isclose(r.target, aims[s])
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 3
        # Every document gets the whole copies below or above its expectation.
        if total[s]:
            assert math.floor(r.target / total[s] - 1e-9) <= r.copies <= math.ceil(r.target / total[s] + 1e-9)
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    assert all(abs(taken[s] - aims[s]) <= largest[s] + 1 for s in order)
    assert math.isclose(sum(aims.values()), sum(total.values()))


def test_systematic_sums_in_plain_python(spark, monkeypatch):
    """The copies are those of one running sum per source, whatever ranges it is cut into."""
    monkeypatch.setattr(mixing, "RANGE_ROWS", 5)
    rows = [(i, f"s{i % 3}", (i * 37) % 11) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, source string, size long")
    got = {r.id: r for r in mix(df, ["id"]).collect()}
    for s in ("s0", "s1", "s2"):
        of = sorted((r for r in rows if r[1] == s), key=lambda r: (r[2], r[0]))
        one = got[of[0][0]]
        step = min(3 * mixing.UNITS, math.floor(one.target * mixing.UNITS / one.source_size + 0.5))
        import hashlib

        at = int(hashlib.md5(f"mix|s{s}".encode()).hexdigest()[:10], 16)
        for r in of:
            assert got[r[0]].copies == (at + step) // mixing.UNITS - at // mixing.UNITS
            at += step
    again = {r.id: r.copies for r in mix(df.repartition(7), ["id"]).collect()}
    assert again == {k: r.copies for k, r in got.items()}
    out = emitted(mix(df, ["id"]))
    assert out.count() == sum(again.values()) and out.where("copy < 1 or copy > copies").isEmpty()


@pytest.mark.parametrize("sizes", [[], [0], [0, 0, 0], [10], [1, 1000], [1000, 1], [5, 0, 3, 1, 10**12, 7, 2], [2**k for k in range(20)]])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(f"s{i:03}", s) for i, s in enumerate(sizes)], "_key string, source_size long")
    got = [r.target for r in targets(df).orderBy("_key").collect()]
    assert got == pytest.approx(water(sizes) if sizes else [])
    assert sum(got) == pytest.approx(sum(sizes))


def test_small_and_other_weights(spark):
    assert op11_mixing(spark.createDataFrame([], SCHEMA)).collect() == []
    one = op11_mixing(spark.createDataFrame([(None, None, None, None, None)], SCHEMA)).first()
    assert tuple(one) == (None, 0, 0, 0.0, 0, 0)
    df = spark.range(1000).select(F.col("id"), F.when(F.col("id") < 700, "a").otherwise("b").alias("source"), F.lit(10).alias("size"))
    got = mix(df, ["id"], weights=(1, 1), cap=2).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("t"), F.max("copies").alias("m")).collect()
    assert all(abs(r.t - 5000) <= 10 and r.m <= 2 for r in got)


def test_weighted_words_beyond_an_int(spark):
    sizes = [600_000_000, 450_000_000, 100_000_000]
    got = {r._key: r.target for r in targets(spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(sizes)], "_key string, source_size long")).collect()}
    assert [got[f"s{i}"] for i in range(3)] == pytest.approx(water(sizes))

import random

from pyspark.sql import functions as F

from gramweave.functions import stats


def test_ranks_by_ranges_equal_ranks(spark):
    r = random.Random(2)
    rows = [(g, float(r.choice([1, 1, 1, r.randrange(30), r.random()])), i) for i, g in enumerate(r.choice("abc") for _ in range(500))]
    df = spark.createDataFrame(rows, "g string, x double, i int")
    want = {r.i: r.k for r in stats.average_rank(df, ["g"], "x", "k").collect()}
    got = {r.i: r.k for r in stats.average_rank_by_ranges(df, ["g"], "x", "k", range_rows=40).collect()}
    assert got == want
    a = {r.g: r.rho for r in stats.spearman(df.withColumn("y", df.i % 7 * 1.0), ["g"], "x", "y", "rho").collect()}
    b = {r.g: r.rho for r in stats.spearman(df.withColumn("y", df.i % 7 * 1.0), ["g"], "x", "y", "rho", ranges=True).collect()}
    assert all(abs(a[g] - b[g]) < 1e-12 for g in a)


def test_undefined_is_null(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, 2.0)], "g string, x double, y double")
    got = {r.g: (r.p, r.c) for r in df.groupBy("g").agg(stats.pearson("x", "y").alias("p"), stats.cosine("x", "y").alias("c")).collect()}
    assert got["a"][0] is None and got["b"][0] is None and got["b"][1] == 1.0
    auc = stats.roc_auc(df.withColumn("l", (df.y > 0).cast("int")), ["g"], "l", "y", "auc").collect()
    assert all(r.auc is None for r in auc)
    z = stats.robust_z(df, ["g"], "x", "z").collect()
    assert all(r.z == 0 for r in z)


def test_quantiles_by_ranges_equal_percentiles(spark):
    r = random.Random(5)
    rows = [(g, r.choice([1.0, 1.0, r.random(), None]), r.choice([-0.0, 0.0, 2.5, float(r.randrange(9))])) for g in r.choices("abc", k=400)] + [("lone", 3.0, None), ("pair", 1.0, 2.0), ("pair", 4.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(4)
    points = {"low": 0.025, "q25": 0.25, "median": 0.5, "high": 0.975, "top": 1.0}
    want = {w.g: w for w in df.groupBy("g").agg(*(F.percentile(c, q).alias(f"{c}_{n}") for c in "xy" for n, q in points.items())).collect()}
    for size, bins in ((7, 4096), (2, 16), (10_000, 4096), (10_000, 16)):
        got = {w.g: w for w in stats.quantiles_by_ranges(df, ["g"], ["x", "y"], points, range_rows=size, bins=bins).collect()}
        assert got.keys() == want.keys()
        for g in got:
            for c in [f"{c}_{n}" for c in "xy" for n in points]:
                assert (got[g][c] is None) == (want[g][c] is None) and (got[g][c] is None or abs(got[g][c] - want[g][c]) < 1e-12), (g, c)


def test_no_task_holds_a_group(spark):
    """400 distinct values of one group lie in ranges of 20 or so."""
    df = spark.range(2000).selectExpr("0 as g", "cast(id % 400 as double) as x")
    place = stats.positions(df, ["g"], "x", range_rows=20)
    got = {p.x: (p._count, p._start, p._total) for p in place.collect()}
    assert got == {float(k): (5, 5 * k, 2000) for k in range(400)}


def test_running_sums_by_ranges(spark):
    """A range of few rows starts where those before it end; NULL values and a NULL group."""
    import numpy as np

    from gramweave.functions import stats

    r = np.random.default_rng(6)
    rows = [(g, int(k), None if k % 11 == 0 or (g == "b" and k < 40) else float(r.integers(0, 99))) for g in ("a", "b", None) for k in r.permutation(97)]
    got = {(x.g, x.k): (x.before, x.running) for x in stats.along_ranges(spark.createDataFrame(rows, "g string, k int, x double"), ["g"], "k", "x", "before", "running", 20).collect()}
    assert len(got) == 3 * 97
    for g in ("a", "b", None):
        last, total = None, None
        for _, k, x in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            total = total if x is None else x + (total or 0.0)
            assert got[g, k] == (last, total)
            last = x

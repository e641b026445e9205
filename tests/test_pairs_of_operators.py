"""What is summed, ranked or let out inside the cells of pairs equals what the stored pairs give."""

import numpy as np
import pytest
from pyspark.sql import DataFrame, functions as F

from gramweave.operators import geometry
from gramweave.sources import readers

GRID = (1.0, 1.5, 2.0, 4.0, 16.0)


@pytest.fixture(scope="module")
def operators(spark):
    r = np.random.default_rng(5)
    a = r.random((30, 3, 3)) - 0.5
    a = (a + a.transpose(0, 2, 1)) / 6
    a[4] = a[3]
    return spark.createDataFrame([(int(s * 5), x.ravel().tolist()) for s, x in enumerate(a)], "s long, rho array<double>")


def distances(operators):
    return geometry.distances(geometry.spectra(operators), GRID)


def same(got, want, keys, tolerance=1e-6):
    got, want = ({tuple(r[k] for k in keys): r.asDict() for r in df.collect()} for df in (got, want))
    assert got.keys() == want.keys()
    for k, row in want.items():
        for c, x in row.items():
            assert got[k][c] == (x if x is None or isinstance(x, (int, str)) else pytest.approx(x, abs=tolerance)), (k, c)


@pytest.fixture
def unstored(monkeypatch):
    """No pair may become a row of its own that is stored or joined."""

    def refused(*_, **__):
        raise AssertionError("pairs are made as rows")

    monkeypatch.setattr(geometry, "paired", refused)
    monkeypatch.setattr(DataFrame, "crossJoin", refused)


def test_subject_profiles(operators, request):
    want = geometry.subject_profiles(distances(operators))
    request.getfixturevalue("unstored")
    same(geometry.subject_profiles_of_operators(operators, GRID), want, ("s", "p0", "p"))
    same(geometry.subject_profiles_of_operators(operators.where("s in (15, 20)"), GRID).where("response is not null"), want.where("false"), ("s", "p0", "p"))
    assert geometry.subject_profiles_of_operators(operators.where("s = 0"), GRID).count() == 0


def test_ratios(operators, request):
    d = distances(operators)
    ref = d.where("p = 1").select("s", "t", F.col("d").alias("d0"))
    want = d.join(ref, ["s", "t"]).select("p", "s", "t", F.when(F.col("d0") > 1e-12, F.col("d") / F.col("d0")).alias("ratio")).localCheckpoint()
    request.getfixturevalue("unstored")
    same(geometry.ratios_of_operators(operators, GRID, 1.0), want, ("p", "s", "t"))


@pytest.mark.parametrize("spoil", [False, True])
def test_distance_faults(operators, spoil, request):
    def kept(p, s, t, d):
        d = np.where((p == 2) & (s < t) & (s % 2 == 0), d + 1, d)
        d = np.where((p == 4) & (s % 3 == 0), np.nan, np.where((p == 1) & (s == t), -1.0, d))
        return d, ~((p == 16) & (s % 4 == 0) & (t % 7 == 0))

    d = geometry.both_ways(distances(operators)).unionByName(operators.select(F.explode(F.array(*map(F.lit, GRID))).alias("p"), "s", F.col("s").alias("t"), F.lit(0.0).alias("d")))
    if spoil:
        x = F.when(F.expr("p = 2 and s < t and s % 2 = 0"), F.col("d") + 1).when(F.expr("p = 4 and s % 3 = 0"), float("nan")).when(F.expr("p = 1 and s = t"), -1.0).otherwise(F.col("d"))
        d = d.where("not (p = 16 and s % 4 = 0 and t % 7 = 0)").withColumn("d", x)
    want = readers.distance_faults(d, 30).localCheckpoint()
    request.getfixturevalue("unstored")
    same(readers.distance_faults_of_operators(operators, GRID, kept if spoil else None), want, ("p",))


def test_scales(operators, request):
    want = geometry.shape_and_scale(distances(operators)).groupBy("p").agg(F.first("scale").alias("scale"), F.count("*").alias("n")).localCheckpoint()
    request.getfixturevalue("unstored")
    same(geometry.scales_of_operators(operators, GRID), want, ("p",))


def test_cumulative_change(operators, monkeypatch, request):
    want = geometry.cumulative_change(distances(operators), 1.0).localCheckpoint()
    request.getfixturevalue("unstored")
    monkeypatch.setattr(geometry, "SORTED_PAIRS", 0)
    # Pairs with either of two equal operators tie but for rounding, and losses are in per cent.
    same(geometry.cumulative_change_of_operators(operators, GRID, 1.0), want, ("p",), 1e-4)


def test_preservation(operators, monkeypatch):
    want = geometry.preservation(operators, 3, (2, 3)).localCheckpoint()
    monkeypatch.setattr(geometry, "SORTED_PAIRS", 0)
    monkeypatch.setattr(geometry, "frobenius", None)
    same(geometry.preservation(operators, 3, (2, 3)), want, ("m",))

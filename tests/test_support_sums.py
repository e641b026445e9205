"""Importances summed inside the cells of held-out subjects and support vectors equal those of joined pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gramweave.functions import kernels
from gramweave.operators import explain


@pytest.mark.parametrize("n", [2, 3])
def test_contributions_of_a_stack(n):
    r = np.random.default_rng(3)
    d = r.random((40, n, n)) - 0.5
    d = d + d.transpose(0, 2, 1)
    d[0] = 0
    for p in (1.0, 1.5, 2.0, 4.0, 16.0):
        size, c = kernels.contributions_of(d, p)
        for k, x in enumerate(d):
            values, vectors = np.linalg.eigh(x)
            assert size[k] == pytest.approx(kernels.schatten(np.abs(values), p))
            assert c[k] == pytest.approx(kernels.contributions(values, vectors, [p])[0], abs=1e-9)


def test_importance(spark, monkeypatch):
    r = np.random.default_rng(4)
    a = r.random((20, 3, 3)) - 0.5
    a = (a + a.transpose(0, 2, 1)) / 6
    a[3] = a[2]
    operators = spark.createDataFrame([(int(s * 5), x.ravel().tolist()) for s, x in enumerate(a)], "s long, rho array<double>")
    splits = spark.createDataFrame([(k, (s + k) % 3 + 1, s * 5) for k in (1, 2) for s in range(20) if (k, s) != (2, 7)], "repeat int, fold int, s long")
    folds = splits.select("repeat", F.col("fold").alias("f")).distinct()
    sv = splits.join(folds, "repeat").where("f <> fold and s % 3 = 0").select("repeat", F.col("f").alias("fold"), F.col("s").alias("sv"))
    sv = sv.select(F.explode(F.array(F.lit(1.0), F.lit(2.0), F.lit(4.0))).alias("p"), "*").where("not (p = 4 and repeat = 1 and fold = 2)")
    sv = sv.select("*", (F.when(F.col("sv") % 2 == 0, 1.0).otherwise(-0.5) * F.col("p")).alias("alpha"), (F.col("p") + F.col("fold")).alias("gamma")).localCheckpoint()
    made = explain.node_contributions(operators, [1.0, 2.0, 4.0], needed=explain.needed_pairs(sv, splits))
    want = {(x.p, x["repeat"], x.s, x.node): x.importance for x in explain.importance(made, sv, splits).collect()}
    monkeypatch.setattr(explain, "paired", None)
    got = {(x.p, x["repeat"], x.s, x.node): x.importance for x in explain.importance_of_operators(operators, sv, splits).collect()}
    assert got.keys() == want.keys() and len(want) > 200
    assert all(got[k] == pytest.approx(x, abs=1e-9) for k, x in want.items())
    assert explain.importance_of_operators(operators, sv.where("false"), splits).count() == 0

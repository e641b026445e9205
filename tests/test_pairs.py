"""Kernels over all pairs, in blocks: every pair once, whatever the blocks and stacks."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from gramweave.functions import kernels
from gramweave.operators import benchmark, explain, geometry


def operators(spark, count, n, seed=1, names=None):
    r = np.random.default_rng(seed)
    x = r.normal(size=(count, n, n))
    rho = x @ x.transpose(0, 2, 1)
    rho /= np.trace(rho, axis1=1, axis2=2)[:, None, None]
    ids = names or list(range(count))
    return rho, spark.createDataFrame([(i, a.ravel().tolist()) for i, a in zip(ids, rho, strict=True)], f"s {'string' if names else 'long'}, rho array<double>").repartition(3)


@pytest.mark.parametrize(("block_bytes", "step_bytes", "blocks"), [(16 << 20, 8 << 20, 8), (2000, 300, 1), (700, 1, 2), (16 << 20, 2000, 1)])
def test_every_pair_once(spark, monkeypatch, block_bytes, step_bytes, blocks):
    monkeypatch.setattr(geometry, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(geometry, "STEP_BYTES", step_bytes)
    rho, df = operators(spark, 23, 4)
    got = {(r.s, r.t): sorted(r.sv) for r in geometry.spectra(df, blocks).collect()}
    assert got.keys() == {(i, j) for i in range(23) for j in range(i + 1, 23)}
    for (i, j), sv in got.items():
        assert np.allclose(sv, sorted(np.abs(np.linalg.eigvalsh(rho[i] - rho[j]))))


def test_names_and_order_of_the_ends(spark):
    rho, df = operators(spark, 9, 3, names=[f"n{k}" for k in (3, 10, 1, 2, 20, 4, 5, 6, 7)])

    def sides(s, a, t, b):
        return pa.RecordBatch.from_arrays([s, t, pa.array(a[:, 0]), pa.array(b[:, 0])], ["s", "t", "x", "y"])

    first = {r.s: r.rho[0] for r in df.collect()}
    rows = geometry.paired(df, "rho", sides, "s string, t string, x double, y double", 3).collect()
    assert len(rows) == 36 and all(r.s < r.t and r.x == first[r.s] and r.y == first[r.t] for r in rows)


def test_only_the_pairs_asked_for(spark):
    _, df = operators(spark, 12, 3)
    seen = []
    asked = [(5, 2), (0, 11), (3, 4), (7, 7)]
    need = spark.createDataFrame(asked, "s long, t long")
    got = explain.node_contributions(df, [1.0, 2.0], needed=need).collect()
    assert {(r.s, r.t) for r in got} == {(2, 5), (0, 11), (3, 4)} and len(got) == 6 and not seen
    assert explain.node_contributions(df, [2.0], needed=need.limit(0)).count() == 0
    assert geometry.spectra(df.limit(0)).count() == 0 and geometry.spectra(df.limit(1)).count() == 0


def test_two_hundred_nodes(spark):
    """A pair's row never holds two matrices: 320 kB an operator, seven of them, in blocks of 640 kB."""
    rho, df = operators(spark, 7, 200)
    got = {(r.s, r.t): r for r in explain.node_contributions(df, [2.0], blocks=1).collect()}
    assert len(got) == 21
    delta = rho[2] - rho[6]
    gone = 2 * (delta**2).sum(axis=1) - np.diag(delta) ** 2
    assert np.allclose(got[(2, 6)].c, gone / np.sqrt((delta**2).sum())) and np.isclose(got[(2, 6)].d, np.sqrt((delta**2).sum()))


def test_exact_removal_without_cells_of_pairs(spark):
    rho, df = operators(spark, 5, 6)
    cells = [(s, i, j, float(rho[s, i, j])) for s in range(5) for i in range(6) for j in range(6)]
    got = {(r.s, r.t, r.node): (r.d, r.exact, r.first_order) for r in explain.exact_removal(spark.createDataFrame(cells, "s long, i int, j int, v double")).collect()}
    assert len(got) == 10 * 6
    for (s, t, node), (d, exact, first) in got.items():
        delta = rho[s] - rho[t]
        left = np.delete(np.delete(delta, node, 0), node, 1)
        whole = np.sqrt((delta**2).sum())
        assert np.isclose(d, whole) and np.isclose(exact, whole - np.sqrt((left**2).sum())) and np.isclose(first, (whole**2 - (left**2).sum()) / whole)


def test_lowrank_kernels_agree_and_the_benchmark_says_so(spark):
    r = np.random.default_rng(2)
    f = r.normal(size=(30, 8, 2))
    f /= np.sqrt((f**2).sum(axis=(1, 2)))[:, None, None]
    df = spark.createDataFrame([(i, x.ravel().tolist()) for i, x in enumerate(f)], "s long, f array<double>")
    assert geometry.dense_check(df, 8).where("max_error > 1e-9").isEmpty()
    row = benchmark.lowrank_benchmark(df, 8, (1.0, 2.0, 16.0), subjects=6).first()
    assert (row.n_timed, row.n_pairs) == (15, 435) and row.max_relative_error < 1e-9 and row.pairs_per_second > 0
    low = {(x.s, x.t): x.sv for x in geometry.factor_spectra(df, 8).collect()}
    assert np.allclose(sorted(low[(3, 7)])[-4:], sorted(np.abs(np.linalg.eigvalsh(f[3] @ f[3].T - f[7] @ f[7].T)))[-4:])
    assert kernels.schatten(np.zeros(0), 2.0) == 0


def test_cells_go_by_the_number_of_pairs(spark, monkeypatch):
    """However small the matrices, a cell has no more than some CELL_ROWS squared pairs."""

    def counted(s, a, t, b):
        return pa.RecordBatch.from_arrays([pa.array([len(s)])], ["n"])

    _, df = operators(spark, 60, 2)
    few = [r.n for r in geometry.paired(df, "rho", counted, "n long", 1).collect()]
    monkeypatch.setattr(geometry, "CELL_ROWS", 5)
    many = [r.n for r in geometry.paired(df, "rho", counted, "n long", 1).collect()]
    assert sum(few) == sum(many) == 60 * 59 // 2
    assert len(few) == 1 and len(many) > 50 and max(many) < 15**2
    assert geometry.pairs(df, [], 1).count() == 60 * 59 // 2
    assert geometry.frobenius(df, 1).count() == 60 * 59 // 2


def test_pairs_asked_for_are_walked_and_no_others():
    left, right = (list(range(0, 4000, 2)), np.zeros((2000, 1))), (list(range(1, 4000, 2)), np.zeros((2000, 1)))
    partners = {2: {3, 5, 4}, 3: {2}, 5: {2}, 4: {2}, 999: {1001}, 1001: {999}}
    got = [(left[0][k], right[0][j]) for ks, js in geometry._asked(left, right, 1, partners) for k, j in zip(ks, js, strict=True)]
    assert sorted(got) == [(2, 3), (2, 5)]
    own = [(left[0][k], left[0][j]) for ks, js in geometry._asked(left, left, 10, partners) for k, j in zip(ks, js, strict=True)]
    assert own == [(2, 4)]
    few = (left[0][:90], left[1][:90]), (right[0][:70], right[1][:70])
    every = [(k, j) for ks, js in geometry._places(*few, 500) for k, j in zip(ks.tolist(), js.tolist(), strict=True)]
    assert len(every) == len(set(every)) == 90 * 70


@pytest.mark.parametrize("lacking", [False, True])
@pytest.mark.parametrize("ranges", [True, False])
def test_deformation_against_pandas(spark, lacking, ranges):
    r = np.random.default_rng(8)
    rows = [(p, s, t, float(r.integers(0, 30)) / 8 + (p == 1.0)) for p in (1.0, 2.0, 4.0) for s in range(12) for t in range(s + 1, 12)]
    if lacking:
        rows = [x for x in rows if not (x[0] == 2.0 and x[1] == 3) and not (x[0] == 1.0 and x[2] == 7)]
    got = {x.p: x for x in geometry.deformation(spark.createDataFrame(rows, "p double, s long, t long, d double"), 1.0, ranges).collect()}
    frame = pd.DataFrame(rows, columns=["p", "s", "t", "d"])
    frame = frame.merge(frame[frame.p == 1.0][["s", "t", "d"]].rename(columns={"d": "d0"}), on=["s", "t"])
    assert set(got) == {1.0, 2.0, 4.0}
    for p, own in frame.groupby("p"):
        x, rho = got[p], own.d.rank().corr(own.d0.rank())
        assert (x.n_pairs, x.median_distance) == (len(own), own.d.median())
        assert [x.mean_distance, x.median_scale_ratio_vs_p1, x.mean_scale_ratio_vs_p1, x.distance_spearman_vs_p1, x.relational_loss] == pytest.approx([own.d.mean(), own.d.median() / own.d0.median(), own.d.mean() / own.d0.mean(), rho, 1 - rho])
        assert x.log_median_scale_ratio_vs_p1 == pytest.approx(np.log(own.d.median() / own.d0.median()))


def test_rank_one_factors_have_a_closed_form(spark, monkeypatch):
    """No pair is stacked; a repeated factor and its opposite are at distance 0."""
    r = np.random.default_rng(4)
    f = r.normal(size=(21, 5))
    f[3], f[4], f[5] = f[2], -f[2], 0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(f)], "s long, f array<double>")
    monkeypatch.setattr(geometry, "paired", None)
    got = {(x.p, x.s, x.t): x.d for x in geometry.factor_distances(df, 5, (1.0, 2.0, 16.0), 3).collect()}
    assert len(got) == 3 * 210
    for (p, s, t), d in got.items():
        assert s < t and d == pytest.approx(kernels.schatten(np.abs(np.linalg.eigvalsh(np.outer(f[s], f[s]) - np.outer(f[t], f[t]))), p), abs=1e-7)

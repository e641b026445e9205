"""Registered queries cover their whole job: all components, labels, subjects, repeats, grids and draws."""

import numpy as np
import pyarrow as pa
import pytest

from gramweave.functions import kernels
from gramweave.operators import explain, geometry, learning, selection
from gramweave.plans import QUERIES
from gramweave.plans.inputs import FOLDS, GRID, REPEATS, splits, supplier_distances, supplier_operators, suppliers

SF = "/root/testdata/sf0.001"


def embeddings(spark, path, count=12):
    r = np.random.default_rng(3)
    rows = [(i, i % 3, [float(x) for x in r.normal(size=64)]) for i in range(count)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")


def test_dense_check_reads_every_component_and_label(spark, tmp_path, monkeypatch):
    embeddings(spark, tmp_path)
    sizes = []
    whole = geometry.dense_check
    monkeypatch.setattr(geometry, "dense_check", lambda f, n: sizes.append((n, f.count(), f.selectExpr("min(size(f))").first()[0])) or whole(f, n))
    assert tuple(QUERIES["geo4_dense_check"](spark, str(tmp_path)).first()) == (6, True)
    assert tuple(QUERIES["geo4_dense_check_all"](spark, str(tmp_path)).first()) == (66, True)
    assert sizes == [(64, 4, 64), (64, 12, 64)]


def test_dense_check_sees_lost_modes(monkeypatch):
    r = np.random.default_rng(4)
    f = [r.normal(size=(5, 12)).tolist() for _ in range(2)]
    batch = pa.RecordBatch.from_pydict({"s": range(5), "t": range(5, 10), "f_s": f[0], "f_t": f[1]})
    error = lambda: np.concatenate([b.column("max_error").to_numpy() for b in geometry._dense_check([batch], 6, 2)])
    assert error().shape == (5,) and error().max() < 1e-9
    whole = kernels.spectra_lowrank
    monkeypatch.setattr(kernels, "spectra_lowrank", lambda a, b: np.sort(whole(a, b), axis=1)[:, 1:])
    assert error().min() > 1e-3


FITTED = ["xai4_needed_pairs_fitted", "xai5_importance_fitted", "xai6_7_population_profiles_fitted", "xai8_12_concordance", "phc9_11_14_support_sets_fitted", "phc10_12_contribution_fields_fitted"]


class Seen(Exception):
    pass


@pytest.mark.parametrize("name", ["lrn4_5_7_nested_cv", "lrn6_14_15_16_17_surfaces", "lrn18_reconstruction", *FITTED])
def test_fits_cover_the_grid_and_all_repeats(spark, monkeypatch, name):
    def nested_cv(d, subjects, splits, grid):
        assert grid == learning.Grid()
        assert {r.p for r in d.select("p").distinct().collect()} == set(GRID)
        assert {tuple(r) for r in splits.select("repeat", "fold").distinct().collect()} == {(r, f) for r in range(1, REPEATS + 1) for f in range(1, FOLDS + 1)}
        raise Seen

    monkeypatch.setattr(learning, "nested_cv", nested_cv)
    with pytest.raises(Seen):
        QUERIES[name](spark, SF)


def test_unconverged_inner_fits_are_reported(monkeypatch):
    r = np.random.default_rng(1)
    d, y = np.abs(r.normal(size=(20, 20))), np.arange(20) % 2
    d = d + d.T
    np.fill_diagonal(d, 0)
    grid = learning.Grid((1.0,), (1.0, 10.0), 2)
    assert learning.search(d, y, np.arange(20), grid, 1)[4]
    whole = kernels.fit_svc_many
    monkeypatch.setattr(kernels, "fit_svc_many", lambda *a, **b: whole(*a, **b, limit=1))
    assert not learning.search(d, y, np.arange(20), grid, 1)[4]


def test_explanations_are_those_of_the_fitted_machines(spark, monkeypatch):
    """Against brute force over the duals of one fit, whatever the subjects' numbers."""
    rows = learning.nested_cv(supplier_distances(spark, SF), suppliers(spark, SF), splits(spark, SF), learning.Grid((1.0,), (1.0,), 2)).toPandas()
    frame = spark.createDataFrame(rows, learning.FOLD_SCHEMA)
    monkeypatch.setattr(learning, "nested_cv", lambda *a: frame)
    got = {(r.s, r.t) for r in QUERIES["xai4_needed_pairs_fitted"](spark, SF).collect()}
    want, duals = set(), {}
    for r in rows.itertuples():
        sv = {int(s): a for s, a, out in zip(r.s, r.dual, r.test, strict=True) if not out and abs(a) > 1e-12}
        duals[r.p, r.repeat, r.fold] = sv
        want |= {(min(s, t), max(s, t)) for s, out in zip(map(int, r.s), r.test, strict=True) if out for t in sv}
    assert got == want and any(s % 3 and t % 3 for s, t in got)
    for r in QUERIES["phc9_11_14_support_sets_fitted"](spark, SF).collect():
        a, b = duals[r.p, r.repeat, r.fold], duals[1.0, r.repeat, r.fold]
        assert (r.n_sv, r.n_sv_reference) == (len(a), len(b)) and abs(r.sv_jaccard - len(a.keys() & b.keys()) / len(a.keys() | b.keys())) < 1e-6
    con = {(c.p, c.s, c.t): (c.d, c.c) for c in explain.node_contributions(supplier_operators(spark, SF), GRID).collect()}
    some = QUERIES["xai5_importance_fitted"](spark, SF).collect()
    fold = {(r.repeat, s): r.fold for r in rows.itertuples() for s, out in zip(r.s, r.test, strict=True) if out}
    assert len(some) == len(GRID) * len(fold) * 3
    for r in some:
        total = 0.0
        for sv, a in duals[r.p, r.repeat, fold[r.repeat, r.s]].items():
            d, c = con[r.p, min(r.s, sv), max(r.s, sv)]
            total += a * (np.exp(-d * d) - np.exp(-(max(d - c[r.node], 0) ** 2)))
        assert abs(abs(total) - r.importance) < 1e-6


def test_production_draws(spark):
    assert {r.n_resamples for r in QUERIES["phc18_intervals_full"](spark, SF).collect()} == {500}
    assert QUERIES["spc7_subject_resamples_full"](spark, SF).select("rep").distinct().count() == 300
    assert QUERIES["sel7_stability_full"](spark, SF).count() == 30
    counts = []
    whole = selection.stability
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(selection, "stability", lambda series, m, seed, reps: counts.append(reps) or whole(series, m, seed, reps))
        assert QUERIES["sel8_best_method"](spark, SF).count() == 1
    assert counts == [30] * 4

"""Array files, checkpoints, and helpers on columns and joins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gramweave.operators import figures, geometry, posthoc, selection, tables
from gramweave.plans.pipeline import Config, Run
from gramweave.sources import checkpoints, readers


def archives(root, names):
    for k, name in enumerate(names):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        np.savez_compressed(path, test_idx=np.array([k, k + 1]), y_test=np.array([0, 1]), test_scores=np.array([-0.5, float(k)]), test_pred=np.array([0, 1]), gamma=np.float64(k), label=np.array("text"))


def test_the_best_place_wins(spark, tmp_path):
    archives(tmp_path, ["zz/p00_fold001.npz", "checkpoints/p00_fold_001.npz", "checkpoints/p00_fold001.npz", "p00_fold002.npz", "a/p00_fold002.npz", "b/x_p01_fold_001_new.npz", "a/p01_best_fold_002.npz", "notes.npz"])
    root = f"file://{tmp_path}"
    got = {(r.p_index, r.outer_fold): r.path.split(tmp_path.name)[-1] for r in checkpoints.fold_files(spark, root, 2, 2).collect()}
    assert got == {(0, 1): "/checkpoints/p00_fold001.npz", (0, 2): "/p00_fold002.npz", (1, 1): "/b/x_p01_fold_001_new.npz", (1, 2): "/a/p01_best_fold_002.npz"}
    rows = {tuple(r) for r in checkpoints.fold_scores(checkpoints.fold_arrays(spark, root, 2, 2), (1.0, 2.0), 2).collect()}
    assert (1.0, 1, 1, 2, 0, -0.5, 0) in rows and (2.0, 1, 2, 7, 1, 6.0, 1) in rows and len(rows) == 8
    assert {(r.p_index, r.outer_fold): r.gamma for r in checkpoints.fold_summaries(checkpoints.fold_arrays(spark, root, 2, 2), ("gamma",)).collect()} == {(0, 1): 2.0, (0, 2): 3.0, (1, 1): 5.0, (1, 2): 6.0}


def test_a_missing_fold_is_an_error(spark, tmp_path):
    archives(tmp_path, ["p00_fold001.npz"])
    with pytest.raises(Exception, match="no checkpoint of p 0, fold 2"):
        checkpoints.fold_files(spark, f"file://{tmp_path}", 1, 2).collect()


def test_array_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("m/a.npy", ["a"], [[2, 3]], [[1.0, 2.0, 3.0, 4.0, 5.0, 6.0]]), ("z.npz", ["x", "y"], [[], [2]], [[7.0], [8.0, 9.0]])], "path string, names array<string>, shapes array<array<int>>, arrays array<array<double>>")
    for _ in range(2):
        assert checkpoints.array_files(df, f"file://{tmp_path}").count() == 2
    assert sorted(p.name for p in tmp_path.rglob("*.np?")) == ["a.npy", "z.npz"]
    assert np.load(tmp_path / "m/a.npy").tolist() == [[1, 2, 3], [4, 5, 6]]
    assert {r.name: r.a for r in readers.archive_npz(spark, f"file://{tmp_path}").collect()} == {"x": [7.0], "y": [8.0, 9.0]}


def test_zip_needs_equal_lengths(spark):
    a, b = spark.range(3).withColumnRenamed("id", "a"), spark.range(4).withColumnRenamed("id", "b")
    assert [tuple(r) for r in tables.zipped(a, b.where("b > 0"), F.col("a").desc(), F.col("b")).orderBy("a").collect()] == [(0, 3), (1, 2), (2, 1)]
    with pytest.raises(Exception, match="differ in length"):
        tables.zipped(a, b, F.col("a"), F.col("b")).collect()


def test_interpolation_as_numpy(spark):
    points = spark.createDataFrame([(2.0, 5.0), (0.0, 1.0), (3.0, -1.0)], "x double, y double")
    xs = [-4.0, 0.0, 0.5, 1.999, 2.0, 2.5, 3.0, 9.0]
    got = {r.v: r.out for r in tables.interpolated(spark.createDataFrame([(x,) for x in xs] + [(None,)], "v double"), "v", points, "out").collect()}
    assert got.pop(None) is None
    assert np.allclose([got[x] for x in xs], np.interp(xs, [0, 2, 3], [1, 5, -1]))


def test_layers(spark):
    x = spark.range(1)
    assert tables.chosen_layer({"raw": None, "X": x}) == ("X", x) and tables.chosen_layer({"raw": x, "X": None}) == ("raw", x)
    with pytest.raises(ValueError, match="no layer raw"):
        tables.chosen_layer({"raw": None, "X": x}, "raw")


def test_optional_losses(spark):
    summary = spark.createDataFrame([(1.0, 0.5), (2.0, 0.7)], "p double, decision_loss_fold_mean double")
    assert [r.decision_axis for r in posthoc.with_decision_loss(summary, None).orderBy("p").collect()] == [0.5, 0.7]
    losses = spark.createDataFrame([(1.0, 1, 0.2), (1.0, 2, 0.4)], "p double, repeat int, decision_loss double")
    assert [(r.p, r.decision_axis and round(r.decision_axis, 9)) for r in posthoc.with_decision_loss(summary, losses).orderBy("p").collect()] == [(1.0, 0.3), (2.0, None)]


def test_box_groups(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0]
    row = figures.box_groups(spark.createDataFrame([("a", v) for v in values], "g string, x double"), "g", "x").first()
    assert (row.median, row.whisker_low, row.whisker_high, row.n_fliers, row.place) == (3.5, 1.0, 5.0, 1, 0)


def test_pipeline_from_factors_and_from_spectra(spark, tmp_path):
    r = np.random.default_rng(4)
    f = r.normal(size=(8, 5, 2))
    f /= np.sqrt((f**2).sum(axis=(1, 2)))[:, None, None]
    factors = spark.createDataFrame([(i, x.ravel().tolist()) for i, x in enumerate(f)], "s long, f array<double>")
    dense = spark.createDataFrame([(i, 5, (x @ x.T).ravel().tolist()) for i, x in enumerate(f)], "s long, n int, rho array<double>")
    subjects = spark.createDataFrame([(i, i % 2) for i in range(8)], "s long, y int")
    config = Config("low", (1.0, 2.0), folds=2, repeats=1, stages=("classifier",))
    rows = lambda job: {(x.p, x.s, x.t): x.d for x in job.distances.collect()}
    low, full = rows(Run(spark, f"{tmp_path}/a", config, factors, subjects, factor_rows=5)), rows(Run(spark, f"{tmp_path}/b", config, dense, subjects))
    known = rows(Run(spark, f"{tmp_path}/c", config, None, subjects, spectra=geometry.spectra(dense)))
    assert low.keys() == full.keys() == known.keys() and len(low) == 56
    assert all(abs(low[k] - full[k]) < 1e-9 and abs(known[k] - full[k]) < 1e-12 for k in full)
    with pytest.raises(ValueError, match="need operators"):
        Run(spark, f"{tmp_path}/d", Config("x"), None, subjects, spectra=geometry.spectra(dense))


def test_six_rules(spark):
    good = (4, 0.2, 0.9, 1.0, 1.0, 0.0, 10.0)
    rows = [good] + [(10 + k, *(v if i != k else bad for i, v in enumerate(good[1:]))) for k, bad in enumerate((0.6, 0.5, 0.9, 0.9, -1e-3, 1e9))] + [(3, 0.2, None, 1.0, 1.0, 0.0, 10.0), (30, 0.2, 0.9, 1.0, 1.0, None, 10.0)]
    df = spark.createDataFrame(rows, "m int, q double, stability double, nonconstant_fraction double, full_rank_fraction double, least_eig double, condition double")
    assert {r.m for r in selection.passes(df).where("passes").collect()} == {3, 4}
    assert {(r.m, r.recommended) for r in selection.passes(df, unknown=False).where("passes").collect()} == {(4, 4)}
    assert selection.smallest_sufficient(df, {"stability": 0.9, "full_rank_fraction": 1.0}).first().m == 4
    assert selection.smallest_sufficient(df, {"stability": 0.99}).first().m is None


def test_roll_up_of_a_sweep(spark):
    sweep = selection.dimension_sweep(spark.createDataFrame([(1, 3, [1.0, 0.5, 0.0, 0.5, 1.0, 0.0, 0.0, 0.0, 1.0]), (2, 3, [1.0, 1.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0, 1.0])], "s int, n int, a array<double>"), [2, 3])
    known = spark.createDataFrame([(2, 0.8), (2, 0.9)], "m int, jaccard double")
    got = {r.m: r for r in selection.rolled_up(sweep, 10, known).collect()}
    assert (got[2].q, round(got[2].stability, 9), got[2].full_rank_fraction) == (0.2, 0.85, 0.5) and got[3].stability is None
    assert np.isclose(got[2].condition, 3.0) and abs(got[2].least_eig) < 1e-12
    assert selection.rolled_up(sweep, 10).where("stability is not null").isEmpty()

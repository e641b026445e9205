from pathlib import Path

import numpy as np
import pytest

from gramweave.operators import explain, geometry, learning, posthoc
from gramweave.operators.simulate import toy_population
from gramweave.plans import pipeline
from gramweave.plans.pipeline import Config, run
from gramweave.session import scratch, shared_folder, stored

SETTINGS = {
    "dataset": {"name": "toy"}, "science": {"p_values": [1, 2, 16], "reference_p": 1}, "cv": {"outer_folds": 2, "repeats": 2, "inner_folds": 2, "random_state": 42},
    "model": {"gamma_values": [0.1, 1, 10], "C_values": [0.1, 10]}, "spectral": {"n_resamples": 5},
}


def test_toy_pipeline(spark, tmp_path):
    config = Config.load(SETTINGS)
    toy = toy_population(spark, 24, 6, 3)
    subjects = toy.select("s", "y")
    out = run(spark, f"file://{tmp_path}", config, toy.select("s", "n", "rho"), subjects)
    finger = {r.p: r for r in out["summary"].collect()}
    assert sorted(finger) == [1.0, 2.0, 16.0]
    assert finger[1.0].decision_concordance == pytest.approx(1) and finger[1.0].xai_concordance == pytest.approx(1)
    assert finger[1.0].leading_mode_share < finger[16.0].leading_mode_share
    assert all(0 <= r.auc_heldout <= 1 for r in finger.values())
    again = run(spark, f"file://{tmp_path}", config, toy, subjects)
    assert again["summary"].count() == 3
    assert Config.load(SETTINGS | {"cv": SETTINGS["cv"] | {"random_state": 7}}).key != config.key
    same = posthoc.compare(out["summary"].select("p", "auc_heldout", "xai_loss"), out["summary"].select("p", "auc_heldout", "xai_loss")).collect()
    assert all(r.all_close and r.same_grid for r in same)


def test_a_killed_run_goes_on_at_its_open_folds(spark, tmp_path, monkeypatch):
    """Two batches are fitted, the third breaks; the next run fits the open folds alone, and the table is that of a run in one go."""
    config = Config.load(SETTINGS | {"pipeline": {"stages": ["classifier"]}})
    toy = toy_population(spark, 16, 5, 3)
    subjects = toy.select("s", "y")
    monkeypatch.setattr(pipeline, "FITS", 5)
    fit, asked = learning.nested_cv, []

    def breaking(*a, only, **k):
        asked.append([tuple(r) for r in only.collect()])
        if len(asked) == 3:
            raise RuntimeError("killed")
        return fit(*a, only=only, **k)

    monkeypatch.setattr(learning, "nested_cv", breaking)
    with pytest.raises(RuntimeError, match="killed"):
        run(spark, f"file://{tmp_path}/a", config, toy.select("s", "n", "rho"), subjects)
    assert [len(x) for x in asked] == [5, 5, 2]
    # What a broken append leaves beside whole rows is not read.
    (left,) = tmp_path.glob("a/*/01_classifier/fits")
    (left / "_temporary" / "0").mkdir(parents=True)
    (left / "_SUCCESS").unlink()
    run(spark, f"file://{tmp_path}/a", config, toy, subjects)
    assert asked[3:] == [asked[2]]
    broken = spark.read.parquet(f"file://{left}")
    monkeypatch.setattr(learning, "nested_cv", fit)
    run(spark, f"file://{tmp_path}/b", config, toy.select("s", "n", "rho"), subjects)
    whole = spark.read.parquet(f"file://{next(tmp_path.glob('b/*/01_classifier/fits'))}")
    key = lambda df: sorted((r.p, r.repeat, r.fold, r.gamma, r.c, r.score) for r in df.collect())
    assert broken.count() == 12 and key(broken) == key(whole)


def test_half_written_tables_are_made_anew(spark, tmp_path):
    config = Config.load(SETTINGS | {"pipeline": {"stages": ["classifier"]}})
    toy = toy_population(spark, 10, 4, 3)
    job = pipeline.Run(spark, f"file://{tmp_path}", config, toy.select("s", "n", "rho"), toy.select("s", "y"))
    whole = job.spectra.count()
    for part in list(tmp_path.glob("*/01_classifier/spectra/part-*"))[::2]:
        part.unlink()
    (folder,) = tmp_path.glob("*/01_classifier/spectra")
    (folder / "_SUCCESS").unlink()
    assert job.spectra.count() == whole
    for part in folder.glob("*"):
        part.unlink()
    assert job.spectra.count() == whole


def test_stored_machine_is_reproduced(spark):
    toy = toy_population(spark, 20, 6, 3)
    d = geometry.distances(geometry.spectra(toy), (2.0,))
    subjects = toy.select("s", "y")
    splits = learning.stratified_folds(subjects, 2, 1)
    fits = learning.nested_cv(d, subjects, splits, learning.Grid((1.0,), (1.0, 10.0), 2))
    rows = learning.reconstruction(fits, d).collect()
    assert rows and all(r.max_error < 1e-9 and 0 < r.support_fraction <= 1 for r in rows)


def test_factor_and_dense_contributions_agree(spark):
    toy = toy_population(spark, 4, 5, 2)
    rows = [(r.s, np.linalg.cholesky(np.array(r.rho).reshape(5, 5)).ravel().tolist()) for r in toy.collect()]
    factors = spark.createDataFrame(rows, "s long, f array<double>")
    dense = {(r.s, r.t, r.p): r for r in explain.node_contributions(toy, (1.0, 2.0)).collect()}
    for r in explain.node_contributions(factors, (1.0, 2.0), factor_rows=5).collect():
        assert r.d == pytest.approx(dense[r.s, r.t, r.p].d, abs=1e-8)
        assert r.c == pytest.approx(dense[r.s, r.t, r.p].c, abs=1e-7)


@pytest.mark.parametrize("change", [{"pipeline": {"stages": ["nonsense"]}}, {"science": {"p_values": [2.0], "reference_p": 1}}, {"science": {"p_values": [0.5, 1.0]}}])
def test_bad_settings(change):
    with pytest.raises(ValueError):
        Config.load(SETTINGS | change)


def test_scratch_tables_go_with_their_scope(spark, tmp_path):
    """Ten tables of the pipeline's kind leave no scratch behind, one inside another neither; what a scope does not own stays."""
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = {x.name for x in folder.iterdir()}
    outside = stored(spark.range(3).toDF("x"), "outside")
    for k in range(10):
        with scratch(spark):
            kept = stored(spark.range(10 + k).toDF("x"), "outer")
            with scratch(spark):
                stored(kept.where("x > 3"), "inner").write.parquet(f"file://{tmp_path}/{k}")
            assert kept.count() == 10 + k
            with pytest.raises(ZeroDivisionError), scratch(spark):
                stored(kept, "broken")
                raise ZeroDivisionError
        left = {x.name.rpartition("-")[0] for x in folder.iterdir() if x.name not in before}
        assert left == {"outside"} and spark.read.parquet(f"file://{tmp_path}/{k}").count() == 6 + k
    assert outside.count() == 3


def test_a_run_leaves_its_own_tables_alone(spark, tmp_path):
    folder = Path(shared_folder(spark).removeprefix("file:"))
    config = Config.load(SETTINGS | {"pipeline": {"stages": ["spectral", "decision"]}})
    toy = stored(toy_population(spark, 10, 4, 3), "toy")
    before = {x.name for x in folder.iterdir()}
    out = run(spark, f"file://{tmp_path}", config, toy.select("s", "n", "rho"), toy.select("s", "y"))
    assert {x.name for x in folder.iterdir()} == before
    assert out["spectral"].count() == 3 and out["decision"].count() == 3

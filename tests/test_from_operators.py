"""Fits and resamples made from operators equal those made from stored pairs."""

import pytest
from pyspark.sql import functions as F

from gramweave.operators import geometry, learning, posthoc, spectral
from tests.test_pairs_of_operators import GRID, distances, operators, same  # noqa: F401


def halves(operators):
    subjects = operators.select("s", F.expr("cast(s % 2 as int)").alias("y"))
    return subjects, learning.stratified_folds(subjects, 3, 2)


def test_bootstrap(operators):  # noqa: F811
    drawn = posthoc.draws(operators.select("s"), 7, 6)
    # Pairs with either of two equal operators tie but for rounding, and losses are in per cent.
    same(posthoc.bootstrap_of_operators(operators, drawn, GRID, 1.0), posthoc.bootstrap(distances(operators).localCheckpoint(), drawn, 1.0), ("p", "b"), 1e-2)


def test_fits_and_their_scores(operators):  # noqa: F811
    subjects, splits = halves(operators)
    grid = learning.Grid((0.1, 1.0), (1.0, 10.0), 2)
    d = distances(operators).localCheckpoint()
    fits = learning.nested_cv_of_operators(operators, GRID[:2], subjects, splits, grid).localCheckpoint()
    want = learning.nested_cv(d.where(F.col("p").isin(*GRID[:2])), subjects, splits, grid)
    columns = ("p", "repeat", "fold", "gamma", "c", "inner_auc", "converged")
    same(fits.select(*columns), want.select(*columns), columns[:3])
    same(learning.reconstruction_of_operators(fits, operators), learning.reconstruction(fits, d), ("p", "repeat", "fold"))


def test_resampled_medians(operators, monkeypatch):  # noqa: F811
    some = operators.where("s <> 20")
    chosen = spectral.selections(some, 7, 5).localCheckpoint()
    want = spectral.resampled_of_operators(some, chosen, GRID[:2]).localCheckpoint()
    monkeypatch.setattr(spectral, "STORED_PAIRS", 0)
    monkeypatch.setattr(spectral, "GROUPS", 3)
    same(spectral.resampled_of_operators(some, chosen, GRID[:2]), want, ("p", "rep"))
    with pytest.raises(ValueError, match="no positive singular value"):
        spectral.resampled_of_operators(operators, operators.select(F.lit(0).alias("rep"), "s"), GRID[:1])


def test_folds_with_train_pairs(operators):  # noqa: F811
    _, splits = halves(operators)
    for some in (operators, operators.where("s in (0, 5)"), operators.where("s = 0")):
        want = geometry.train_diagnostics_of_operators(some, GRID[:2], splits)
        assert sorted(map(tuple, geometry.train_units(some, GRID[:2], splits).collect())) == sorted(tuple(r)[:3] for r in want.collect())

import numpy as np
import pytest

from gramweave.functions import kernels
from gramweave.operators import cells, geometry, learning, posthoc, spectral
from gramweave.plans import inputs
from gramweave.session import stored

GRID = (1.0, 1.5, 2.0, 3.3, 16.0)


def operators(spark, count, n, seed=0):
    """Equal ones, nearly equal ones and others."""
    r = np.random.default_rng(seed)
    a = r.random((count, n, n)) - 0.5
    a = (a + a.transpose(0, 2, 1)) / 6
    a[3], a[4] = a[2], a[2] + 1e-9
    return spark.createDataFrame([(int(s * 7), x.ravel().tolist()) for s, x in enumerate(a)], "s long, rho array<double>")


def test_closed_form_of_eigenvalues():
    r = np.random.default_rng(1)
    a = r.random((300, 3, 3)) - 0.5
    a = a + a.transpose(0, 2, 1)
    a[0], a[1], a[2] = 0, np.eye(3), np.diag([1.0, 1.0, -2.0])
    got = np.stack(kernels.eigenvalues3(*(a[:, i, j] for i, j in ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2)))), axis=1)
    assert np.abs(got - np.linalg.eigvalsh(a)).max() < 1e-7
    for p in (*GRID, float("inf")):
        assert kernels.schatten_of(list(np.abs(got.T)), p) == pytest.approx(kernels.schatten(np.abs(np.linalg.eigvalsh(a)), p), abs=1e-9)


@pytest.mark.parametrize("n", [2, 3])
@pytest.mark.parametrize("tile", [5, 1 << 15])
def test_subject_sums_against_pairs(spark, monkeypatch, n, tile):
    monkeypatch.setattr(cells, "TILE", tile)
    df = operators(spark, 23, n)
    rows = {r.s: np.array(r.rho).reshape(n, n) for r in df.collect()}
    group = lambda s: [s // 7 % 3, 3 + s // 7 % 2 if s else -1]
    member = spark.createDataFrame([(s, [float(g) for g in group(s)]) for s in rows], "s long, member array<double>")
    for gamma in (None, 0.7):
        work = cells.partial(cells._subject_sums, width=n * n, grid=GRID, gamma=gamma, groups=5)
        made = cells.passed(cells.dealt(df.join(member, "s"), cells.F.concat("rho", "member"), 4), work, "p double, s long, total array<double>, square array<double>, most array<double>").collect()
        assert len(made) == 23 * 4 * len(GRID)
        for r in cells.subject_sums(df.join(member, "s"), GRID, 5, gamma, 4).collect():
            d = {t: kernels.schatten(np.abs(np.linalg.eigvalsh(rows[r.s] - a)), r.p) for t, a in rows.items()}
            for g in range(5):
                own = np.array([x for t, x in d.items() if g in group(t)])
                assert r.total[g] == pytest.approx((own if gamma is None else np.exp(-gamma * own**2)).sum(), abs=1e-7)
                if gamma is None:
                    assert (r.square[g], r.most[g]) == (pytest.approx((own**2).sum(), abs=1e-7), pytest.approx(own.max(), abs=1e-7))


def test_scores_of_operators_are_those_of_their_distances(spark):
    df = operators(spark, 20, 3)
    d = geometry.distances(geometry.spectra(df), GRID)
    ids = [r.s for r in df.collect()]
    subjects = spark.createDataFrame([(s, s % 2 if s != 14 else None) for s in ids], "s long, y int")
    splits = spark.createDataFrame([(k, (s // 7 + k) % 3 + 1, s) for k in (1, 2, 5) for s in ids if (k, s) not in {(2, 21), (5, 0)}], "repeat int, fold int, s long")
    want = {(r.p, r.repeat, r.fold, r.s): (r.y, r.score, r.prediction) for r in learning.mean_difference_scores(d, subjects, splits, 0.7).collect()}
    got = {(r.p, r.repeat, r.fold, r.s): (r.y, r.score, r.prediction) for r in learning.mean_difference_of_operators(df, GRID, subjects, splits, 0.7).collect()}
    assert got.keys() == want.keys() and len(got) == 58 * len(GRID)
    for k, (y, score, prediction) in want.items():
        assert got[k] == (y, pytest.approx(score, abs=1e-9), prediction)
    none = splits.limit(0)
    assert learning.mean_difference_of_operators(df, GRID, subjects, none).collect() == []


def test_surrogate_makes_no_row_of_a_pair(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("pairs as rows")

    monkeypatch.setattr(geometry, "paired", refused)
    assert inputs.surrogate(spark, "/root/testdata/sf0.001").count() == 5 * 2 * 10


@pytest.mark.parametrize("bin_rows", [0, 3, 50_000])
def test_places_in_the_order_of_pairs(spark, monkeypatch, bin_rows):
    """Ties, pairs without a value, groups of one or no pair; bins cut down to single values, or put in order."""
    monkeypatch.setattr(cells, "BIN_ROWS", bin_rows)
    df = operators(spark, 19, 3)
    rows = {r.s: np.array(r.rho).reshape(3, 3) for r in df.collect()}
    groups = [lambda s: True, lambda s: s % 2 == 0, lambda s: s < 14, lambda s: s < 7]
    member = spark.createDataFrame([(s, [float(f(s)) for f in groups]) for s in rows], "s long, member array<double>")
    values = cells.partial(geometry._positive_distances, grid=(1.0, 2.0))
    got = {(x["k"], x["g"]): x for x in cells.pair_points(df.join(member, "s"), values, 4, [0.25, 0.5], 3)}
    for k, p in enumerate((1.0, 2.0)):
        for g, own in enumerate(groups):
            ids = [s for s in rows if own(s)]
            d = [kernels.schatten_of(cells.spectrum(rows[s].reshape(1, 9), rows[t].reshape(1, 9)), p)[0, 0] for s in ids for t in ids if s < t]
            d = np.array([x for x in d if x > 0])
            x = got.get((k, g), {"n": 0, "square": 0.0, "points": []})
            assert x["n"] == len(d) and x["square"] == pytest.approx((d**2).sum())
            want = [np.quantile(d, q) for q in (0.25, 0.5)] if len(d) else []
            assert [lo * (1 - at) + hi * at for lo, hi, at in x["points"]] == pytest.approx(want, rel=1e-12)


def test_train_diagnostics_of_operators_are_those_of_their_distances(spark, monkeypatch):
    df = operators(spark, 14, 2)
    ids = [r.s for r in df.collect()]
    splits = spark.createDataFrame([(k, (s // 7 + k) % 3 + 1, s) for k in (1, 4) for s in ids if (k, s) != (4, 21)] + [(5, 1, ids[0]), (5, 2, ids[1])], "repeat int, fold int, s long")
    key = lambda rows: {(r.p, r.repeat, r.fold): r for r in rows.collect()}
    want = key(geometry.train_diagnostics(geometry.distances(geometry.spectra(df), GRID), splits))

    def refused(*_):
        raise AssertionError("pairs as rows")

    monkeypatch.setattr(geometry, "paired", refused)
    got = key(geometry.train_diagnostics_of_operators(df, GRID, splits))
    assert got.keys() == want.keys() and len(got) == 6 * len(GRID)
    for k, r in want.items():
        assert tuple(got[k])[3:] == pytest.approx(tuple(r)[3:], abs=1e-9)
    assert geometry.train_diagnostics_of_operators(df, GRID, splits.limit(0)).collect() == []


def test_summary_of_operators_is_that_of_their_metrics(spark, monkeypatch):
    df = operators(spark, 13, 3).where("s != 21")
    want = spectral.summary(spectral.concentration(spectral.relative_powers(geometry.spectra(df), GRID))).collect()

    def refused(*_):
        raise AssertionError("pairs as rows")

    monkeypatch.setattr(geometry, "paired", refused)
    got = {r.p: r.asDict() for r in spectral.summary_of_operators(df, GRID).collect()}
    assert len(got) == len(want) == len(GRID)
    for r in want:
        assert got[r.p] == pytest.approx(r.asDict(), abs=1e-7)
    with pytest.raises(ValueError, match="no positive singular value"):
        spectral.summary_of_operators(operators(spark, 13, 3), GRID)
    assert spectral.summary_of_operators(df.limit(1), GRID).collect() == []


def test_heterogeneity_and_pair_count_make_no_pair(spark, monkeypatch):
    df = operators(spark, 17, 2)
    d = np.array([r.d for r in geometry.frobenius(df).collect()])
    monkeypatch.setattr(geometry, "paired", None)
    monkeypatch.setattr(geometry, "pairs", None)
    x = geometry.heterogeneity(df).first()
    assert (x.pair_mean, x.pair_rms) == (pytest.approx(d.mean()), pytest.approx((d**2).mean() ** 0.5))
    one = geometry.heterogeneity(df.limit(1)).first()
    assert (one.pair_mean, one.pair_rms, one.about_mean) == (None, None, 0.0)
    ids = [3, 3, 8, 1, 9, 9, 9]
    rows = spark.createDataFrame([(x,) for x in ids], "s long")
    assert geometry.pair_count(rows).first().n == sum(a < b for a in ids for b in ids)
    assert geometry.pair_count(rows.limit(0)).first().n == 0


@pytest.mark.parametrize(("n", "blocks", "block_bytes"), [(3, 1, 1 << 20), (3, 4, 1 << 20), (2, 1, 100), (5, 3, 1 << 20)])
@pytest.mark.parametrize("name", [None, "n{}"])
def test_frobenius_distances_by_tiles(spark, monkeypatch, n, blocks, block_bytes, name):
    """Every pair once, its smaller id first, ids of any kind; equal operators are at 0; no pair has a row of two matrices."""

    def refused(*_):
        raise AssertionError("a row of two matrices")

    monkeypatch.setattr(geometry, "paired", refused)
    monkeypatch.setattr(cells, "BLOCK_BYTES", block_bytes)
    rows = {name.format(r.s) if name else r.s: np.array(r.rho) for r in operators(spark, 23, n).collect()}
    df = spark.createDataFrame([(s, x.tolist()) for s, x in rows.items()], f"s {'string' if name else 'long'}, rho array<double>")
    got = geometry.frobenius(df, blocks).collect()
    assert {(r.s, r.t) for r in got} == {(s, t) for s in rows for t in rows if s < t} and len(got) == 23 * 11
    for r in got:
        assert r.d == pytest.approx(np.linalg.norm(rows[r.s] - rows[r.t]), abs=1e-7)
    assert [r.d for r in got if {r.s, r.t} == {name.format(x) if name else x for x in (14, 21)}] == [0.0]
    assert geometry.frobenius(df.limit(1), blocks).collect() == geometry.frobenius(df.limit(0), blocks).collect() == []


def test_pairs_of_a_cell_come_in_runs_of_one_s(monkeypatch):
    """Tiles of 4 rows and 8 columns: by s a run of 8 at most, with the same ids t as the row before but at the diagonal."""
    monkeypatch.setattr(cells, "TILE", 32)
    monkeypatch.setattr(cells, "RUN", 8)
    r = np.random.default_rng(3)
    a, b, ids = r.random((16, 9)), r.random((24, 9)), r.permutation(40)
    s, t = cells.pa.array(ids[:16]), cells.pa.array(ids[16:])
    for sides, count in ((((s, a), (t, b)), 16 * 24), (((t, b),) * 2, 24 * 23 // 2)):
        made = list(cells._frobenius_distances(iter([sides])))
        assert sum(x.num_rows for x in made) == count and max(x.num_rows for x in made) <= 32
        for x in made:
            one, other = (x.column(c).to_numpy() for c in ("s", "t"))
            assert (one < other).all() and (np.diff(one) >= 0).all() and len(set(one.tolist())) <= 4 and len(set(other.tolist())) <= 8
            assert (np.diff(other)[np.diff(one) == 0] > 0).all()


@pytest.mark.parametrize("bins", [16, 1 << 17])
def test_deformation_of_operators_makes_no_row_of_a_pair(spark, monkeypatch, bins):
    """Equal operators among them; few bins are cut again until few pairs count as tied."""
    df = operators(spark, 40, 3)
    want = {r.p: r.asDict() for r in geometry.deformation(geometry.distances(geometry.spectra(df), GRID), 1.0).collect()}

    def refused(*_):
        raise AssertionError("pairs as rows")

    monkeypatch.setattr(geometry, "paired", refused)
    monkeypatch.setattr(geometry, "SORTED_PAIRS", -1)
    monkeypatch.setattr(cells, "RANK_BINS", bins)
    got = {r.p: r.asDict() for r in geometry.deformation_of_operators(df, GRID, 1.0).collect()}
    assert got.keys() == want.keys() and len(got) == len(GRID)
    for p, row in want.items():
        assert got[p] == pytest.approx(row, abs=1e-6 if bins > 16 else 1e-2)
    assert geometry.deformation_of_operators(df.limit(1), GRID, 1.0).collect() == []


@pytest.fixture(scope="module")
def fields(spark):
    """Weights below and above 0, those that the reference lacks, a kernel that vanishes, support vectors that are held out themselves, folds and p without a gamma or a reference; and the
    result from stored distances."""
    # Not the equal ones: their distances differ by rounding in one form and not in the other.
    df = operators(spark, 40, 3).where("s not in (21, 28)")
    r = np.random.default_rng(5)
    ids = sorted(x.s for x in df.collect())
    splits = [(k, int((s // 7 + k) % 3 + 1), s) for k in (1, 2) for s in ids if (k, s) != (2, 35)]
    held = {(k, f, s) for k, f, s in splits}
    # Equal weights only of those that are not held out: two that were both would have equal values in one form, and in the other such that differ by rounding.
    own = [(p, k, f, s, float(r.normal() if (k, f, s) in held else r.choice([1.0, -0.5, r.normal()]))) for p in (1.0, 2.0, 4.0) for k, f, t in splits for s in (t, (t + 70) % 280) if r.random() < 0.8 and (p, k, f) != (1.0, 2, 3)]
    own = list({x[:4]: x for x in own}.values())
    gammas = [(p, k, f, 1e6 if (p, k, f) == (2.0, 1, 1) else p) for p in (1.0, 2.0, 4.0) for k in (1, 2) for f in (1, 2, 3) if (p, k, f) not in {(4.0, 1, 2), (1.0, 2, 2)}]
    splits, own = spark.createDataFrame(splits, "repeat int, fold int, s long"), spark.createDataFrame(own, "p double, repeat int, fold int, sv long, alpha double")
    gammas = spark.createDataFrame(gammas, "p double, repeat int, fold int, gamma double")
    d = stored(geometry.distances(geometry.spectra(df), (1.0, 2.0, 4.0)), "d")
    return own, splits, df, gammas, by_fold(posthoc.contribution_fields(own, splits, d, gammas, 1.0))


def by_fold(rows):
    return {(x.p, x.repeat, x.fold): x.asDict() for x in rows.collect()}


@pytest.mark.parametrize(("bins", "at_once"), [(16, 60), (1 << 16, 14)])
def test_contribution_fields_of_operators_make_no_row_of_a_pair(spark, fields, monkeypatch, bins, at_once):
    own, splits, df, gammas, want = fields

    def refused(*_):
        raise AssertionError("pairs as rows")

    monkeypatch.setattr(geometry, "paired", refused)
    monkeypatch.setattr(posthoc, "FIELD_PAIRS", -1)
    monkeypatch.setattr(cells, "FIELD_BINS", bins)
    monkeypatch.setattr(cells, "FIELDS", at_once)
    monkeypatch.setattr(cells, "FIELD_SORTED", 1 << 17 if bins > 16 else 50)
    bare = at_once > 14
    got = by_fold(posthoc.contribution_fields_of_operators(own, splits, df, gammas, 1.0, bare, 2))
    assert got.keys() == want.keys() and len(got) == 13
    for k, row in want.items():
        if not bare:
            del row["reference_kernel_spearman"]
        assert got[k] == pytest.approx(row, abs=1e-6 if bins > 16 else 2e-2), k
    assert posthoc.contribution_fields_of_operators(own.limit(0), splits, df, gammas, 1.0).collect() == []

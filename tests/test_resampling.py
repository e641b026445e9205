import itertools

import numpy as np
import pandas as pd
import pytest

from gramweave.operators import posthoc


@pytest.mark.parametrize("kind", ["normal", "ties", "near", "far"])
def test_gaps_without_pairs(kind):
    draw = np.random.default_rng(7)
    for n in (2, 3, 17, 40):
        z = {"normal": lambda: draw.normal(size=n), "ties": lambda: draw.integers(0, 3, n).astype(float), "near": lambda: 1.0 + 1e-16 * draw.integers(0, 9, n), "far": lambda: draw.normal(size=n) * 10.0 ** draw.integers(-200, 200, n)}[kind]()  # noqa: B023
        gaps = sorted(abs(a - b) for a, b in itertools.combinations(z, 2))
        for place in {0, len(gaps) // 10, len(gaps) // 2, len(gaps) - 1}:
            assert posthoc.gap(z, place) == gaps[place]


def test_gaps_of_many_subjects():
    z = np.random.default_rng(1).normal(size=200_000)
    middle = posthoc.gap(z, len(z) * (len(z) - 1) // 4)
    assert middle == pytest.approx(0.9538725524, abs=5e-3)


@pytest.mark.parametrize(("subjects", "most"), [(12, 1000), (30, 8)])
def test_bootstrap_equals_listing_every_copy(spark, subjects, most):
    draw = np.random.default_rng(3)
    rows = [(p, s, t, float(draw.integers(0, 12)) / 4 if p == 2.0 else float(draw.normal())) for p in (1.0, 2.0) for s in range(subjects) for t in range(s + 1, subjects)]
    drawn = [(b, slot, int(draw.integers(0, subjects))) for b in range(60) for slot in range(min(subjects, most))] + [(60, k, 3) for k in range(5)]
    d = spark.createDataFrame(rows, "p double, s long, t long, d double")
    got = {(r.p, r.b): r for r in posthoc.bootstrap(d, spark.createDataFrame(drawn, "b int, slot int, s long"), 1.0, most).collect()}
    known = {(p, s, t): x for p, s, t, x in rows}
    frame = pd.DataFrame(drawn, columns=["b", "slot", "s"])
    for b, own in frame.groupby("b"):
        pairs = [(min(x, y), max(x, y)) for x, y in itertools.combinations(own["s"].tolist(), 2) if x != y]
        for p in (1.0, 2.0):
            if not pairs:
                assert (p, b) not in got
                continue
            x, x0 = (pd.Series([known[q, *pair] for pair in pairs]) for q in (p, 1.0))
            r = got[p, b]
            assert r.n_pairs == len(pairs)
            assert r.scale_contraction_pct == pytest.approx(100 * (1 - x.median() / x0.median()), abs=1e-9)
            if len(pairs) >= 3 and x.nunique() > 1:
                assert r.ordering_loss_pct == pytest.approx(100 * (1 - x.rank().corr(x0.rank())), abs=1e-9)

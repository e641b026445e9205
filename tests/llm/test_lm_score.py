import math
import random
import re
from collections import Counter

import pytest

from gramweave.llm import lm_score
from gramweave.llm.lm_score import backoff_scores, packed, unpacked


def brute(rows, order, alpha, least):
    split = [re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or "")) for _, t in rows]
    c = Counter(tuple(w[i : i + k]) for w in split for k in range(1, order + 1) for i in range(len(w) - k + 1))
    n = sum(map(len, split))

    def s(gram):
        if len(gram) == 1:
            return c[gram] / n
        return c[gram] / c[gram[:-1]] if c[gram] >= least else alpha * s(gram[1:])

    out = []
    for (i, _), w in zip(rows, split, strict=True):
        grams = [tuple(w[max(0, j - order + 1) : j + 1]) for j in range(len(w))]
        out.append((i, len(w), sum(math.log(s(g)) for g in grams), sum(len(g) > 1 and c[g] < least for g in grams), sum(c[g] == 1 for g in grams)))
    return out


@pytest.mark.parametrize(("order", "least"), [(1, 2), (2, 2), (3, 1), (3, 2), (4, 2)])
def test_against_brute_force(spark, monkeypatch, order, least):
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 500)
    monkeypatch.setattr(lm_score, "RANGE_BYTES", 10)
    r = random.Random(order)
    vocab = ["a", "b", "C", "é", "dd", "x\x00", "1,", "the"]
    rows = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([0, 1, 2, 5, 40])))) for i in range(60)]
    rows += [(60, None), (61, " \n"), (3, rows[3][1]), (3, rows[3][1]), (None, "a b a b")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_words int").repartition(3)
    got = backoff_scores(df, order, 0.4, least).collect()
    key = lambda x: (str(x[0]), x[1])
    for a, b in zip(sorted(((g.doc_id, g.n_words, g.log_score, g.n_backoff, g.n_once) for g in got), key=key), sorted(brute(rows, order, 0.4, least), key=key), strict=True):
        assert a[:2] == b[:2] and a[3:] == b[3:] and math.isclose(a[2], b[2], abs_tol=1e-9)
    assert all((g.mean_log is None) == (g.n_words == 0) for g in got)


@pytest.mark.parametrize("parts", [1, 3, 256, 257, 1000, 65536])
def test_parts_of_a_lead(parts):
    import numpy as np

    h = np.sort(np.random.default_rng(parts).integers(5 << 56, 6 << 56, 3000, dtype=np.uint64))
    pieces = np.split(h, lm_score.cuts(h, parts))
    assert len(pieces) == parts
    for k, own in enumerate(pieces):
        if len(own):
            lo, hi = lm_score.seconds_of(k, parts)
            assert (unpacked(5, *packed(own, lo, hi), lo) == own).all()


def test_counts_of_another_block_are_refused():
    import numpy as np

    with pytest.raises(ValueError, match="counts for a block"):
        lm_score.spread([np.array([0, 5, 9], np.uint64)], np.array([1]))


def test_string_ids(spark):
    got = backoff_scores(spark.createDataFrame([("x", "a b"), (None, "a")], "doc_id string, text string")).collect()
    assert {r.doc_id: r.n_once for r in got} == {"x": 1, None: 0}


def test_packing_and_empty(spark):
    import numpy as np

    h = np.sort(np.random.default_rng(1).integers(5 << 56, 6 << 56, 1000, dtype=np.uint64))
    assert (unpacked(5, *packed(h)) == h).all()
    assert len(unpacked(7, *packed(h[:0]))) == 0
    assert backoff_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert backoff_scores(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()[0].log_score == 0

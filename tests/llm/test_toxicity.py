import random
import zlib

import numpy as np

from gramweave.llm.toxicity import expected_moves, marginals, op6_toxicity, reject, score, train


def brute(scores, moves):
    """Marginals and expected moves of one document by summing over all tag sequences."""
    n = len(scores)
    p, moved, total = np.zeros(n), np.zeros(4), 0.0
    for m in range(1 << n):
        y = [m >> i & 1 for i in range(n)]
        kinds = [2 * a + b for a, b in zip(y, y[1:], strict=False)]
        w = np.exp(sum(s for s, k in zip(scores, y, strict=True) if k) + sum(moves[k] for k in kinds))
        total += w
        p += w * np.array(y)
        for k in kinds:
            moved[k] += w
    return p / total, moved / total


def test_forward_backward():
    r = np.random.default_rng(1)
    moves = np.array([0.3, -1.2, -0.4, 0.8])
    sizes = [4, 0, 1, 7, 3]
    first = np.r_[0, np.cumsum(sizes)]
    scores = r.normal(size=first[-1])
    got = marginals(scores, first, moves)
    total = np.zeros(4)
    for a, b in zip(first, first[1:], strict=False):
        if b > a:
            p, m = brute(scores[a:b], moves)
            assert np.allclose(got[a:b], p)
            total += m
    assert np.allclose(expected_moves(got, scores, first, moves), total)


def corpus(n=400):
    r = random.Random(4)
    vocab = [a + b for a in ("ka", "lo", "mi", "tu", "re") for b in ("na", "so", "vi", "du", "pe", "ro")]
    bad = ["idiot", "gruxa", "gruxo", "gruxin", "gruxel"]
    rows, labels = [], []
    for i in range(n):
        w = [r.choice(vocab) for _ in range(r.randint(5, 90))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_spans(spark):
    rows, labels = corpus()
    df = spark.createDataFrame([(i, t, 0.0) for i, t in rows] + [(900, None, 0.0), (901, "", 0.0), (902, "...", None)], "doc_id long, text string, score double")
    lab = spark.createDataFrame(labels + [(900, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in op6_toxicity(df, lab).collect()}
    held = [(i, y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i, _ in held)
    assert np.mean([got[i].predicted == y for i, y in held]) > 0.95
    assert all(got[i].predicted == 0 for i in (900, 901, 902))
    texts = dict(rows)
    spans = [texts[i][a:b] for i in texts if got[i].predicted for a, b in zip(got[i].span_start, got[i].span_end, strict=True)]
    assert spans and np.mean([any(w.startswith(("idiot", "grux")) for w in s.split()) for s in spans]) > 0.9
    left = reject(df, train(df, lab))
    assert left.columns == df.columns
    assert {900, 901, 902} <= {r.doc_id for r in left.collect()}


def test_without_labels(spark):
    df = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in op6_toxicity(df, none).collect()] == [0, 0]
    assert score(df.limit(0), train(df, none)).count() == 0


def test_no_rows_and_rows_without_text(spark):
    schema = "doc_id long, text string, score double, held_out int"
    labels = spark.createDataFrame([(1, 0, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert op6_toxicity(spark.createDataFrame([], schema), labels).count() == 0
    got = op6_toxicity(spark.createDataFrame([(None, None, 1.0, 1), (3, "", 1.0, 1), (3, "", 1.0, 1)], schema), labels.limit(0)).collect()
    assert len(got) == 3 and len({r.score for r in got}) == 1 and all(r.predicted == 0 and 0 <= r.score < 0.5 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]

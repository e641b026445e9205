"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Two states (clean, toxic) run along the words of a text.  A word's score is a sum of hashed weights: the word, its prefixes and suffix,
its shape and its neighbours.  Forward-backward gives each word's marginal; a document's score is a logistic function of the largest and
the summed marginals, and runs of words with a marginal of one half or more are its offending spans.

Word labels for training come from document labels: words and word beginnings that stand in many toxic and hardly any clean documents mark
the toxic words of toxic documents (``mark_tokens``); tables that have word labels can be fitted directly (``fit``).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from gramweave.llm.store import written
from gramweave.llm.textkernel import LOWER, Words, alnum_table, mix, words

#: The fit reads so many labelled documents of each class at most, none longer than TRAIN_CHARS; it is the only bound on what is read.
TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_CHARS = 1500, 2500, 20_000
BITS, EPOCHS, RATE = 20, 12, 0.15
PREFIXES = (3, 4, 5, 6)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    #: Log-weights of the moves clean-clean, clean-toxic, toxic-clean, toxic-toxic.
    moves: np.ndarray
    #: Intercept and the factors of the largest marginal's log-odds and of the log of the summed marginals.
    head: np.ndarray


def feature_keys(part: Words) -> np.ndarray:
    """(features, words) hashes of each word's features; the part's buffer keeps its case, hashes fold it."""
    n = len(part.start)
    low = Words.__new__(Words)
    low.buf, low._sums = LOWER[part.buf], None
    word = low.range_hash(part.start, part.end)
    rows = [word]
    for k in PREFIXES:
        cut = np.minimum(part.start + k, part.end)
        rows.append(np.where(part.end - part.start > k, low.range_hash(part.start, cut), word) + np.uint64(k))
    rows.append(low.range_hash(np.maximum(part.end - 4, part.start), part.end) + np.uint64(17))
    first = part.buf[part.start] if n else np.zeros(0, np.uint8)
    upper = (first >= 65) & (first <= 90)
    length = np.minimum(part.end - part.start, 15)
    rows.append((upper.astype(np.uint64) << np.uint64(8)) + length.astype(np.uint64) + np.uint64(0xABCD))
    inner = np.ones(n, bool)
    inner[part.first[:-1][part.first[:-1] < n]] = False
    before = np.zeros(n, np.uint64)
    before[1:] = np.where(inner[1:], word[:-1], 0)
    after = np.zeros(n, np.uint64)
    after[:-1] = np.where(inner[1:], word[1:], 0)
    rows += [before + np.uint64(0x51), after + np.uint64(0x77)]
    salt = (np.arange(1, len(rows) + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))[:, None]
    return mix(np.stack(rows) ^ salt)


def feature_slots(keys: np.ndarray) -> np.ndarray:
    """Places of the features in the weight table."""
    return (keys & np.uint64((1 << BITS) - 1)).astype(np.int32)


def marginal_odds(scores: np.ndarray, first: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the words of documents first[d] to first[d + 1]: forward odds, backward odds of toxic to clean, and each word's emission.

    Documents advance together, longest first; at step t only those with more than t words take part.
    """
    emit = np.exp(np.clip(scores, -30, 30))
    a, b, c, d = np.exp(moves)
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, size = first[:-1][order], size[order]
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), side="left")
    forward, backward = np.ones(len(scores)), np.ones(len(scores))
    if longest:
        at = begin[: active[0]]
        held = emit[at]
        forward[at] = held
        for t in range(1, longest):
            k = active[t]
            held = held[:k]
            at = begin[:k] + t
            held = emit[at] * (b + d * held) / (a + c * held)
            forward[at] = held
        # Ends differ, so the way back starts a document when the step reaches its last word.
        held = np.ones(0)
        for t in range(longest - 1, -1, -1):
            k = active[t]
            nxt = np.ones(k)
            if len(held):
                out = emit[begin[: len(held)] + t + 1] * held
                nxt[: len(held)] = (c + d * out) / (a + b * out)
            held = nxt
            backward[begin[:k] + t] = held
    return forward, backward, emit


def marginals(scores: np.ndarray, first: np.ndarray, moves: np.ndarray) -> np.ndarray:
    forward, backward, _ = marginal_odds(scores, first, moves)
    odds = forward * backward
    return odds / (1 + odds)


def expected_moves(p: np.ndarray, scores: np.ndarray, first: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Summed probabilities of the four moves under the model."""
    forward, backward, emit = marginal_odds(scores, first, moves)
    inner = np.ones(len(scores), bool)
    inner[first[:-1][first[:-1] < len(scores)]] = False
    nxt = np.flatnonzero(inner)
    f, out = forward[nxt - 1], emit[nxt] * backward[nxt]
    a, b, c, d = np.exp(moves)
    joint = np.stack([np.full(len(nxt), a), b * out, c * f, d * f * out])
    return (joint / joint.sum(axis=0)).sum(axis=1)


def fit(slots: np.ndarray, first: np.ndarray, tags: np.ndarray, toxic: np.ndarray, prior: float = 0.5) -> Model:
    """Conditional likelihood by AdaGrad over batches of documents; then the document head, on the fitted documents' marginals.

    slots: (features, words); first: word offsets of documents; tags: 0 or 1 a word; toxic: 0 or 1 a document;
    prior: the share of toxic documents that scores are to fit.
    """
    rng = np.random.default_rng(7)
    model = Model(np.zeros(1 << BITS, np.float64), -3.0, np.log(np.array([0.97, 0.03, 0.6, 0.4])), np.array([-2.0, 1.0, 0.5]))
    gain, gain_bias, gain_moves = np.full(1 << BITS, 1e-6), 1e-6, np.full(4, 1e-6)
    # Documents of like length share a batch: a batch takes as many steps as its longest has words.
    docs = np.argsort(np.diff(first), kind="stable")
    groups = [np.sort(docs[lo : lo + 64]) for lo in range(0, len(docs), 64)]
    for _ in range(EPOCHS):
        for some in (groups[i] for i in rng.permutation(len(groups))):
            at = np.concatenate([np.arange(first[d], first[d + 1]) for d in some]) if len(some) else np.zeros(0, int)
            if not len(at):
                continue
            own = np.r_[0, np.cumsum(first[some + 1] - first[some])]
            s, y = slots[:, at], tags[at]
            scores = model.weights[s].sum(axis=0) + model.bias
            p = marginals(scores, own, model.moves)
            err = p - y
            grad = np.bincount(s.ravel(), np.broadcast_to(err, s.shape).ravel(), 1 << BITS)
            hit = np.flatnonzero(grad)
            g = grad[hit] + 1e-3 * model.weights[hit]
            gain[hit] += g * g
            model.weights[hit] -= RATE * g / np.sqrt(gain[hit])
            inner = np.ones(len(at), bool)
            inner[own[:-1][own[:-1] < len(at)]] = False
            nxt = np.flatnonzero(inner)
            seen = np.bincount(2 * y[nxt - 1].astype(int) + y[nxt].astype(int), minlength=4)
            gm = (expected_moves(p, scores, own, model.moves) - seen) / 64
            gain_moves += gm * gm
            model.moves -= 0.02 * gm / np.sqrt(gain_moves)
            gb = err.sum() / 64
            gain_bias += gb * gb
            model.bias -= 0.05 * gb / np.sqrt(gain_bias)
    scores = np.zeros(slots.shape[1])
    for row in slots:
        scores += model.weights[row]
    p = marginals(scores + model.bias, first, model.moves)
    x = document_features(p, first)
    w = np.zeros(3)
    balance = np.where(toxic == 1, prior / max(1, (toxic == 1).sum()), (1 - prior) / max(1, (toxic == 0).sum()))
    for _ in range(400):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ ((q - toxic) * balance) + 1e-3 * w
        hess = (x * (balance * np.maximum(q * (1 - q), 1e-4))[:, None]).T @ x + 1e-3 * np.eye(3)
        w -= 0.5 * np.linalg.solve(hess, grad)
    model.head, model.weights = w, model.weights.astype(np.float32)
    return model


def document_features(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(documents, 3): 1, the largest marginal's log-odds and the log of the summed marginals; a document without words has the least."""
    docs = len(first) - 1
    most, total = np.zeros(docs), np.zeros(docs)
    has = np.flatnonzero(np.diff(first) > 0)
    if len(has):
        most[has] = np.maximum.reduceat(p, first[:-1][has])
        total[has] = np.add.reduceat(p, first[:-1][has])
    most = np.clip(most, 1e-6, 1 - 1e-6)
    return np.stack([np.ones(docs), np.log(most / (1 - most)), np.log(total + 1e-2)], axis=1)


#: Rows of the features by which words are marked: the word, and its beginnings of 4 to 6 bytes.
MARKS = (0, 2, 3, 4)


def mark_tokens(keys: np.ndarray, first: np.ndarray, toxic: np.ndarray, chance: float = 1.0, pure: float = 0.9) -> np.ndarray:
    """1 for the words of toxic documents of which the word itself or one of its beginnings is toxic.

    A key (a word, or a beginning of 4 to 6 bytes) is toxic if the share of toxic documents among those that have it, rates being
    balanced between the classes, is above ``pure``, and if so many toxic ones would be expected of fewer than ``chance`` of all
    keys, were each document that has the key toxic with the share of words that toxic documents hold.
    """
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    n1, n0 = max(1, int((toxic == 1).sum())), max(1, int((toxic == 0).sum()))
    share = min(0.9, max(n1 / (n1 + n0), float((toxic[doc] == 1).mean()) if len(doc) else 0.0))
    tags = np.zeros(keys.shape[1], np.int8)
    for row in keys:
        names, at = np.unique(row, return_inverse=True)
        pairs = np.unique(at.astype(np.int64) * len(first) + doc)
        key, is_toxic = pairs // len(first), toxic[pairs % len(first)] == 1
        with_toxic, with_clean = np.bincount(key[is_toxic], minlength=len(names)), np.bincount(key[~is_toxic], minlength=len(names))
        r1, r0 = with_toxic / n1, (with_clean + 0.25) / n0
        marked = np.zeros(len(names), bool)
        candidates = np.flatnonzero((with_toxic >= 3) & (r1 / (r1 + r0) > pure))
        for i in candidates:
            marked[i] = len(names) * binomial_tail(int(with_toxic[i]), int(with_toxic[i] + with_clean[i]), share) < chance
        tags |= marked[at].astype(np.int8)
    return tags * (toxic[doc] == 1)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) >= k)."""
    return sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * log(p) + (n - j) * log(1 - p)) for j in range(k, n + 1))


def fit_rows(table: pa.Table, prior: float) -> Model:
    """The model of rows (doc_id, toxic, text)."""
    toxic = table.column("toxic").to_numpy().astype(np.int64)
    if len(set(toxic.tolist())) < 2:
        return Model(np.zeros(1 << BITS, np.float32), -9.0, np.log(np.array([0.97, 0.03, 0.6, 0.4])), np.array([-3.0, 0.0, 0.0]))
    slots, marks, first, held = [], [], [0], 0
    for part in words(table.column("text").combine_chunks(), alnum_table(), lower=False):
        keys = feature_keys(part)
        slots.append(feature_slots(keys))
        marks.append(keys[list(MARKS)])
        first += (held + part.first[1:]).tolist()
        held = first[-1]
    bounds = np.array(first)
    tags = mark_tokens(np.concatenate(marks, axis=1), bounds, toxic)
    return fit(np.concatenate(slots, axis=1), bounds, tags, toxic, prior)


def _fit(batches: Iterator[pa.RecordBatch], prior: float) -> Iterator[pa.RecordBatch]:
    """All rows of the one partition in, the pickled model out."""
    held = list(batches)
    if held:
        rows = pa.Table.from_batches(held).sort_by([("doc_id", "ascending")])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit_rows(rows, prior))], pa.binary())], ["model"])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on at most TRAIN_TOXIC and TRAIN_CLEAN documents (doc_id, text) whose label (doc_id, toxic) is 1 or 0.

    The fit runs in one executor task, and the driver gets the model alone.  The sample goes by a hash of doc_id; documents over
    TRAIN_CHARS characters or without text are not fitted on.  A doc_id that has both labels, or a null label, is left out; of the texts
    of a repeated doc_id the least counts.  Without any labelled document of a class, the model scores every text alike.
    """
    ids = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").alias("doc_id")).agg(F.min("toxic").cast("int").alias("toxic"), F.max("toxic").alias("top")).where("toxic = top").select("doc_id", "toxic")
    ids = written(ids, "labels")
    draw = F.xxhash64(F.lit("sample"), "doc_id")
    counts = {int(r.toxic): r["count"] for r in ids.groupBy("toxic").count().collect()}
    chosen = written(ids.where("toxic = 1").orderBy(draw, "doc_id").limit(TRAIN_TOXIC).unionByName(ids.where("toxic = 0").orderBy(draw, "doc_id").limit(TRAIN_CLEAN)), "chosen")
    read = docs.select("doc_id", "text").where(F.length("text").between(1, TRAIN_CHARS)).join(F.broadcast(chosen), "doc_id")
    rows = read.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text"))
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    made = rows.coalesce(1).mapInArrow(partial(_fit, prior=prior), "model binary").collect()
    return pickle.loads(made[0].model) if made else fit_rows(pa.table({"toxic": pa.array([], pa.int64())}), prior)


def _score(batches: Iterator[pa.RecordBatch], shared: Broadcast, spans: bool) -> Iterator[pa.RecordBatch]:
    model, table = shared.value, alnum_table()
    weights = model.weights
    for batch in batches:
        for lo in range(0, batch.num_rows, 4096):
            piece = batch.slice(lo, 4096)
            scores, first, where = [], [np.zeros(1, np.int64)], []
            held = 0
            for part in words(piece.column("text"), table, lower=False):
                slots = feature_slots(feature_keys(part))
                total = np.full(slots.shape[1], model.bias)
                for row in slots:
                    total += weights[row]
                scores.append(total)
                first.append(held + part.first[1:])
                held += len(total)
                if spans:
                    chars = np.r_[0, np.cumsum((part.buf & 0xC0) != 0x80)]
                    base = np.repeat(chars[part.offsets[:-1]], np.diff(part.first))
                    where.append((chars[part.start] - base, chars[part.end] - base))
            bounds = np.concatenate(first)
            p = marginals(np.concatenate(scores) if scores else np.zeros(0), bounds, model.moves)
            score = 1 / (1 + np.exp(-np.clip(document_features(p, bounds) @ model.head, -30, 30)))
            cols = [c for n, c in zip(piece.schema.names, piece.columns, strict=True) if n != "text"] + [pa.array(score)]
            names = [n for n in piece.schema.names if n != "text"] + ["score"]
            if spans:
                start, end = (np.concatenate(x) for x in zip(*where, strict=True)) if where else (np.zeros(0), np.zeros(0))
                from_, to = [], []
                hot = p >= 0.5
                for d in range(piece.num_rows):
                    on = np.flatnonzero(hot[bounds[d] : bounds[d + 1]]) + bounds[d]
                    cut = np.flatnonzero(np.diff(on) > 1)
                    from_.append(start[on[np.r_[0, cut + 1]]].tolist() if len(on) else [])
                    to.append(end[on[np.r_[cut, len(on) - 1]]].tolist() if len(on) else [])
                cols += [pa.array(from_, pa.list_(pa.int64())), pa.array(to, pa.list_(pa.int64()))]
                names += ["span_start", "span_end"]
            yield pa.RecordBatch.from_arrays(cols, names)


def score(docs: DataFrame, model: Model, spans: bool = True) -> DataFrame:
    """doc_id, score, span_start and span_end (character offsets of the toxic runs) of every row of ``docs`` (doc_id, text).

    Null, empty and wordless texts get the score of a text without any sign; the whole of a long text is scored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.select("doc_id", "text")
    fields = [out.schema["doc_id"], StructField("score", DoubleType())]
    if spans:
        fields += [StructField(c, ArrayType(LongType())) for c in ("span_start", "span_end")]
    return out.mapInArrow(partial(_score, shared=shared, spans=spans), StructType(fields))


def op6_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the spans of every row; labels are learnt from where crc32(doc_id) mod 5 is not 0.

    Every row of ``docs`` (doc_id, text; other columns are ignored) is scored by its own whole text, so repeated rows score alike; null and empty texts have no
    spans and the score of a text without marked words.  A null doc_id is not held out.  A doc_id with both labels counts as unlabelled, and without
    labelled rows of both classes all scores are one value under one half.  A score of one half is predicted toxic.  No documents give no rows.
    """
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = train(docs, labels.where(~out))
    scored = score(docs, model)
    held = F.coalesce(out, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "span_start", "span_end")


def _pass(batches: Iterator[pa.RecordBatch], shared: Broadcast, threshold: float, text: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        one = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(text)], ["doc_id", "text"])
        low = np.concatenate([x.column("score").to_numpy() < threshold for x in _score(iter([one]), shared, False)] or [np.zeros(0, bool)])
        yield batch.filter(pa.array(low))


def reject(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``docs``, all its columns, without the rows whose text scores ``threshold`` or more; every row is judged by its own text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(partial(_pass, shared=shared, threshold=threshold, text=docs.columns.index("text")), docs.schema)

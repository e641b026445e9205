"""Stupid-backoff language model scores, relationally: n-gram counts partitioned by hash, joined to the texts' n-grams.

Texts are dealt to blocks of some megabytes.  A block's distinct n-grams (all orders in one 64-bit hash space) leave it as one row for
each range of hashes, packed: a relation (block, range, n-grams, counts) whose rows are arrays.  Grouping it by range gives the count
table of that range and, in the same pass, joins it back to the blocks: a row (block, range, corpus counts) in the n-grams' order.  A block
then has the corpus count of each of its n-grams and sums its documents' scores.

S(w | h) = c(hw) / c(h) if c(hw) >= ``least``, else alpha * S(w | shorter h); with no history c(w) / N.  c(h) is the count of the history as an
n-gram.  Counts are over all documents.  ``least`` is 1; with 2 an n-gram's own occurrence says nothing.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from gramweave.llm.store import fresh, written
from gramweave.llm.textkernel import mix, space_table, utf8, words

ORDER, ALPHA, LEAST = 3, 0.4, 1
#: Text bytes of a block, and hash ranges: a range has about 1/256 of all distinct n-grams, cut further for large corpora.
BLOCK_BYTES, RANGE_BYTES = 16 << 20, 64 << 20


def grams(column: pa.Array, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For k = 1 to ``order``, the hash of the k words that end at each word (0: the text has fewer before it); and word offsets."""
    table, hashes, first, held = space_table(), [], [np.zeros(1, np.int64)], 0
    for part in words(column, table):
        hashes.append(part.hashes())
        first.append(held + part.first[1:])
        held += len(hashes[-1])
    h, first = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.concatenate(first)
    place = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
    out, total = [], np.zeros(len(h), np.uint64)
    for k in range(order):
        back = np.zeros(len(h), np.uint64)
        back[k:] = h[: len(h) - k]
        total = total + mix(back + np.uint64(2 * k + 1)) * np.uint64(2 * k + 3)
        g = mix(total ^ np.uint64(k + 1))
        g[g == 0] = 1
        g[place < k] = 0
        out.append(g)
    return out, first


def seconds_of(part: int, parts: int) -> tuple[int, int]:
    """The second bytes, from and up to, of the hashes in a part of a lead."""
    return (part << 16) // parts >> 8, (((part + 1) << 16) // parts - 1) >> 8


def cuts(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Where sorted hashes of one leading byte are cut into parts, by their second and third byte."""
    return np.searchsorted((hashes >> np.uint64(40)) & np.uint64(0xFFFF), ((np.arange(1, parts, dtype=np.int64) << 16) // parts).astype(np.uint64))


def packed(hashes: np.ndarray, lo: int = 0, hi: int = 255) -> tuple[bytes, bytes]:
    """Sorted hashes of one leading byte: how many have each second byte from ``lo`` to ``hi``, and the six bytes below."""
    second = ((hashes >> np.uint64(48)) & np.uint64(255)).astype(np.int64) - lo
    return np.bincount(second, minlength=hi - lo + 1).astype(np.uint32).tobytes(), hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(lead: int, seconds: bytes, rest: bytes, lo: int = 0) -> np.ndarray:
    counts = np.frombuffer(seconds, np.uint32)
    second = np.repeat(np.arange(lo, lo + len(counts), dtype=np.uint64), counts)
    out = np.zeros((len(second), 8), np.uint8)
    out[:, :6] = np.frombuffer(rest, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel() | second << np.uint64(48) | np.uint64(lead) << np.uint64(56)


def distinct(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes other than 0, and their counts; ``hashes`` is emptied to free its arrays."""
    every = np.concatenate(hashes)
    hashes.clear()
    every.sort()
    every = every[np.searchsorted(every, np.uint64(1)) :]
    at = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.zeros(0, np.int64)
    return every[at], np.diff(np.r_[at, len(every)])


def small(counts: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as a byte each; 255 stands for those that are at least that, which follow as longs."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes(), counts[counts >= 255].astype(np.int64).tobytes()


def large(low: bytes, high: bytes) -> np.ndarray:
    out = np.frombuffer(low, np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(high, np.int64)
    return out


SENT = "block string, lead int, part int, seconds binary, rest binary, low binary, high binary"
ANSWER = "block string, lead int, part int, low binary, high binary"
KINDS = {"block": pa.string(), "lead": pa.int32(), "part": pa.int32()}


def _rows(rows: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({c: pa.array(v, KINDS.get(c, pa.binary())) for c, v in rows.items()})


def _send(batches: Iterator[pa.RecordBatch], folder: str, order: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Writes the task's rows to block files in the shared folder and emits each block's n-grams."""
    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    task = TaskContext.get().partitionId()
    held, size, made = [], 0, 0

    def block() -> pa.RecordBatch:
        nonlocal made
        table = pa.Table.from_batches(held)
        # A task that runs again makes the same blocks of the same rows, so names go by place and contents: should rows come out otherwise
        # the second time, the names differ, and a block that got answers to another's n-grams is found out when it is summed.
        ids, text = table.column("doc_id").combine_chunks(), pa.concat_arrays(table.column("text").chunks)
        data, offsets = utf8(text)
        seal = hashlib.blake2b(repr(ids.to_pylist()).encode(), digest_size=8)
        seal.update(offsets - offsets[0])
        seal.update(data[offsets[0] : offsets[-1]])
        name, draft = f"{task}-{made}-{seal.hexdigest()}", f"{path}/draft-{uuid.uuid4().hex}"
        made += 1
        pq.write_table(table, draft, filesystem=fs, compression="zstd", compression_level=6, row_group_size=2048)
        try:
            fs.move(draft, f"{path}/{name}.parquet")
        except OSError:  # a store whose rename does not replace: the block is there already
            fs.delete_file(draft)
        found, counts = distinct(grams(text, order)[0])
        cut = np.searchsorted(found, np.arange(1, 256, dtype=np.uint64) << np.uint64(56))
        rows: dict[str, list] = {c.split()[0]: [] for c in SENT.split(", ")}
        for lead, (own, n) in enumerate(zip(np.split(found, cut), np.split(counts, cut), strict=True)):
            steps = cuts(own, parts)
            for part, (some, m) in enumerate(zip(np.split(own, steps), np.split(n, steps), strict=True)):
                # A block sends rows for the ranges that it has n-grams in, and one at least.
                if len(some) or (not len(found) and lead == part == 0):
                    for c, v in zip(rows, (name, lead, part, *packed(some, *seconds_of(part, parts)), *small(m)), strict=True):
                        rows[c].append(v)
        held.clear()
        return _rows(rows)

    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            piece = batch.slice(lo, 256)
            held.append(piece)
            size += sum(len(t.as_buffer()) for t in piece.column("text") if t.is_valid)
            if size >= BLOCK_BYTES:
                size = 0
                yield block()
    if held:
        yield block()


def _answer(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (lead, part): each range's table is made, and its blocks' counts are answered."""
    held: list[tuple[str, np.ndarray, np.ndarray]] = []
    at: tuple[int, int] | None = None

    def table() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        every = np.concatenate([h for _, h, _ in held])
        names, where = np.unique(every, return_inverse=True)
        total = np.bincount(where, np.concatenate([c for _, _, c in held]), len(names)).astype(np.int64)
        lo = 0
        for block, h, _ in held:
            own = total[where[lo : lo + len(h)]]
            lo += len(h)
            yield _rows(dict(zip(("block", "lead", "part", "low", "high"), ([v] for v in (block, *at, *small(own))), strict=True)))
        held.clear()

    for batch in batches:
        for block, lead, part, seconds, rest, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (lead, part) != at:
                yield from table()
                at = (lead, part)
            held.append((block, unpacked(lead, seconds, rest, seconds_of(part, parts)[0]), large(low, high)))
    yield from table()


def spread(found: list[np.ndarray], known: np.ndarray) -> list[np.ndarray]:
    """``known`` has the counts of the sorted distinct hashes other than 0; here they come in the words' order, 0 for the hash 0.  ``found`` is
    emptied to free its arrays."""
    orders, every = len(found), np.concatenate(found)
    found.clear()
    order = np.argsort(every)
    every = every[order]
    none = int(np.searchsorted(every, np.uint64(1)))
    if none < len(every):
        run = np.cumsum(np.r_[False, every[none + 1 :] != every[none:-1]])
    else:
        run = np.zeros(0, np.int64)
    del every
    grams_ = int(run[-1]) + 1 if len(run) else 0
    if len(known) != grams_:
        raise ValueError(f"{len(known)} counts for a block of {grams_} n-grams: its rows came out otherwise when they were computed again")
    if len(known) != (int(run[-1]) + 1 if len(run) else 0):
        raise ValueError(f"{len(known)} counts came back for a block of {int(run[-1]) + 1 if len(run) else 0} n-grams: its rows came out otherwise when they were computed again")
    out = np.zeros(len(order), np.int64)
    out[order[none:]] = known[run]
    return np.split(out, orders)


def score_words(c: list[np.ndarray], there: list[np.ndarray], alpha: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Each word's log score and the order that gave it; where that is 1, the score is short of -ln N.

    c: corpus counts of the n-grams that end at each word, by order; there: whether the text has so many words up to it.
    """
    out, used = np.log(np.maximum(c[0], 1)), np.ones(len(c[0]), np.int64)
    penalty = np.zeros(len(out))
    done = np.zeros(len(out), bool)
    for k in range(len(c) - 1, 0, -1):
        history = np.r_[0, c[k - 1][:-1]]
        hit = ~done & there[k] & (c[k] >= least)
        out[hit] = penalty[hit] + np.log(c[k][hit] / history[hit])
        used[hit] = k + 1
        done |= hit
        penalty[~done & there[k]] += np.log(alpha)
    rest = ~done
    out[rest] += penalty[rest]
    return out, used


def _sum(batches: Iterator[pa.RecordBatch], folder: str, order: int, alpha: float, least: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (block, lead, part): a block's counts, and with the last of them its documents' scores."""
    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    at, counts = None, []

    def block() -> Iterator[pa.RecordBatch]:
        known = np.concatenate(counts)
        counts.clear()
        table = pq.read_table(f"{path}/{at}.parquet", filesystem=fs)
        text = pa.concat_arrays(table.column("text").chunks)
        found, first = grams(text, order)
        there = [g > 0 for g in found]
        seen = spread(found, known)
        logs, used = score_words(seen, there, alpha, least)
        own = np.ones(len(logs), np.int64)
        for k, at_order in enumerate(there):
            own[at_order] = seen[k][at_order]
        n = np.diff(first)
        sums, backed, single, once = np.zeros(len(n)), *(np.zeros(len(n), np.int64) for _ in range(3))
        has = np.flatnonzero(n > 0)
        place = np.arange(len(logs)) - np.repeat(first[:-1], n)
        if len(has):
            sums[has] = np.add.reduceat(logs, first[:-1][has])
            single[has] = np.add.reduceat((used == 1).astype(np.int64), first[:-1][has])
            backed[has] = np.add.reduceat((used < np.minimum(place + 1, order)).astype(np.int64), first[:-1][has])
            once[has] = np.add.reduceat((own == 1).astype(np.int64), first[:-1][has])
        ids = pa.concat_arrays(table.column("doc_id").chunks)
        yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(sums), pa.array(backed, pa.int64()), pa.array(once, pa.int64()), pa.array(single, pa.int64())], ["doc_id", "n_words", "log_part", "n_backoff", "n_once", "n_single"])

    for batch in batches:
        for name, low, high in zip(*(batch.column(c).to_pylist() for c in ("block", "low", "high")), strict=True):
            if name != at:
                if counts:
                    yield from block()
                at = name
            counts.append(large(low, high))
    if counts:
        yield from block()


def backoff_scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, log_score (sum of ln S), mean_log (null without words), n_backoff (words scored below the highest order that
    their place allows) and n_once (words whose n-gram of that order occurs nowhere else in the corpus) of every row of ``docs`` (doc_id, text; other columns are ignored).

    Words are runs of other characters than ASCII white space, A-Z in lower case; n-grams do not cross texts.  Null, empty and blank
    texts have no words and score 0.  ``docs`` is a table or any frame whose partitions come out alike when they are computed again.  Rows that repeat count as often as they stand there.  No rows give no rows.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    folder = fresh(spark, "lm-blocks")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    text_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Distinct n-grams take about as many bytes as the text does; each lead is cut so that a range stays under RANGE_BYTES;
    # 65,536 parts, the finest cut, do for a petabyte of text.
    parts = max(1, min(1 << 16, -(-3 * text_bytes // (256 * RANGE_BYTES))))
    sent = rows.mapInArrow(partial(_send, folder=folder, order=order, parts=parts), SENT)
    answers = sent.repartition("lead", "part").sortWithinPartitions("lead", "part").mapInArrow(partial(_answer, parts=parts), ANSWER)
    scored = answers.repartition("block").sortWithinPartitions("block", "lead", "part").mapInArrow(partial(_sum, folder=folder, order=order, alpha=alpha, least=least), StructType([docs.schema["doc_id"], *(StructField(c, DoubleType() if c == "log_part" else LongType()) for c in ("n_words", "log_part", "n_backoff", "n_once", "n_single"))]))
    scored = written(scored, "lm-scores")
    total = scored.agg(F.sum("n_words")).first()[0] or 1
    score = F.col("log_part") - F.col("n_single") * F.log(F.lit(float(total)))
    return scored.select("doc_id", "n_words", score.alias("log_score"), F.when(F.col("n_words") > 0, score / F.col("n_words")).alias("mean_log"), "n_backoff", "n_once")


def op7_lm_scoring(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, log_score, mean_log (both to four decimals), n_backoff and n_once of every row of ``docs`` (doc_id, text; other columns are ignored).

    Null, empty and blank texts have no words, the score 0 and no mean.  Repeated rows are texts of their own and count again; null ids stay.  Texts of any length
    are counted whole.  Ties cannot arise.  No rows give no rows.
    """
    out = backoff_scores(docs)
    return out.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log", 4).alias("mean_log"), "n_backoff", "n_once")


SQL = rf"""
with t as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
w as (select r, unnest(range(1, len(ws) + 1)) as i, ws from t),
g as (select r, i, ws[i] as w1, case when i > 1 then ws[i - 1] end as w2, case when i > 2 then ws[i - 2] end as w3 from w),
c1 as (select w1, count(*) as c from g group by w1),
c2 as (select w2, w1, count(*) as c from g where w2 is not null group by w2, w1),
c3 as (select w3, w2, w1, count(*) as c from g where w3 is not null group by w3, w2, w1),
n as (select count(*) as n from g),
s as (select r, i, a.c as c1, b.c as c2, d.c as c3, h.c as h1, k.c as h2 from g join c1 a using (w1) left join c2 b using (w2, w1) left join c3 d using (w3, w2, w1)
  left join c1 h on h.w1 = g.w2 left join c2 k on k.w2 = g.w3 and k.w1 = g.w2),
l as (select r, case when i > 2 and c3 >= {LEAST} then ln(c3 / h2) when i > 1 and c2 >= {LEAST} then ln(c2 / h1) + least(i - 2, 1) * ln({ALPHA}) else ln(c1 / n) + least(i - 1, 2) * ln({ALPHA}) end as x,
  case when i > 2 then coalesce(c3, 0) < {LEAST} when i = 2 then coalesce(c2, 0) < {LEAST} else false end as b,
  case when i > 2 then c3 = 1 when i = 2 then c2 = 1 else c1 = 1 end as o from s, n)
select doc_id, cast(len(ws) as bigint) as n_words, round(coalesce(x, 0), 4) as log_score, case when len(ws) > 0 then round(x / len(ws), 4) end as mean_log, coalesce(b, 0) as n_backoff, coalesce(o, 0) as n_once
from t left join (select r, sum(x) as x, cast(sum(b::int) as bigint) as b, cast(sum(o::int) as bigint) as o from l group by r) using (r)
"""

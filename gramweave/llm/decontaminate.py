"""Benchmark decontamination: an Aho-Corasick automaton over the normalised items scans every text once.

Windows of more than BLOCK_BYTES go to several automata, each of which scans every text; the offsets are those of the merged finds.

Texts and items are normalised alike: A-Z in lower case, everything but words a single space.  The automaton holds every window of
``size`` item words with a space at both ends, so a match is a run of whole words.  Byte positions of the words give each matched run's
offsets in the original text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import partial, reduce
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType, LongType, StructField, StructType

from gramweave.llm.store import written
from gramweave.llm.textkernel import alnum_table, words

#: An automaton's windows hold so many bytes at most; items beyond that go to further automata, each scanned over all texts.
BLOCK_BYTES = 32 << 20

_built: dict[int, tuple[Broadcast, ahocorasick.Automaton, list[list[int]]]] = {}


def normal_words(text: str | None) -> list[str]:
    table = alnum_table()
    part = next(words(pa.array([text or ""]), table))
    low = part.buf.tobytes()
    return [low[s:e].decode() for s, e in zip(part.start, part.end, strict=True)]


def windows(text: str | None, size: int) -> set[str]:
    """Normalised windows of ``size`` words; one of all words if there are fewer, none without words."""
    w = normal_words(text)
    if not w:
        return set()
    return {" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))}


def blocks(items: Iterable[tuple], size: int, limit: int = BLOCK_BYTES) -> Iterator[dict[str, list]]:
    """Windows with the ids of their items, in blocks of about ``limit`` bytes."""
    out: dict[str, list] = {}
    held = 0
    for item, text in items:
        for w in windows(text, size):
            if w not in out:
                held += len(w)
            ids = out.setdefault(w, [])
            if item not in ids:
                ids.append(item)
        if held >= limit:
            yield out
            out, held = {}, 0
    if out:
        yield out


def _automaton(shared: Broadcast) -> tuple[ahocorasick.Automaton, list[list]]:
    """Built once in each Python worker."""
    key = id(shared.value)
    if key not in _built:
        _built.clear()
        auto, ids = ahocorasick.Automaton(), []
        for w, items in sorted(shared.value.items()):
            auto.add_word(f" {w} ", (len(ids), w.count(" ") + 1))
            ids.append(items)
        auto.make_automaton()
        _built[key] = (shared, auto, ids)
    return _built[key][1:]


def _scan(batches: Iterator[pa.RecordBatch], shared: Broadcast, spans: bool, item: DataType) -> Iterator[pa.RecordBatch]:
    """``spans``: offsets of the runs of hit words; else of every hit word, from which runs over several automata are put together."""
    auto, owners = _automaton(shared)
    table = alnum_table()
    for batch in batches:
        n_words, hits, found, starts, ends = [], [], [], [], []
        for part in words(batch.column("text"), table):
            clean = np.where(table[part.buf], part.buf, 32).astype(np.uint8)
            # A word after another keeps one space before it: the byte before its start, which is no word byte, or a new one.
            for d in range(part.docs):
                a, b = part.first[d], part.first[d + 1]
                n_words.append(int(b - a))
                if a == b:
                    hits.append([]), found.append([]), starts.append([]), ends.append([])
                    continue
                text = f" {' '.join(clean[part.offsets[d] : part.offsets[d + 1]].tobytes().decode().split(' '))} "
                while "  " in text:
                    text = text.replace("  ", " ")
                runs, items = [], set()
                for at, (k, length) in auto.iter(text):
                    runs.append((at, length))
                    items.update(owners[k])
                if runs:
                    last = np.cumsum(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32)[[at for at, _ in runs]] - 2
                    mark = np.zeros(b - a + 1, np.int64)
                    np.add.at(mark, last - np.array([k for _, k in runs]) + 1, 1)
                    np.add.at(mark, last + 1, -1)
                    on = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
                else:
                    on = np.zeros(0, np.int64)
                hits.append(on.tolist())
                found.append(sorted(items))
                if len(on):
                    breaks = np.flatnonzero(np.diff(on) > 1)
                    lo, hi = (on[np.r_[0, breaks + 1]], on[np.r_[breaks, len(on) - 1]]) if spans else (on, on)
                    whole = part.buf[part.offsets[d] : part.offsets[d + 1]]
                    chars = np.r_[0, np.cumsum((whole & 0xC0) != 0x80)]
                    starts.append(chars[part.start[a + lo] - part.offsets[d]].tolist())
                    ends.append(chars[part.end[a + hi] - part.offsets[d]].tolist())
                else:
                    starts.append([]), ends.append([])
        keep = [batch.column(i) for i, c in enumerate(batch.schema.names) if c != "text"]
        names = [c for c in batch.schema.names if c != "text"]
        kinds = [pa.int64(), to_arrow_type(item), pa.int64(), pa.int64()]
        cols = [pa.array(n_words, pa.int64()), *(pa.array(x, pa.list_(k)) for x, k in zip((hits, found, starts, ends), kinds, strict=True))]
        yield pa.RecordBatch.from_arrays(keep + cols, names + ["n_words", "hit", "items"] + (["span_start", "span_end"] if spans else ["word_start", "word_end"]))


def _shared(items: DataFrame, size: int) -> Iterator[Broadcast]:
    """The items' windows in blocks, one after the other made, sent to the executors and forgotten by the driver."""
    rows = items.where("item_id is not null").select("item_id", "text").toLocalIterator()
    none = True
    for block in blocks(((r[0], r[1]) for r in rows), size):
        none = False
        yield items.sparkSession.sparkContext.broadcast(block)
    if none:
        yield items.sparkSession.sparkContext.broadcast({"\x00": []})


def scan(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with n_words, hit (positions of the words in any occurrence of an item's window, from 0),
    items (ids of the items with occurring windows), span_start and span_end (character offsets of the runs of hit words).

    ``items`` (item_id, text) reaches the driver one row at a time and the executors in automata of at most BLOCK_BYTES, of which the
    driver holds one at a time; with more than one, each scans all texts and its finds are merged by row, the runs of hit words too.  Ids
    keep their types.  Null texts have no words, items without words no window; items with a null id are left out, equal items all count.
    No items: nothing is hit.
    """
    item = items.schema["item_id"].dataType
    longs = ArrayType(LongType())

    def fields(*more: StructField, ends: tuple[str, str]) -> StructType:
        return StructType([docs.schema["doc_id"], *more, StructField("n_words", LongType()), StructField("hit", longs), StructField("items", ArrayType(item)), *(StructField(c, longs) for c in ends)])

    keyed = docs.select("doc_id", "text")
    shared = _shared(items, size)
    first = next(shared)
    second = next(shared, None)
    if second is None:
        return keyed.mapInArrow(partial(_scan, shared=first, spans=True, item=item), fields(ends=("span_start", "span_end")))
    numbered = written(keyed.withColumn("row", F.monotonically_increasing_id()), "numbered")
    schema = fields(StructField("row", LongType()), ends=("word_start", "word_end"))
    out = [numbered.mapInArrow(partial(_scan, shared=one, spans=False, item=item), schema) for one in chain([first, second], shared)]
    every = reduce(DataFrame.unionByName, out)
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    merged = every.groupBy("row", "doc_id").agg(F.first("n_words").alias("n_words"), union(F.arrays_zip("hit", "word_start", "word_end")).alias("at"), union("items").alias("items"))
    starts = F.filter("at", lambda x, i: (i == 0) | (F.get("at", i - 1)["hit"] + 1 < x["hit"]))
    stops = F.filter("at", lambda x, i: (i == F.size("at") - 1) | (F.get("at", i + 1)["hit"] - 1 > x["hit"]))
    return merged.select("doc_id", "n_words", F.col("at")["hit"].alias("hit"), "items", F.transform(starts, lambda x: x["word_start"]).alias("span_start"), F.transform(stops, lambda x: x["word_end"]).alias("span_end"))


def digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def op3_decontamination(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 (of the sorted, comma-joined ids; of the empty string without any), contaminated; ``scan`` has the offsets.

    Every row of ``docs`` (doc_id, text; other columns are ignored) is judged by its own whole text, however long, so repeated rows and null ids give rows like
    all others.  A null, empty or wordless text has no words and no hits; a null or wordless item has no window.  Items with the same window all count.
    No documents give no rows; without items nothing is contaminated.
    """
    found = scan(docs, items, size)
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id", "n_words", F.size("hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated"),
    )


def _clean(batches: Iterator[pa.RecordBatch], shared: Broadcast, doc: int, text: int, item: DataType) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        one = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(text)], ["doc_id", "text"])
        hits = [len(h) for found in _scan(iter([one]), shared, False, item) for h in found.column("hit")]
        unnamed = batch.column(doc).is_null().to_numpy(zero_copy_only=False)
        yield batch.filter(pa.array((np.array(hits, np.int64) == 0) | unnamed))


def clean(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """``docs``, all its columns, without the rows whose text an item's window occurs in; rows with a null doc_id stay.

    Every row is judged by its own text where it lies: nothing is shuffled.  Windows of several automata are looked for one after the other.
    """
    doc, text, item = docs.columns.index("doc_id"), docs.columns.index("text"), items.schema["item_id"].dataType
    for shared in _shared(items, size):
        docs = docs.mapInArrow(partial(_clean, shared=shared, doc=doc, text=text, item=item), docs.schema)
    return docs


#: Windows by DuckDB's lists, joined to the items' windows.
SQL = r"""
with dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
bw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
bi as (select item_id, ws, unnest(range(1, greatest(2, len(ws) - 8))) as i from bw where len(ws) > 0),
bwin as (select distinct item_id, array_to_string(ws[i : i + 9], ' ') as win, len(ws[i : i + 9]) as k from bi),
ks as (select distinct k from bwin),
di as (select doc_id, k, ws, unnest(range(1, len(ws) - k + 2)) as i from dw, ks where len(ws) >= k),
hits as (select doc_id, i, di.k, item_id from di join bwin on array_to_string(di.ws[i : i + di.k - 1], ' ') = bwin.win and di.k = bwin.k),
pos as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from hits) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as ids from (select distinct doc_id, cast(item_id as varchar) as s from hits) group by doc_id)
select doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join pos using (doc_id) left join its using (doc_id)
"""

"""WARC archives from pages, and capture histories by an external index merge.

Writing: each task gathers captures up to RUN_BYTES, sorts them by URL key and time, and writes them as one archive, a sorted run of
gzip members; it emits an index row for each record.  Equal payloads are stored once: the others revisit it.
Merging: index rows are dealt to ranges of (URL key, time, page); within a range the runs' slices, each sorted, are merged by a tree of
losers, so ranges in order are the globally ordered capture histories.
Reading: records are read back from the archives at the merged index's places and parsed.

A capture's time is the column ``captured`` (timestamp) if the pages have one, else EPOCH plus page_id seconds.
"""

from __future__ import annotations

import datetime
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import partial
from typing import Any

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramweave.llm.store import fresh, written

RUN_BYTES, LEAST_REVISIT, RANGE_ROWS = 32 << 20, 1000, 20_000
#: Payloads that more than this part of all copies repeat are looked up by broadcast: there are at most so many.
HOT = 1000
EPOCH = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
INDEX = "url_key string, captured string, page_id long, file string, offset long, length long"


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query: captures of a site lie together, whatever the scheme."""
    if not url:
        return ""
    rest = url.partition("://")[2] or url
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host, path = rest[:cut].lower(), rest[cut:].partition("#")[0]
    return ",".join(reversed(host.split("."))) + ")" + (path or "/")


def header_text(value: str) -> str:
    """Control characters, which would end a header line, as percent escapes."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def record(page_id: int | None, url: str | None, captured: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit with the HTTP head alone."""
    name = lambda i: f"<urn:x-page:{'' if i is None else i}>"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    kind, more = "response", ""
    if refers_to is None:
        block += payload
    else:
        kind = "revisit"
        more = f"WARC-Refers-To: {name(refers_to)}\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"
    target = f"WARC-Target-URI: {header_text(url)}\r\n" if url else ""
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {name(page_id)}\r\nWARC-Date: {captured}\r\n{target}WARC-Payload-Digest: sha1:{digest}\r\n{more}Content-Type: application/http;msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"record {headers.get('warc-record-id')} has {len(rest)} bytes, not {n + 4}")
    return headers, rest[:n]


class LoserTree:
    """Merges sorted iterators: inner nodes hold the losers of their matches, so the next item costs one climb of log2(k) matches."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.k = runs, max(1, len(runs))
        self.heads: list[tuple | None] = [next(r, None) for r in runs] or [None]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._climb(i)

    def _beats(self, a: int, b: int) -> bool:
        if a < 0 or b < 0:
            return a < 0  # an empty seat wins on the way up, so every run enters
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def _climb(self, i: int) -> None:
        at, node = i, (i + self.k) // 2
        while node:
            if not self._beats(at, self.losers[node]):
                at, self.losers[node] = self.losers[node], at
            node //= 2
        self.losers[0] = at

    def __iter__(self) -> Iterator[tuple]:
        while True:
            win = self.losers[0]
            item = self.heads[win]
            if item is None:
                return
            yield item
            self.heads[win] = next(self.runs[win], None)
            self._climb(win)


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    held: list[tuple] = []
    size = 0

    def run() -> pa.RecordBatch:
        held.sort(key=lambda r: (r[0], r[1], -1 if r[2] is None else r[2]))
        # The name is the attempt's own: an archive of a failed attempt is in no index.
        file, at, rows = f"{path}/{uuid.uuid4().hex}.warc.gz", 0, []
        with fs.open_output_stream(file, compression=None) as out:
            for key, captured, page, url, payload, digest, refers in held:
                pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                data = pack.compress(record(page, url, captured, payload, digest, refers)) + pack.flush()
                out.write(data)
                rows.append((key, captured, page, file, at, len(data)))
                at += len(data)
        held.clear()
        return _batch(rows)

    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            for page, url, captured, payload, digest, refers in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "captured", "payload", "digest", "refers_to")), strict=True):
                held.append((url_key(url), captured, page, url, payload, digest, refers))
                size += len(payload)
                if size >= RUN_BYTES:
                    yield run()
                    size = 0
    if held:
        yield run()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    names = ("url_key", "captured", "page_id", "file", "offset", "length")
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (file, offset): each file's slice of this range is a sorted run."""
    runs: dict[str, list[tuple]] = {}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            runs.setdefault(row[3], []).append((row[0], row[1], -1 if row[2] is None else row[2], row))
    out: list[tuple] = []
    for item in LoserTree([iter(r) for r in runs.values()]):
        out.append(item[3])
        if len(out) >= 4096:
            yield _batch(out)
            out = []
    if out:
        yield _batch(out)


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    fs, _ = pyarrow.fs.FileSystem.from_uri(folder)
    files: dict[str, Any] = {}
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")}
        for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
            if file not in files:
                if len(files) >= 64:
                    files.pop(next(iter(files))).close()
                files[file] = fs.open_input_file(file)
            headers, block = parse(zlib.decompress(files[file].read_at(length, offset), 31))
            http, _, payload = block.partition(b"\r\n\r\n")
            size = int(http.rpartition(b"Content-Length: ")[2].partition(b"\r\n")[0])
            digest, kind = headers["warc-payload-digest"].partition(":")[2], headers["warc-type"]
            if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                raise ValueError(f"the payload of {headers['warc-record-id']} is not what was written")
            of = lambda name: int(v) if (v := headers.get(name, "").removeprefix("<urn:x-page:").removesuffix(">")) else None
            for c, v in zip(out, (of("warc-record-id"), size, digest, kind, of("warc-refers-to")), strict=True):
                out[c].append(v)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        read = [pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([*read, batch.column("url_key"), batch.column("captured")], [*out, "url_key", "captured"])


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Index (url_key, captured, page_id, file, offset, length) of the archives written to ``folder`` for ``pages`` (page_id, url, html).

    Of records with equal payloads of LEAST_REVISIT bytes or more, that with the largest page_id is the response, the others revisit
    it; rows that repeat that page_id are responses too, and so are rows with a null page_id without an equal payload that has one.
    A null html is an empty payload; a null url has an empty key.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    when = F.date_format("captured", "yyyy-MM-dd'T'HH:mm:ss'Z'") if "captured" in pages.columns else F.date_format(F.timestamp_seconds(F.lit(int(EPOCH.timestamp())) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", when.alias("captured"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    size = F.octet_length("payload")
    small = rows.where(size < LEAST_REVISIT).withColumn("response", F.lit(None).cast("long"))
    large = rows.where(size >= LEAST_REVISIT)
    copies = large.groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1")
    copies = written(copies, "copies")
    # Small payloads stay where they are.  A payload that more than a HOT-th of all rows repeat is looked up by broadcast, and its rows are
    # dealt by page for the join of the others, so that no task gets them all.
    most = max(1000, (copies.agg(F.sum("n")).first()[0] or 0) // HOT)
    hot = F.broadcast(copies.where(F.col("n") > most).select("digest", F.col("response").alias("hot")))
    looked = large.join(hot, "digest", "left").withColumn("key", F.when(F.col("hot").isNull(), F.col("digest")).otherwise(F.concat(F.lit("page "), F.coalesce(F.col("page_id").cast("string"), F.lit("")))))
    rest = copies.where(F.col("n") <= most).select(F.col("digest").alias("key"), "response")
    found = looked.join(rest, "key", "left").select(*rows.columns, F.coalesce("hot", "response").alias("response"))
    refers = F.when(F.coalesce(F.col("page_id") != F.col("response"), F.col("response").isNotNull()), F.col("response"))
    placed = small.unionByName(found).withColumn("refers_to", refers)
    spark = pages.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return written(placed.mapInArrow(partial(_write, folder=folder), INDEX), "warc-index")


def histories(index: DataFrame) -> DataFrame:
    """The index in global order of (url_key, captured, page_id): partition by partition, and within each."""
    n = max(1, -(-index.count() // RANGE_ROWS))
    dealt = index.repartitionByRange(n, "url_key", "captured", "page_id").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(_merge, INDEX)


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url_key and captured of the index's records, in its order."""
    return index.mapInArrow(partial(_read, folder=folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, captured string")


def op8_warc(pages: DataFrame) -> DataFrame:
    """Writes the pages' archives to the shared folder, merges their index and reads every record back in capture order.

    A row of ``pages`` (page_id, url, html; other columns are ignored) is a record, whatever its size; a null html is an empty payload, a null url an empty key.
    Of equal payloads of 1000 bytes or more the largest page_id responds.  No rows give no records.
    """
    folder = fresh(pages.sparkSession, "warc")
    return read_archives(histories(write_archives(pages, folder)), folder)


SQL = r"""
with p as (select page_id, url, encode(coalesce(html, '')) as b from pages),
d as (select page_id, url, octet_length(b) as n, sha1(b) as h from p),
m as (select *, case when n >= 1000 then max(page_id) over (partition by h) end as top from d),
u as (select *, case when strpos(coalesce(url, ''), '://') > 0 then substr(url, strpos(url, '://') + 3) else coalesce(url, '') end as rest from m),
k as (select *, regexp_extract(rest, '^([^/?#]*)', 1) as host, regexp_extract(rest, '^[^/?#]*([^#]*)', 1) as tail from u)
select page_id, n as payload_bytes, h as payload_digest, case when top is not null and page_id <> top then 'revisit' else 'response' end as record_type,
case when top is not null and page_id <> top then top end as refers_to,
case when coalesce(url, '') = '' then '' else array_to_string(list_reverse(string_split(lower(host), '.')), ',') || ')' || case when tail = '' then '/' else tail end end as url_key,
strftime(timestamp '2024-01-01' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') as captured
from k
"""

"""SRC6: rows of .npy arrays of any size, read by byte ranges.

A Spark data source: the header is parsed once, partitions are ranges of rows, and a task reads its own range alone, a few megabytes at a
time.  A filter on ``row`` narrows the ranges before any task starts (with spark.sql.python.filterPushdown.enabled, which ``session`` sets), and
``columns`` picks columns.  Files are opened through pyarrow's file systems, so they may be remote.
"""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

#: Bytes of a partition, and those read at once.
PARTITION_BYTES, READ_BYTES = 64 << 20, 4 << 20
#: A header is no longer than this.
HEAD_BYTES = 1 << 16


def opened(path: str) -> pa.NativeFile:
    fs, at = pyarrow.fs.FileSystem.from_uri(path)
    return fs.open_input_file(at)


def listed(path: str) -> list[str]:
    """The file itself, or the .npy files right in a folder, by name."""
    fs, at = pyarrow.fs.FileSystem.from_uri(path)
    if fs.get_file_info(at).type != pyarrow.fs.FileType.Directory:
        return [path]
    return sorted(f"{path.rstrip('/')}/{x.base_name}" for x in fs.get_file_info(pyarrow.fs.FileSelector(at)) if x.base_name.endswith(".npy"))


@dataclass(frozen=True)
class Layout:
    """Where the numbers of an array lie: ``rows`` x ``width`` numbers of ``kind`` from byte ``start`` on."""

    rows: int
    width: int
    kind: str
    start: int
    by_columns: bool

    @property
    def row_bytes(self) -> int:
        return self.width * np.dtype(self.kind).itemsize


def layout(path: str) -> Layout:
    """From the header alone; an array of one dimension has rows of one number, further dimensions are one row's numbers."""
    with opened(path) as f:
        size = f.size()
        head = io.BytesIO(f.read_at(min(size, HEAD_BYTES), 0))
    version = np.lib.format.read_magic(head)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, by_columns, kind = read(head)
    if kind.kind not in "biuf":
        raise ValueError(f"{path}: no array of numbers but of {kind}")
    shape = shape or (1,)
    width = int(np.prod(shape[1:], dtype=np.int64))
    if by_columns and len(shape) > 2:
        raise ValueError(f"{path}: a column-major array of more than two dimensions")
    out = Layout(shape[0], width, kind.str, head.tell(), by_columns and len(shape) == 2)
    if size < out.start + out.rows * out.row_bytes:
        raise ValueError(f"{path}: ends before its {out.rows} rows do")
    return out


@dataclass
class Rows(InputPartition):
    path: str
    layout: Layout
    first: int
    stop: int


class NpyReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.columns = [int(c) for c in options["columns"].split(",")] if options.get("columns") else None
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.files = [(path, layout(path)) for path in listed(options["path"])]
        self.first, self.stop = int(options.get("first", 0)), int(options.get("stop", 1 << 62))

    def partitions(self) -> Sequence[InputPartition]:
        out: list[InputPartition] = []
        for path, at in self.files:
            step, stop = max(1, self.partition_bytes // max(1, at.row_bytes)), min(self.stop, at.rows)
            out += [Rows(path, at, lo, min(stop, lo + step)) for lo in range(self.first, stop, step)]
        return out

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        at, kind = partition.layout, np.dtype(partition.layout.kind)
        chosen = range(at.width) if self.columns is None else self.columns
        step = max(1, READ_BYTES // max(1, at.row_bytes))
        with opened(partition.path) as f:
            for lo in range(partition.first, partition.stop, step):
                hi = min(partition.stop, lo + step)
                if at.by_columns:
                    values = np.stack([np.frombuffer(f.read_at((hi - lo) * kind.itemsize, at.start + (c * at.rows + lo) * kind.itemsize), kind) for c in chosen], axis=1)
                else:
                    values = np.frombuffer(f.read_at((hi - lo) * at.row_bytes, at.start + lo * at.row_bytes), kind).reshape(hi - lo, at.width)
                    values = values if self.columns is None else values[:, self.columns]
                flat = pa.array(np.ascontiguousarray(values, dtype="<f8").ravel())
                ends = pa.array(np.arange(hi - lo + 1, dtype=np.int32) * values.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * (hi - lo)), pa.array(np.arange(lo, hi)), pa.ListArray.from_arrays(ends, flat)], ["path", "row", "values"])


class FilteredNpyReader(NpyReader):
    """Takes filters on ``row``; Spark lets a reader do so only where its setting allows it."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) != ("row",) or not isinstance(value, int):
                yield f
            elif isinstance(f, EqualTo):
                self.first, self.stop = max(self.first, value), min(self.stop, value + 1)
            elif isinstance(f, GreaterThanOrEqual | GreaterThan):
                self.first = max(self.first, value + isinstance(f, GreaterThan))
            elif isinstance(f, LessThanOrEqual | LessThan):
                self.stop = min(self.stop, value + isinstance(f, LessThanOrEqual))
            else:
                yield f


class NpyRows(DataSource):
    """Options: path of a file or folder; columns, numbers with commas between; partition_bytes; first and stop of the rows; filters, true or false."""

    @classmethod
    def name(cls) -> str:
        return "npy_rows"

    def schema(self) -> str:
        return "path string, row long, values array<double>"

    def reader(self, schema: StructType) -> NpyReader:
        return (FilteredNpyReader if self.options.get("filters") == "true" else NpyReader)(self.options)


def npy_rows(spark: SparkSession, path: str, columns: Sequence[int] | None = None, partition_bytes: int = PARTITION_BYTES, first: int = 0, stop: int | None = None) -> DataFrame:
    """SRC6: (path, row, values) of a .npy array or of all in a folder, ``columns`` of them or all, from row ``first`` to before ``stop``; partitions are ranges of rows
    of about ``partition_bytes``."""
    spark.dataSource.register(NpyRows)
    options = {"partition_bytes": partition_bytes, "first": first, "filters": spark.conf.get("spark.sql.python.filterPushdown.enabled", "false").lower()}
    if columns is not None:
        options["columns"] = ",".join(map(str, columns))
    if stop is not None:
        options["stop"] = stop
    return spark.read.format("npy_rows").options(**{k: str(v) for k, v in options.items()}).load(path)


def pair_of_row(row: Column, n: int) -> tuple[Column, Column]:
    """The pair s < t of numbers below ``n`` at a place of the upper triangle in row order: whole numbers up to the last step, so no rounding shows."""
    guess = F.floor((2 * n - 1 - F.sqrt((F.lit(float(2 * n - 1)) ** 2) - 8.0 * row)) / 2)
    before = lambda s: F.floor(s * (2 * n - s - 1) / F.lit(2))
    s = F.when(before(guess) > row, guess - 1).when(before(guess + 1) <= row, guess + 1).otherwise(guess)
    return s, row - before(s) + s + 1


def spectra_npy(spark: SparkSession, path: str, n: int, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """SRC6: (s, t, sv) of an array with a row for each pair of ``n`` subjects in the upper triangle's order; NaN padding is left out."""
    s, t = pair_of_row(F.col("row"), n)
    rows = npy_rows(spark, path, None, partition_bytes)
    return rows.select(s.cast("long").alias("s"), t.cast("long").alias("t"), F.filter("values", lambda x: ~F.isnan(x)).alias("sv"))

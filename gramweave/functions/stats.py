"""Shared statistical expressions and grouped statistics (STA1-STA10, WIN1-WIN10).  NaN never leaves: undefined is NULL."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from gramweave.session import stored


def clean(x: str | Column) -> Column:
    """NaN and infinities as NULL."""
    c = F.col(x) if isinstance(x, str) else x
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def pearson(x: str, y: str, least: int = 3) -> Column:
    """STA1, an aggregate: NULL for fewer than ``least`` rows or a constant column."""
    return F.when(F.count(F.col(x) + F.col(y)) >= least, F.expr(f"try_divide(covar_samp({x}, {y}), stddev_samp({x}) * stddev_samp({y}))"))


def average_rank(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """STA2/WIN2: rank from 1 within ``by``, ties sharing their mean rank."""
    ordered = W.partitionBy(*by).orderBy(value)
    ties = W.partitionBy(*by, value)
    return df.withColumn(out, F.rank().over(ordered) + (F.count(F.lit(1)).over(ties) - 1) / 2.0)


#: Rows of a range: what one task sorts.
RANGE_ROWS = 200_000


def _compacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal rows of a batch once, with their number: a value that a third of all rows share reaches the sort a few times a task."""
    for batch in batches:
        names = batch.schema.names
        rows = pa.Table.from_batches([batch]).group_by(names, use_threads=False).aggregate([([], "count_all")])
        yield from rows.rename_columns([*names, "_n"]).combine_chunks().to_batches()


def _codes(column: pa.Array) -> np.ndarray:
    """Numbers that are equal where the column's values are."""
    if column.null_count or not (pa.types.is_integer(column.type) or pa.types.is_floating(column.type)):
        return np.asarray(column.dictionary_encode("encode").indices)
    return column.to_numpy()


def _runs(batches: Iterator[pa.RecordBatch], by: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Rows (by, _value, _n) of a range come sorted; each distinct value with its rows and the rows of its group before it in this range."""
    part = TaskContext.get().partitionId()
    held: tuple[list, float, int, int, pa.RecordBatch] | None = None  # key, value, count, start and the row's columns of the last run

    def rows(columns: pa.RecordBatch, count: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
        more = [pa.array(count, pa.int64()), pa.array(start, pa.int64()), pa.array(np.full(len(count), part), pa.int32())]
        return pa.RecordBatch.from_arrays([*(columns.column(c) for c in (*by, "_value")), *more], [*by, "_value", "_count", "_inside", "_part"])

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        value, weight = batch.column("_value").to_numpy(), batch.column("_n").to_numpy()
        group = np.ones(n, bool)
        group[1:] = False
        for c in by:
            code = _codes(batch.column(c))
            group[1:] |= code[1:] != code[:-1]
        run = group.copy()
        run[1:] |= value[1:] != value[:-1]
        first = np.flatnonzero(run)
        count = np.add.reduceat(weight, first)
        before = np.r_[0, np.cumsum(count)[:-1]]
        own = np.maximum.accumulate(np.where(group[first], np.arange(len(first)), 0))
        start = before - before[own]
        key = [batch.column(c)[0].as_py() for c in by]
        if held is not None:
            if held[0] == key:
                start[own == 0] += held[3] + held[2]
            if held[0] == key and held[1] == value[0]:
                count[0] += held[2]
                start[0] = held[3]
            else:
                yield rows(held[4], np.array([held[2]]), np.array([held[3]]))
        columns = batch.take(pa.array(first))
        yield rows(columns.slice(0, len(first) - 1), count[:-1], start[:-1])
        last = columns.slice(len(first) - 1, 1)
        held = [last.column(c)[0].as_py() for c in by], float(value[-1]), int(count[-1]), int(start[-1]), last
    if held is not None:
        yield rows(held[4], np.array([held[2]]), np.array([held[3]]))


def positions(df: DataFrame, by: Sequence[str], value: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(by, value, _count, _start, _total): each distinct value of a group, how often it stands there, how many smaller ones there are,
    and the group's rows.

    No task holds a group: rows are dealt to ranges by one sort, a range counts its runs and starts after the rows of its group in the ranges
    before it.  Ties are counted before the sort.  ``value`` is read as a double; rows without it are left out.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("_value")).where("_value is not null")
    fields = list(rows.schema.fields)
    counted = stored(rows.mapInArrow(_compacted, StructType([*fields, StructField("_n", LongType())])), "value-counts")
    n = max(1, -(-counted.count() // range_rows))
    ranged = counted.repartitionByRange(n, *by, "_value").sortWithinPartitions(*by, "_value")
    made = StructType([*fields, StructField("_count", LongType()), StructField("_inside", LongType()), StructField("_part", IntegerType())])
    ranged = stored(ranged.mapInArrow(partial(_runs, by=list(by)), made), "value-ranges")
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sums = ranged.groupBy("_part", *by).agg(F.sum("_count").alias("_n"))
    starts = sums.select("_part", *by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(W.partitionBy(*by)).alias("_total"))
    placed = ranged.join(starts, ["_part", *by])
    return placed.select(*by, F.col("_value").alias(value), "_count", (F.col("_before") + F.col("_inside")).alias("_start"), "_total")


def with_groups(df: DataFrame, groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """``df`` with the columns of a table of few rows, one a group; NULL is a group too."""
    same = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by])
    return df.alias("a").join(F.broadcast(groups.alias("b")), same, "left").select("a.*", *(F.col(f"b.{c}") for c in groups.columns if c not in by))


def along_ranges(df: DataFrame, by: Sequence[str], order: str, value: str, before: str, running: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """WIN4, WIN6: ``df`` with ``before``, the value of the row before by ``order`` within ``by``, and ``running``, the sum so far, for groups too large for one task.

    Rows are dealt to ranges by one sort; a range starts with the sum and the last value of the ranges before it.  Values of ``order`` are distinct within a group."""
    n = max(1, -(-df.count() // range_rows))
    ranged = stored(df.repartitionByRange(n, *by, order).withColumn("_part", F.spark_partition_id()), "ranges")
    ends, own = W.partitionBy(*by).orderBy("_part"), W.partitionBy("_part", *by).orderBy(order)
    sums = ranged.groupBy("_part", *by).agg(F.sum(value).alias("_sum"), F.max_by(value, order).alias("_end"))
    starts = sums.select("_part", *by, F.sum("_sum").over(ends.rowsBetween(W.unboundedPreceding, -1)).alias("_so_far"), F.lag("_end").over(ends).alias("_last"))
    upto = F.sum(value).over(own.rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = with_groups(ranged.withColumns({"_upto": upto, "_lag": F.lag(value).over(own), "_row": F.row_number().over(own)}), starts, ["_part", *by])
    total = F.coalesce(F.col("_so_far") + F.col("_upto"), "_so_far", "_upto")
    return rows.withColumns({before: F.when(F.col("_row") == 1, F.col("_last")).otherwise(F.col("_lag")), running: total}).drop("_part", "_upto", "_lag", "_row", "_so_far", "_last")


def _long(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(by, _column, _value): the defined values of several columns, each by its place among ``columns``."""
    cells = F.array(*(F.struct(F.lit(k).alias("_column"), F.col(c).cast("double").alias("_value")) for k, c in enumerate(columns)))
    return df.select(*by, F.inline(cells)).where("_value is not null")


AVERAGE_RANK = "_start + (_count + 1) / 2.0"


def average_rank_by_ranges(df: DataFrame, by: Sequence[str], value: str, out: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``average_rank`` for groups too large for one task; rows without a value are left out."""
    ranks = positions(df, by, value, range_rows).select(*by, value, F.expr(AVERAGE_RANK).alias(out))
    return df.join(ranks, [*by, value])


#: Bins of a histogram and of all groups' histograms together.
BINS, ALL_BINS = 4096, 2_000_000


def order_points(df: DataFrame, by: Sequence[str], columns: Sequence[str], points: Sequence[float], range_rows: int = RANGE_ROWS, bins: int = BINS) -> DataFrame:
    """(by, _column, _lo, _hi, _at): for each of ``points`` the values at the places around it among a column's defined values, as arrays, and how far
    the point lies beyond the lower.  ``df`` is read three times and never sorted or shuffled as a whole:

    its groups' least and largest values and counts; histograms of equal bins, of which the bins that hold the places are found; and the values in
    these bins alone, counted and put in order.  Broadcast are one row for each group of the result and the bins it asks for.
    """
    long, keys = _long(df, by, columns), [*by, "_column"]
    same = lambda a, b, more=(): reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in (*keys, *more)])
    bounds = stored(long.groupBy(*keys).agg(F.min("_value").alias("_least"), F.max("_value").alias("_most"), F.count(F.lit(1)).alias("_all")), "bounds")
    bins = max(16, min(bins, ALL_BINS // max(1, bounds.count())))
    share = F.try_divide(F.col("_value") - F.col("_least"), F.col("_most") - F.col("_least"))
    binned = long.alias("a").join(F.broadcast(bounds.alias("b")), same("a", "b")).select(*(F.col(f"a.{c}") for c in keys), "_value", F.least(F.floor(F.coalesce(share, F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int").alias("_bin"))
    counts = binned.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_held"))
    w = W.partitionBy(*keys).orderBy("_bin")
    placed = counts.withColumn("_under", F.sum("_held").over(w) - F.col("_held")).withColumn("_all", F.sum("_held").over(W.partitionBy(*keys)))
    exact = [F.lit(float(q)) * (F.col("_all") - 1) for q in points]
    inside = lambda k: (F.col("_under") <= k) & (k < F.col("_under") + F.col("_held"))
    asked = stored(placed.where(reduce(lambda x, y: x | y, [inside(f(x)) for x in exact for f in (F.floor, F.ceil)])), "bins")
    chosen = binned.alias("a").join(F.broadcast(asked.alias("b")), same("a", "b", ["_bin"])).select(*(F.col(f"a.{c}") for c in (*keys, "_bin")), "_value", "_under", "_all")
    extra = [*keys, "_bin", "_under", "_all"]
    if (asked.agg(F.max("_held")).first()[0] or 0) <= range_rows:
        values = chosen.groupBy(*extra, "_value").agg(F.count(F.lit(1)).alias("_count"))
        values = values.withColumn("_inside", F.sum("_count").over(W.partitionBy(*keys, "_bin").orderBy("_value")) - F.col("_count"))
    else:
        values = positions(chosen, extra, "_value", range_rows).withColumnRenamed("_start", "_inside").select(*extra, "_value", "_count", "_inside")
    start = F.col("_under") + F.col("_inside")
    at = lambda k: F.max(F.when((start <= k) & (k < start + F.col("_count")), F.col("_value")))
    found = values.groupBy(*keys, "_all").agg(F.array(*(at(F.floor(x)) for x in exact)).alias("_lo"), F.array(*(at(F.ceil(x)) for x in exact)).alias("_hi"))
    return found.select(*by, "_column", "_lo", "_hi", F.array(*(x - F.floor(x) for x in exact)).alias("_at"))


def quantiles_by_ranges(df: DataFrame, by: Sequence[str], columns: Sequence[str], points: dict[str, float], range_rows: int = RANGE_ROWS, bins: int = BINS) -> DataFrame:
    """Exact, linearly interpolated quantiles <column>_<name> per ``by``, for groups too large for one task; NULL without defined values.

    ``df`` is read several times: a stored table."""
    rows = order_points(df, by, columns, list(points.values()), range_rows, bins)
    mixed = F.zip_with(F.zip_with("_lo", "_hi", lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))), "_at", lambda x, f: x["lo"] * (1 - f) + x["hi"] * f)
    wide = [F.max(F.when(F.col("_column") == i, mixed[k])).alias(f"{c}_{name}" if name else c) for i, c in enumerate(columns) for k, name in enumerate(points)]
    return rows.groupBy(*by).agg(*wide)


QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str, out: str, least: int = 3, ranges: bool = False) -> DataFrame:
    """STA3: one row per ``by`` with the rank correlation of x and y over rows where both are defined; ``ranges`` for groups of pairs,
    which may be too long for one task (``df`` is then read several times: a stored table)."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    if ranges:
        place = positions(_long(rows, by, [x, y]), [*by, "_column"], "_value")
        rank = lambda k, c, name: place.where(F.col("_column") == k).select(*by, F.col("_value").alias(c), F.expr(AVERAGE_RANK).alias(name))
        ranked = rows.select(*by, x, y).join(rank(0, x, "_rx"), [*by, x]).join(rank(1, y, "_ry"), [*by, y])
    else:
        ranked = average_rank(average_rank(rows, by, x, "_rx"), by, y, "_ry")
    return ranked.groupBy(*by).agg(pearson("_rx", "_ry", least).alias(out))


def roc_auc(df: DataFrame, by: Sequence[str], y: str, score: str, out: str) -> DataFrame:
    """STA4/LRN8: area under the ROC curve from average ranks; NULL when one class is missing."""
    n1, n0 = F.sum(F.col(y)), F.sum(1 - F.col(y))
    top = F.sum(F.when(F.col(y) == 1, F.col("_r"))) - n1 * (n1 + 1) / 2.0
    return average_rank(df, by, score, "_r").groupBy(*by).agg(F.try_divide(top, (n1 * n0).cast("double")).alias(out))


def quartiles(x: str) -> list[Column]:
    """STA5: exact, linearly interpolated quartiles as aggregates named <x>_q25, <x>_median and <x>_q75."""
    return [F.percentile(x, q).alias(f"{x}_{n}") for q, n in ((0.25, "q25"), (0.5, "median"), (0.75, "q75"))]


def sem(x: str) -> Column:
    """STA6, an aggregate: sample deviation over the root of the count."""
    return F.stddev_samp(x) / F.sqrt(F.count(x))


def cosine(x: str, y: str) -> Column:
    """STA7, an aggregate: NULL for a zero vector."""
    return F.try_divide(F.sum(F.col(x) * F.col(y)), F.sqrt(F.sum(F.col(x) ** 2)) * F.sqrt(F.sum(F.col(y) ** 2)))


def jaccard(a: str, b: str, empty: float | None = 1.0) -> Column:
    """STA8 of two array columns; ``empty`` is the value for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def robust_z(df: DataFrame, by: Sequence[str], x: str, out: str) -> DataFrame:
    """STA9/PHC2: (x - median) / (1.4826 MAD); a MAD of zero falls back to the sample deviation, and that to zeros."""
    mid = df.groupBy(*by).agg(F.percentile(x, 0.5).alias("_m"), F.stddev_samp(x).alias("_sd"))
    dev = df.join(mid, list(by)).withColumn("_dev", F.col(x) - F.col("_m"))
    mad = dev.groupBy(*by).agg((F.percentile(F.abs("_dev"), 0.5) * 1.4826).alias("_mad"))
    scale = F.when(F.col("_mad") > 1e-12, F.col("_mad")).when(F.col("_sd") > 1e-12, F.col("_sd"))
    return dev.join(mad, list(by)).withColumn(out, F.coalesce(F.col("_dev") / scale, F.lit(0.0))).drop("_m", "_sd", "_dev", "_mad")


def effective_number(values: str | Column) -> Column:
    """STA10: exp of the entropy of an array of non-negative weights (0 ln 0 = 0), each divided by their sum."""
    v = F.col(values) if isinstance(values, str) else values
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    share = F.transform(v, lambda x: F.try_divide(x, total))
    return F.exp(-F.aggregate(share, F.lit(0.0), lambda a, s: a + F.when(s > 0, s * F.log(s)).otherwise(0.0)))


def isclose(x: Column, y: float, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """FLT7: |x - y| <= atol + rtol |y|."""
    return F.abs(x - F.lit(y)) <= F.lit(atol + rtol * abs(y))


def md5_order(seed: int, *parts: str | Column) -> Column:
    """Seeded order that every engine reproduces: md5 of the parts joined by bars."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts)))


def md5_int(seed: int, *parts: str | Column) -> Column:
    """The digest's first 32 bits as a long."""
    return F.conv(F.substring(md5_order(seed, *parts), 1, 8), 16, 10).cast("long")

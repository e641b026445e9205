"""FLT and JON operators that are not part of another family."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def binary_labels(manifest: DataFrame, label: str, negative: str, positive: str) -> DataFrame:
    """FLT1, FLT2, FLT19: rows whose trimmed label is one of the two, with y 0 or 1."""
    name = F.trim(F.col(label).cast("string"))
    y = F.when(name == negative, 0).when(name == positive, 1).otherwise(F.raise_error(F.lit("a label is neither class")).cast("int"))
    return manifest.where(name.isin(negative, positive)).withColumn("y", y)


def collapsed(df: DataFrame, label: str, members: Sequence[int], inside: str, outside: str) -> DataFrame:
    """FLT3: labels among ``members`` and all others."""
    return df.withColumn("diagnosis", F.when(F.col(label).isin(*members), inside).otherwise(outside))


def manifest_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """FLT5, JON8: how many places of two (k, sample_id) manifests differ, and the first."""
    both = a.select("k", F.col("sample_id").alias("x")).join(b.select("k", F.col("sample_id").alias("y")), "k", "full")
    wrong = ~F.col("x").eqNullSafe(F.col("y"))
    return both.agg(F.count_if(wrong).alias("mismatches"), F.min(F.when(wrong, F.col("k"))).alias("first_mismatch"))


def finite(df: DataFrame, column: str, positive: bool = False) -> DataFrame:
    """FLT6: rows with a defined, finite (and positive) value."""
    x = F.col(column)
    kept = df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return kept.where(x > 0) if positive else kept


def count_like(values: DataFrame) -> DataFrame:
    """FLT13: whether (x) looks like counts: none below -1e-12, over 99.5 per cent whole, a maximum over 1."""
    out = values.agg(F.min("x").alias("least"), F.avg((F.abs(F.col("x") - F.round("x")) <= 1e-6).cast("double")).alias("whole"), F.max("x").alias("largest"))
    return out.withColumn("count_like", (F.col("least") >= -1e-12) & (F.col("whole") > 0.995) & (F.col("largest") > 1))


def inconsistent(df: DataFrame, key: str, label: str) -> DataFrame:
    """FLT14: keys with more than one label."""
    return df.groupBy(key).agg(F.count_distinct(label).alias("labels")).where("labels > 1")


def capped(df: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """FLT15: of each class the first ``most`` rows by ``order``: the limit is the operator."""
    return df.withColumn("_k", F.row_number().over(W.partitionBy(by).orderBy(order))).where(F.col("_k") <= most).drop("_k")


def normalised(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """FLT19: each named column trimmed and cast; what is blank or cannot be cast is NULL."""
    text = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    return df.withColumns({c: text(c).try_cast(kind) for c, kind in kinds.items()})


def chosen_layer(layers: Mapping[str, DataFrame | None], source: str = "auto") -> tuple[str, DataFrame]:
    """SRC16: the layer asked for; by default the raw counts if they are there, else X.  A missing layer is an error."""
    name = source if source != "auto" else "raw" if layers.get("raw") is not None else "X"
    found = layers.get(name)
    if found is None:
        raise ValueError(f"there is no layer {name}")
    return name, found


def zipped(a: DataFrame, b: DataFrame, order_a: Column, order_b: Column) -> DataFrame:
    """JON8: rows of two tables of one length side by side, both in their own order; other lengths are an error."""
    place = lambda df, order: df.withColumn("_k", F.row_number().over(W.orderBy(order)))
    lone = F.raise_error(F.lit("the tables differ in length")).cast("int")
    both = place(a, order_a).withColumn("_a", F.lit(1)).join(place(b, order_b).withColumn("_b", F.lit(1)), "_k", "full")
    return both.where(F.when(F.col("_a").isNull() | F.col("_b").isNull(), lone).otherwise(1) == 1).drop("_k", "_a", "_b")


def looked_up(df: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """JON9: ``df`` with what a table of few rows (its size is left to the planner's broadcast limit) says of ``key``; NULL where it says nothing."""
    return df.join(names, key, "left")


def interpolated(df: DataFrame, value: str, points: DataFrame, out: str) -> DataFrame:
    """JON11: ``out`` is the piecewise linear function through ``points`` (x, y) at ``value``, constant beyond its ends.

    The points, of which there are few by nature (bins, p values), become intervals [x, next x) that a range join looks up.
    """
    w = W.orderBy("x")
    ends = points.select("x", "y", F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1"), F.lag("x").over(w).alias("before"))
    at = F.col(value)
    low, high = F.col("before").isNull() & (at < F.col("x")), F.col("x1").isNull()
    on = ((at >= F.col("x")) | F.col("before").isNull()) & ((at < F.col("x1")) | high)
    y = F.when(low | high, F.col("y")).otherwise(F.col("y") + (at - F.col("x")) / (F.col("x1") - F.col("x")) * (F.col("y1") - F.col("y")))
    return df.join(F.broadcast(ends), on, "left").withColumn(out, y).drop("x", "y", "x1", "y1", "before")


def run_lengths(values: Column) -> Column:
    """Distinct values of an array and how often each occurs, as an array of (value, count) in their order, inside the row; ``values`` is a
    sorted array of a column of its own."""
    starts = F.filter(F.transform(values, lambda x, i: F.when(F.get(values, i - 1).isNull() | (x != F.get(values, i - 1)), i)), lambda i: i.isNotNull())
    ends = F.slice(F.concat(starts, F.array(F.size(values))), F.lit(2), F.size(starts))
    return F.zip_with(starts, ends, lambda a, b: F.struct(F.get(values, a).alias("value"), (b - a).cast("long").alias("count")))

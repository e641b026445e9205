"""OPR1-OPR9: relation matrices and density operators from tables.

Long form is (s, i, j, v); packed form is (s, n, rho) with rho the row-major array of n * n doubles.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gramweave.functions import kernels


WORD = re.compile("[a-z]+")
#: Rows whose words leave in one batch.
WORD_ROWS = 256


def _counted_words(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, WORD_ROWS):
            part = batch.slice(lo, WORD_ROWS)
            counts = [Counter(WORD.findall(x.lower())) if x else {} for x in part.column("text").to_pylist()]
            row = pa.array(np.repeat(np.arange(len(counts)), [len(x) for x in counts]))
            library = pa.array([sum(x.values()) for x in counts], pa.int64())
            genes = pa.array([w for x in counts for w in x], pa.string())
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(row) for c in keys), library.take(row), genes, pa.array([n for x in counts for n in x.values()], pa.int64())], [*keys, "library", "gene", "count"])


def word_counts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, library, gene, count): the distinct words ``[a-z]+`` of each row's lower-cased ``text`` with their counts, library the row's words.  They are counted inside the
    row: nothing is shuffled."""
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), "library long", "gene string", "count long"])
    return rows.select(*keys, "text").mapInArrow(partial(_counted_words, keys=list(keys)), schema)


def correlation(df: DataFrame, key: str, units: Sequence[str]) -> DataFrame:
    """OPR4: packed correlation matrices of the columns ``units`` within each ``key``, in one pass of partial aggregates.

    A constant column has NULL correlations; its group's matrix holds NULLs, which ``quality_control`` gives as the reason.
    """
    n = len(units)
    pairs = [F.try_divide(F.covar_samp(units[i], units[j]), F.stddev_samp(units[i]) * F.stddev_samp(units[j])).alias(f"c_{i}_{j}") for i, j in combinations(range(n), 2)]
    cells = [F.lit(1.0) if i == j else F.col(f"c_{min(i, j)}_{max(i, j)}") for i in range(n) for j in range(n)]
    return df.groupBy(F.col(key).alias("s")).agg(*pairs).select("s", F.lit(n).alias("n"), F.array(*cells).alias("a"))


def gram_correlation(df: DataFrame, key: str, units: Sequence[str], eps: float = 1e-12) -> DataFrame:
    """OPR5: the same from centred sums of products; a unit whose sum of squares is ``eps`` or less makes its group's matrix NULL."""
    n = len(units)
    sums = [F.sum(u).alias(f"x{i}") for i, u in enumerate(units)]
    products = [F.sum(F.col(units[i]) * F.col(units[j])).alias(f"p_{i}_{j}") for i in range(n) for j in range(i, n)]
    g = df.groupBy(F.col(key).alias("s")).agg(F.count(F.lit(1)).alias("rows"), *sums, *products)
    centred = lambda i, j: F.col(f"p_{min(i, j)}_{max(i, j)}") - F.col(f"x{i}") * F.col(f"x{j}") / F.col("rows")
    cells = [centred(i, j) / F.sqrt(centred(i, i) * centred(j, j)) if i != j else F.lit(1.0) for i in range(n) for j in range(n)]
    ok = [centred(i, i) > eps for i in range(n)]
    fine = ok[0]
    for c in ok[1:]:
        fine = fine & c
    return g.select("s", F.lit(n).alias("n"), F.when(fine, F.array(*cells)).alias("a"))


def symmetrised(long: DataFrame, diagonal: str = "keep") -> DataFrame:
    """OPR1: (v_ij + v_ji) / 2; with ``diagonal='unit'`` the diagonal is set to 1 first."""
    v = F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.col("v")) if diagonal == "unit" else F.col("v")
    own = long.select("s", "i", "j", v.alias("v"))
    turned = own.select("s", F.col("j").alias("i"), F.col("i").alias("j"), F.col("v").alias("w"))
    return own.join(turned, ["s", "i", "j"], "left").select("s", "i", "j", ((F.col("v") + F.coalesce("w", "v")) / 2).alias("v"))


def trace_normalised(long: DataFrame, tol: float = 1e-12) -> DataFrame:
    """OPR2: v / trace within s; NULL where the trace is ``tol`` or less."""
    trace = F.sum(F.when(F.col("i") == F.col("j"), F.col("v"))).over(W.partitionBy("s"))
    return long.withColumn("v", F.when(F.abs(trace) > tol, F.col("v") / trace))


def unpacked(df: DataFrame, values: str = "a") -> DataFrame:
    """Packed to long form."""
    rows = df.select("s", "n", F.posexplode(values).alias("k", "v"))
    return rows.select("s", F.floor(F.col("k") / F.col("n")).cast("int").alias("i"), (F.col("k") % F.col("n")).cast("int").alias("j"), "v")


def packed(long: DataFrame) -> DataFrame:
    """Long to packed form; a matrix is one row, so its cells meet in one aggregate of bounded size."""
    cells = F.transform(F.array_sort(F.collect_list(F.struct("i", "j", "v"))), lambda c: c["v"])
    return long.groupBy("s").agg((F.max("i") + 1).cast("int").alias("n"), cells.alias("a"))


def density(df: DataFrame) -> DataFrame:
    """Packed matrices divided by their trace, as ``rho``."""
    at = lambda n: F.transform(F.sequence(F.lit(0), n - 1), lambda i: i * (n + 1))
    trace = F.aggregate(F.transform(at(F.col("n")), lambda k: F.get("a", k)), F.lit(0.0), lambda x, y: x + y)
    return df.withColumn("_t", trace).select("s", "n", F.transform("a", lambda x: x / F.col("_t")).alias("rho"))


def _qc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("min_eig", "max_eig", "trace", "matrix_rank")}
        for n, a in zip(batch.column("n").to_pylist(), batch.column("a").to_pylist(), strict=True):
            fine = a is not None and len(a) == n * n and all(x is not None and np.isfinite(x) for x in a)
            got = kernels.quality(np.array(a).reshape(n, n)) if fine else (None,) * 4
            for c, v in zip(out, got, strict=True):
                out[c].append(v)
        kinds = (pa.float64(), pa.float64(), pa.float64(), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("s", "n", "a")] + [pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], ["s", "n", "a", *out])


def quality_control(df: DataFrame, expected: int, tol: float = 1e-8) -> DataFrame:
    """FLT4, OPR3, OPR8: eigenvalue statistics and the first reason that excludes a matrix (NULL: it is retained)."""
    kind = dict(df.dtypes)["s"]
    seen = df.mapInArrow(_qc, f"s {kind}, n int, a array<double>, min_eig double, max_eig double, trace double, matrix_rank int")
    reason = (
        F.when(F.col("n") != expected, "size")
        .when(F.col("min_eig").isNull(), "not finite")
        .when(F.abs("trace") <= 1e-12, "trace")
        .when(F.col("min_eig") < -tol, "not PSD")
    )
    condition = F.try_divide(F.col("max_eig"), F.when(F.col("min_eig") > 1e-10, F.col("min_eig")))
    return seen.withColumn("condition", condition).withColumn("reason", reason)


def valid_units(series: DataFrame) -> DataFrame:
    """FLT8: units (s, unit, t, value) that vary, by more than 1e-12, in every observation."""
    sd = series.groupBy("s", "unit").agg(F.stddev_pop("value").alias("sd"), F.count_if(F.isnan("value") | F.col("value").isNull()).alias("bad"))
    return sd.groupBy("unit").agg(F.bool_and(F.coalesce(F.col("sd") > 1e-12, F.lit(False)) & (F.col("bad") == 0)).alias("valid"), F.count(F.lit(1)).alias("observations"))


def standardised(series: DataFrame) -> DataFrame:
    """OPR6: rows z-scored within (s, unit) and divided by sqrt((T - 1) units), so that rho = B B' has trace 1."""
    w = W.partitionBy("s", "unit")
    z = (F.col("value") - F.avg("value").over(w)) / F.nullif(F.stddev_samp("value").over(w), F.lit(0.0))
    shape = series.groupBy("s").agg(F.count_distinct("unit").alias("units"), F.count_distinct("t").alias("times"))
    return series.withColumn("z", z).join(shape, "s").select("s", "unit", "t", (F.col("z") / F.sqrt((F.col("times") - 1) * F.col("units").cast("double"))).alias("b"))


def factor_density(b: DataFrame) -> DataFrame:
    """OPR9: rho = B B' in long form from factor rows (s, unit, t, b)."""
    other = b.select("s", F.col("unit").alias("unit_j"), "t", F.col("b").alias("c"))
    return b.join(other, ["s", "t"]).groupBy("s", F.col("unit").alias("unit_i"), "unit_j").agg(F.sum(F.col("b") * F.col("c")).alias("v"))


def log_normalised(counts: DataFrame, scale: float = 1e4, library: str | None = None) -> DataFrame:
    """OPR7: ln(1 + count * scale / library) of (cell, gene, count); a cell without counts gives 0.

    ``library`` names a column that has each cell's total already, so that its rows need not meet."""
    total = F.sum("count").over(W.partitionBy("cell")) if library is None else F.col(library)
    return counts.withColumn("x", F.coalesce(F.log1p(F.try_divide(F.col("count") * scale, total)), F.lit(0.0)))

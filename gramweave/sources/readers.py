"""SRC1-SRC20: scans.  Files are reached only through Spark's readers, so any store that Spark reads will do."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gramweave.operators import cells
from gramweave.operators.cells import Stored
from gramweave.session import stored

NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def sniffed(first: str, choices: str = ",;\t|") -> str:
    """The delimiter of a header line; a comma if none of the choices stands in it."""
    try:
        return csv.Sniffer().sniff(first, choices).delimiter
    except csv.Error:
        return max(choices, key=first.count) if any(c in first for c in choices) else ","


def metadata(spark: SparkSession, path: str, delimiter: str | None = None, schema: StructType | str | None = None) -> DataFrame:
    """SRC1: a table with a header line; the delimiter is sniffed from that line if it isn't given, types are inferred without a schema."""
    if delimiter is None:
        line = spark.read.text(path).limit(1).collect()
        delimiter = sniffed(line[0][0] if line else "")
    reader = spark.read.option("header", True).option("sep", delimiter)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def matrix_csv(spark: SparkSession, path: str, separator: str = ",", suffix: str | None = None) -> DataFrame:
    """SRC2: headerless square matrices, one file each: (path, n, a) with a row-major; a file that is not square or finite is an error.

    With ``suffix``, all files so named in ``path`` and the folders below it: Spark lists these in tasks, where the driver alone would expand a pattern."""
    some = spark.read if suffix is None else spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}")
    text = some.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    cells = F.transform(lines, lambda x: F.transform(F.split(x, separator), lambda c: F.trim(c).try_cast("double")))
    rows = text.select("path", cells.alias("rows"))
    n = F.size("rows")
    square = F.forall("rows", lambda r: F.size(r) == n)
    finite = F.forall(F.flatten("rows"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    flat = F.when(square & F.coalesce(finite, F.lit(False)), F.flatten("rows")).otherwise(F.raise_error(F.concat(F.lit("not a finite square matrix: "), "path")).cast("array<double>"))
    return rows.select("path", n.alias("n"), flat.alias("a"))


def _npy(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        arrays = [np.load(io.BytesIO(c), allow_pickle=False) for c in frame.content]
        yield pd.DataFrame({"path": frame.path, "shape": [list(map(int, a.shape)) for a in arrays], "a": [a.astype(float).ravel().tolist() for a in arrays]})


def matrix_npy(spark: SparkSession, path: str) -> DataFrame:
    """SRC3: (path, shape, a) of .npy files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content").mapInPandas(_npy, "path string, shape array<int>, a array<double>")


def _npz(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        arrays = [(p, name, a) for p, c in zip(frame.path, frame.content, strict=True) for name, a in np.load(io.BytesIO(c), allow_pickle=False).items()]
        rows = [(p, name, list(map(int, a.shape)), np.nan_to_num(a.astype(float)).ravel().tolist()) for p, name, a in arrays if a.dtype.kind in "biuf"]
        yield pd.DataFrame(rows, columns=["path", "name", "shape", "a"])


def archive_npz(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """SRC6, SRC9, SRC11: (path, name, shape, a) of every array of numbers in .npz archives; NaN padding reads as 0."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", recursive).load(path).select("path", "content").mapInPandas(_npz, "path string, name string, shape array<int>, a array<double>")


def file_format(path: Column) -> Column:
    """SRC4: npy or csv by suffix, an error for others."""
    low = F.lower(path)
    return F.when(low.endswith(".npy"), "npy").when(low.rlike(r"\.(csv|txt|tsv)$"), "csv").otherwise(F.raise_error(F.concat(F.lit("unknown matrix format: "), path)).cast("string"))


def natural_key(name: Column, width: int = 20) -> Column:
    """SRC5: a key under which digit runs sort as numbers: a2 before a10."""
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.transform(parts, lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, width, "0")).otherwise(F.lower(x)))


def distance_faults(d: DataFrame, subjects: int) -> DataFrame:
    """SRC6, SRC7: per p, what is wrong with stored distances (p, s, t, d) with both orders and diagonal: cells missing, not finite,
    negative beyond 1e-7, asymmetric beyond 1e-7, diagonal not 0."""
    turned = d.select("p", F.col("t").alias("s"), F.col("s").alias("t"), F.col("d").alias("e"))
    rows = d.join(turned, ["p", "s", "t"], "left")
    x = F.col("d")
    odd = F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull()
    return rows.groupBy("p").agg(
        (F.lit(subjects * subjects) - F.count_distinct("s", "t")).cast("long").alias("missing"), F.count_if(odd).alias("not_finite"), F.count_if(x < -1e-7).alias("negative"),
        F.count_if(F.col("e").isNull() | (F.abs(x - F.col("e")) > 1e-7)).alias("asymmetric"), F.count_if((F.col("s") == F.col("t")) & (F.abs(x) > 1e-7)).alias("diagonal"),
    )


def distance_faults_of_operators(operators: DataFrame, grid: Sequence[float], kept: Stored | None = None) -> DataFrame:
    """SRC6, SRC7 for distances as they are made from operators (s, rho), in both orders and with diagonal: ``distance_faults`` inside the cells of pairs, no distance is a row.
    ``kept`` says what is stored of them, all as they are by default."""
    operators = stored(operators.select("s", "rho"), "operators")
    n = operators.count()
    return cells.distance_faults(operators, grid, kept).select("p", (F.lit(n * n) - F.col("there")).cast("long").alias("missing"), "not_finite", "negative", "asymmetric", "diagonal")


def absolute_spectra(ev: str) -> Column:
    """SRC12: signed, padded eigenvalues to singular values: NULL, NaN and infinities become 0."""
    return F.transform(ev, lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(F.abs(x)).cast("float"))


def factor_faults(f: DataFrame, rtol: float = 1e-5, atol: float = 1e-6) -> DataFrame:
    """SRC9: per factor row (s, n, f), its trace sum f^2 and whether that is 1 and the length a multiple of n."""
    trace = F.aggregate("f", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return f.select("s", trace.alias("trace"), (F.abs(trace - 1) <= atol + rtol).alias("unit_trace"), (F.size("f") % F.col("n") == 0).alias("whole"))


def bracketed(lines: DataFrame, rows: int, columns: int) -> DataFrame:
    """SRC13: (line, i, j, v) of text matrices ``[a b; c d]``, one a line; blank lines are passed over, another shape is an error.

    ``lines`` is (line, value).  Numbers are found by pattern, so stray commas and spaces do no harm.
    """
    inner = F.regexp_replace("value", r"[\[\]]", "")
    rows_of = F.filter(F.split(inner, ";"), lambda r: F.trim(r) != "")
    cells = F.transform(rows_of, lambda r: F.regexp_extract_all(r, F.lit(f"({NUMBER})"), F.lit(1)))
    blank = F.trim("value") == ""
    parsed = lines.where(~blank).select("line", blank.alias("blank"), cells.alias("m"))
    fits = (F.size("m") == rows) & F.forall("m", lambda r: F.size(r) == columns)
    checked = parsed.select("line", F.when(fits, F.col("m")).when(F.col("blank"), None).otherwise(F.raise_error(F.concat(F.lit("another shape in line "), F.col("line").cast("string"))).cast("array<array<string>>")).alias("m"))
    return checked.select("line", F.posexplode("m").alias("i", "r")).select("line", "i", F.posexplode("r").alias("j", "x")).select("line", "i", "j", F.col("x").cast("double").alias("v"))


def bracketed_labels(lines: DataFrame) -> DataFrame:
    """SRC14: (k, label) of ``[1 2 3]``."""
    cells = F.filter(F.split(F.regexp_replace("value", r"[\[\]]", " "), r"\s+"), lambda x: x != "")
    return lines.select(F.posexplode(cells).alias("k", "x")).select("k", F.col("x").cast("int").alias("label"))


def sparse_columns(coo: DataFrame, genes: DataFrame) -> DataFrame:
    """SRC15: the cells (cell, gene, count) of some genes of a sparse table."""
    return coo.join(genes.select("gene").distinct(), "gene", "left_semi")


def path_metadata(path: Column) -> tuple[Column, Column]:
    """SRC17: class (abnormal is looked for before normal) and machine id from a recording's path."""
    low = F.lower(path)
    kind = F.when(low.contains("abnormal") | low.contains("anomal"), "abnormal").when(low.contains("normal"), "normal")
    number = F.regexp_extract(path, r"(?i)id[_-]?(\d+)", 1)
    return kind, F.when(number != "", F.concat(F.lit("id_"), F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number)))


def profile(df: DataFrame, top: int = 20) -> DataFrame:
    """SRC20: (column, type, n, n_null, n_distinct, value, count): every column's counts and its ``top`` commonest values."""
    out = None
    for name, kind in df.dtypes:
        if kind.startswith(("array", "map", "struct")):
            continue
        values = df.groupBy(F.col(name).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("count"))
        size = values.agg(F.sum("count").alias("n"), F.sum(F.when(F.col("value").isNull(), F.col("count")).otherwise(0)).alias("n_null"), F.count("value").alias("n_distinct"))
        common = values.orderBy(F.col("count").desc(), F.col("value").asc_nulls_last()).limit(top)
        one = common.crossJoin(F.broadcast(size)).select(F.lit(name).alias("column"), F.lit(kind).alias("type"), "n", "n_null", "n_distinct", "value", "count")
        out = one if out is None else out.unionByName(one)
    return out

"""SRC10, SRC11, SNK2, SNK3: array files (.npy, .npz), and fold checkpoints stored as one archive for each p and outer fold.

Readers list and load files through Spark; writers put one file for each row into a folder that all executors share.
"""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramweave.operators.learning import coordinates
from gramweave.sources.readers import archive_npz

#: Names under which a fold's archive may lie, best first; anything else that has both numbers comes last.
PLACES = ("/checkpoints/p%02d_fold%03d.npz", "/checkpoints/p%02d_fold_%03d.npz", "/p%02d_fold%03d.npz")


def put(fs: pyarrow.fs.FileSystem, path: str, data: bytes) -> None:
    """A file is complete or not there: an attempt writes under a name of its own and renames it."""
    draft = f"{path}.{uuid.uuid4().hex}"
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(draft) as out:
        out.write(data)
    fs.move(draft, path)


def _write(frames: Iterator[pd.DataFrame], folder: str) -> Iterator[pd.DataFrame]:
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    for frame in frames:
        for name, names, shapes, arrays in zip(frame["path"], frame["names"], frame["shapes"], frame["arrays"], strict=True):
            out = io.BytesIO()
            made = {k: np.asarray(a, float).reshape([int(x) for x in s]) for k, s, a in zip(names, shapes, arrays, strict=True)}
            if name.endswith(".npy"):
                np.save(out, next(iter(made.values())))
            else:
                np.savez_compressed(out, **made)
            put(fs, f"{root}/{name}", out.getvalue())
        yield pd.DataFrame({"path": frame["path"]})


def array_files(rows: DataFrame, folder: str) -> DataFrame:
    """SNK2, SNK3: writes each row (path, names, shapes, arrays) as the file ``path`` below ``folder``, .npy (its first array) or .npz; (path) of what was
    written, once that is computed.  Written again, a file is replaced by its equal."""
    return rows.select("path", "names", "shapes", "arrays").mapInPandas(partial(_write, folder=folder), "path string")


def fold_files(spark: SparkSession, root: str, p_count: int, folds: int) -> DataFrame:
    """SRC10: (p_index, outer_fold, path): for each p (from 0) and outer fold (from 1) the archive at the best of PLACES, else the first by name
    below ``root`` whose name holds p, fold and both numbers.  A fold without one is an error."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", True).load(root).select("path")
    tail = F.substring_index("path", "/", -1)
    wanted = spark.range(p_count).withColumnRenamed("id", "p_index").crossJoin(spark.range(1, folds + 1).withColumnRenamed("id", "outer_fold"))
    inside = F.substring_index("path", re.sub(r"^[a-z]+:/*|/+$", "", root), -1)
    rows = found.select("path", inside.alias("inside"), F.regexp_extract(tail, r"p(\d\d+).*fold", 1).alias("a"), F.regexp_extract(tail, r"fold.*?(\d{3,})", 1).alias("b")).where("a <> '' and b <> ''")
    rows = rows.withColumns({"p_index": F.col("a").cast("long"), "outer_fold": F.col("b").cast("long")})
    place = F.lit(len(PLACES))
    for k, shape in reversed(list(enumerate(PLACES))):
        place = F.when(F.col("inside") == F.format_string(shape, "p_index", "outer_fold"), k).otherwise(place)
    best = rows.withColumn("place", place).groupBy("p_index", "outer_fold").agg(F.min(F.struct("place", "path"))["path"].alias("path"))
    missing = F.raise_error(F.format_string("no checkpoint of p %d, fold %d", "p_index", "outer_fold")).cast("string")
    return wanted.join(best, ["p_index", "outer_fold"], "left").select("p_index", "outer_fold", F.coalesce("path", missing).alias("path"))


def fold_arrays(spark: SparkSession, root: str, p_count: int, folds: int) -> DataFrame:
    """(p_index, outer_fold, arrays): a map of the archive's arrays by name."""
    files = fold_files(spark, root, p_count, folds)
    cells = archive_npz(spark, root, recursive=True).join(files, "path")
    return cells.groupBy("p_index", "outer_fold").agg(F.map_from_entries(F.collect_list(F.struct("name", "a"))).alias("arrays"))


def fold_summaries(arrays: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """SRC11: the archives' scalars ``names`` as columns; NULL where an archive has none."""
    return arrays.select("p_index", "outer_fold", *(F.element_at(F.col("arrays")[n], 1).alias(n) for n in names))


def fold_scores(arrays: DataFrame, grid: tuple[float, ...], per_repeat: int, part: str = "test") -> DataFrame:
    """SRC11: (p, repeat, fold, s, y, score, prediction) of the ``part`` (test or train) of every archive."""
    repeat, fold = coordinates(F.col("outer_fold"), per_repeat)
    zipped = F.arrays_zip(*(F.col("arrays")[n].alias(c) for n, c in ((f"{part}_idx", "s"), (f"y_{part}", "y"), (f"{part}_scores", "score"), (f"{part}_pred", "prediction"))))
    p = F.element_at(F.array(*map(F.lit, grid)), (F.col("p_index") + 1).cast("int"))
    rows = arrays.select(p.alias("p"), repeat.alias("repeat"), fold.alias("fold"), F.inline(zipped))
    return rows.select("p", "repeat", "fold", F.col("s").cast("long").alias("s"), F.col("y").cast("int").alias("y"), "score", F.col("prediction").cast("int").alias("prediction"))

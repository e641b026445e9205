"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}

#: Scratch tables of each scope that is open, the innermost last.
_SCOPES: list[list[str]] = []

#: One BLAS thread per task: parallelism is Spark's.
BLAS = {k: "1" for k in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS")}


def session(app: str = "gramweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and single-threaded BLAS on executors; ``conf`` keys use _ for the dots of settings."""
    for k, v in BLAS.items():
        os.environ.setdefault(k, v)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.python.filterPushdown.enabled": "true"}
    settings |= {f"spark.executorEnv.{k}": v for k, v in BLAS.items()} | {k.replace("_", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in local mode without one a new temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="gramweave-")
    return root.rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """A folder in the store that all executors share; removed when the driver's JVM ends."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/run-{uuid.uuid4().hex}")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _FOLDERS[app] = fs.makeQualified(path).toString()
    return _FOLDERS[app]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A scope whose scratch tables are deleted when it ends.

    Inside, a result is written to its own place; what was stored on the way is not needed again, for a lost executor reads the result.  Frames built on
    tables of the scope must not be used after it.
    """
    own: list[str] = []
    _SCOPES.append(own)
    try:
        yield
    finally:
        _SCOPES[:] = [x for x in _SCOPES if x is not own]
        for uri in own:
            path = spark._jvm.org.apache.hadoop.fs.Path(uri)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """``df`` written as Parquet and read back: computed once, whatever is built on it.  It stays until the scope of ``scratch`` or the driver's JVM ends."""
    path = new_path(df.sparkSession, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)

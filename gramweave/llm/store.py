"""Tables written once into the folder that all executors share.

Iterative operators cut their lineage by writing a table and reading it back, so a lost executor costs only the tasks it was
running.  The folder is the cluster's ``spark.checkpoint.dir``; only in local mode (tests, a single machine) one is made where that is unset.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """URI of this session's scratch folder in the shared store; removed when the driver's JVM ends."""
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if root is None:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="gramweave-")
            spark.sparkContext.setCheckpointDir(root)
        uri = f"{root.rstrip('/')}/gramweave-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(uri)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _OWN[app] = fs.makeQualified(path).toString()
    return _OWN[app]


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back; what follows no longer depends on its lineage."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing will read again, and lets Spark's cleaner find the shuffles of the steps before.

    Only what has been consumed by a later written table may go: a lost executor reads that one, not these.
    """
    spark = tables[0].sparkSession
    for df in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(_FOLDERS.pop(df))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from gramweave.sources import readers, writers
from gramweave.streaming.statistics import run_once, windowed


def test_delimiters(spark, tmp_path):
    assert [readers.sniffed(x) for x in ("a;b;c", "a\tb", "a,b", "lonely", "")] == [";", "\t", ",", ",", ","]
    (tmp_path / "m.csv").write_text("id|label\n1|x\n2|y\n")
    assert [tuple(r) for r in readers.metadata(spark, str(tmp_path / "m.csv")).collect()] == [(1, "x"), (2, "y")]


def test_matrix_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1, 2\n3,4e0\n\n")
    row = readers.matrix_csv(spark, str(tmp_path / "a.csv")).collect()[0]
    assert (row.n, row.a) == (2, [1.0, 2.0, 3.0, 4.0])
    for bad in ("1,2\n3\n", "1,x\n2,3\n", "nan,1\n1,2\n"):
        (tmp_path / "b.csv").write_text(bad)
        with pytest.raises(Exception, match="not a finite square matrix"):
            readers.matrix_csv(spark, str(tmp_path / "b.csv")).collect()
    np.save(tmp_path / "c.npy", np.arange(6.0).reshape(2, 3))
    assert readers.matrix_npy(spark, str(tmp_path)).collect()[0].shape == [2, 3]
    blob = io.BytesIO()
    np.savez(blob, x=np.array([1.0, np.nan]))
    (tmp_path / "d.npz").write_bytes(blob.getvalue())
    assert readers.archive_npz(spark, str(tmp_path)).collect()[0].a == [1.0, 0.0]


def test_texts_and_names(spark):
    lines = spark.createDataFrame([(1, "[1 2; 3 4]"), (2, "  ")], "line int, value string")
    assert readers.bracketed(lines, 2, 2).count() == 4
    with pytest.raises(Exception, match="another shape"):
        readers.bracketed(lines, 2, 3).collect()
    names = spark.createDataFrame([("a10.csv",), ("a2.csv",), ("a2b.csv",)], "n string")
    assert [r.n for r in names.orderBy(readers.natural_key(F.col("n"))).collect()] == ["a2.csv", "a2b.csv", "a10.csv"]
    with pytest.raises(Exception, match="unknown matrix format"):
        names.select(readers.file_format(F.lit("x.mat"))).collect()


def test_distance_faults(spark):
    rows = [(1.0, 1, 1, 0.5), (1.0, 1, 2, -1.0), (1.0, 2, 1, float("nan"))]
    r = readers.distance_faults(spark.createDataFrame(rows, "p double, s int, t int, d double"), 2).collect()[0]
    assert (r.missing, r.not_finite, r.negative, r.diagonal) == (1, 1, 1, 1)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.5), (2, 2.5)], "p_index int, d double")
    writers.partitioned(df, str(tmp_path / "d"), "p_index")
    assert writers.try_read(spark, f"file://{tmp_path}/d").where("p_index = 2").count() == 1
    assert writers.try_read(spark, f"file://{tmp_path}/none") is None
    assert writers.remaining(df, df.where("p_index = 1"), ["p_index"]).count() == 1
    assert writers.configuration_hash({"a": 1}) != writers.configuration_hash({"a": 2})
    assert "1.5" in writers.report(df)


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    got = run_once(spark, str(tmp_path / "in"), str(tmp_path / "check"), "stream_stats").collect()
    want = windowed(events.withColumn("ts", F.col("ts").cast("timestamp"))).collect()
    assert sorted((r.window_start, r.event_type, r.n) for r in got) == sorted((r.window_start, r.event_type, r.n) for r in want)


def test_matrices_below_a_folder(spark, tmp_path):
    """All files of a suffix, in folders too, without a pattern that the driver expands."""
    from gramweave.sources import readers

    for k in (1, 2):
        (tmp_path / f"s={k}").mkdir()
        (tmp_path / f"s={k}" / "part.txt").write_text(f"1,{k}\n{k},1\n")
    (tmp_path / "s=1" / "other.csv").write_text("no matrix")
    rows = readers.matrix_csv(spark, str(tmp_path), suffix=".txt").collect()
    assert sorted((r.path.split("/")[-2], r.n, r.a) for r in rows) == [("s=1", 2, [1.0, 1.0, 1.0, 1.0]), ("s=2", 2, [1.0, 2.0, 2.0, 1.0])]

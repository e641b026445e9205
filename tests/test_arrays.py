import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual

from gramweave.sources import arrays
from gramweave.sources.arrays import FilteredNpyReader, NpyReader, npy_rows, pair_of_row, spectra_npy


def rows(df):
    return sorted((r.row, r["values"]) for r in df.collect())


@pytest.mark.parametrize("kind", ["<f8", ">f8", "<f4", "<i4", "u1", "?"])
@pytest.mark.parametrize("order", ["C", "F"])
def test_ranges_and_columns(spark, tmp_path, kind, order):
    a = np.asarray(np.arange(91).reshape(13, 7) % 5, dtype=kind, order=order)
    np.save(tmp_path / "a.npy", a)
    want = [(i, list(map(float, x))) for i, x in enumerate(a)]
    df = npy_rows(spark, f"file://{tmp_path}/a.npy", partition_bytes=2 * 7 * a.itemsize)
    assert df.rdd.getNumPartitions() == 7 and rows(df) == want
    assert rows(npy_rows(spark, f"file://{tmp_path}/a.npy", (6, 0), 1)) == [(i, [x[6], x[0]]) for i, x in want]


class Counting:
    def __init__(self, f, seen):
        self.f, self.seen = f, seen

    def __enter__(self):
        return self

    def __exit__(self, *a):
        self.f.close()

    def size(self):
        return self.f.size()

    def read_at(self, n, at):
        self.seen.append((at, at + n))
        return self.f.read_at(n, at)


@pytest.mark.parametrize("order", ["C", "F"])
def test_a_task_reads_its_own_range(tmp_path, monkeypatch, order):
    a = np.asarray(np.random.default_rng(1).normal(size=(1000, 16)), order=order)
    np.save(tmp_path / "a.npy", a)
    seen, real = [], arrays.opened
    monkeypatch.setattr(arrays, "opened", lambda path: Counting(real(path), seen))
    monkeypatch.setattr(arrays, "READ_BYTES", 10 * 16 * 8)
    reader = NpyReader({"path": str(tmp_path / "a.npy"), "partition_bytes": str(100 * 16 * 8)})
    assert sum(b - a for a, b in seen) <= arrays.HEAD_BYTES
    parts = reader.partitions()
    assert len(parts) == 10
    for part in parts:
        seen.clear()
        got = np.concatenate([np.array(b["values"].to_pylist()) for b in reader.read(part)])
        assert np.array_equal(got, a[part.first : part.stop])
        assert sum(hi - lo for lo, hi in seen) == 100 * 16 * 8
        assert max(hi - lo for lo, hi in seen) <= 10 * 16 * 8


def test_filters_narrow_the_ranges(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(300.0).reshape(100, 3))
    options = {"path": str(tmp_path / "a.npy"), "partition_bytes": "240"}
    for filters, span in (
        ([GreaterThanOrEqual(("row",), 20), LessThan(("row",), 35)], (20, 35)), ([GreaterThan(("row",), 20), LessThanOrEqual(("row",), 35)], (21, 36)),
        ([EqualTo(("row",), 7)], (7, 8)), ([EqualTo(("row",), 7), EqualTo(("row",), 8)], (8, 8)), ([LessThan(("row",), 0)], (0, 0)),
    ):
        reader = FilteredNpyReader(options)
        assert list(reader.pushFilters(filters)) == []
        parts = reader.partitions()
        assert sum(p.stop - p.first for p in parts) == max(0, span[1] - span[0])
        assert not parts or (parts[0].first, parts[-1].stop) == span
        if parts:
            assert [r for r, _ in rows(npy_rows(spark, options["path"], first=span[0], stop=span[1]))] == list(range(*span))
    other = EqualTo(("path",), "x")
    assert list(FilteredNpyReader(options).pushFilters([other])) == [other]
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = npy_rows(spark, f"file://{tmp_path}/a.npy", partition_bytes=240).where("row >= 20 and row < 35")
        assert [r for r, _ in rows(df)] == list(range(20, 35))
        assert df.rdd.getNumPartitions() == 2
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def test_pairs_of_rows(spark):
    for n in (2, 3, 10, 57):
        i, j = np.triu_indices(n, 1)
        s, t = pair_of_row(F.col("id"), n)
        got = spark.range(len(i)).select("id", s.alias("s"), t.alias("t")).orderBy("id").collect()
        assert [(r.s, r.t) for r in got] == list(zip(i.tolist(), j.tolist(), strict=True))
    # Where the root rounds: the first and last places of rows near the end of ten million subjects.
    n = 10_000_000
    starts = {s: s * (2 * n - s - 1) // 2 for s in (0, 1, 5, n // 2, n - 3, n - 2)}
    places = [(k + e, s, s + 1 + e) for s, k in starts.items() for e in (0, n - 2 - s)]
    s, t = pair_of_row(F.col("k"), n)
    df = spark.createDataFrame(places, "k long, s long, t long")
    assert df.where((s != F.col("s")) | (t != F.col("t"))).isEmpty()


def test_spectra_and_faults(spark, tmp_path):
    a = np.full((6, 4), np.nan)
    for k in range(6):
        a[k, : 1 + k % 4] = k + 1
    (tmp_path / "many").mkdir()
    np.save(tmp_path / "many" / "a.npy", a)
    got = {(r.s, r.t): r.sv for r in spectra_npy(spark, f"file://{tmp_path}/many/a.npy", 4, 40).collect()}
    assert len(got) == 6 and got[0, 1] == [1.0] and got[2, 3] == [6.0, 6.0]
    np.save(tmp_path / "many" / "b.npy", np.arange(3.0))
    np.save(tmp_path / "many" / "c.npy", np.zeros((0, 5)))
    both = npy_rows(spark, f"file://{tmp_path}/many")
    assert both.groupBy(F.substring_index("path", "/", -1).alias("f")).count().orderBy("f").collect() == [("a.npy", 6), ("b.npy", 3)]
    whole = (tmp_path / "many" / "a.npy").read_bytes()
    (tmp_path / "cut.npy").write_bytes(whole[:-8])
    with pytest.raises(ValueError, match="ends before"):
        arrays.layout(str(tmp_path / "cut.npy"))
    np.save(tmp_path / "text.npy", np.array(["a", "b"]))
    with pytest.raises(ValueError, match="no array of numbers"):
        arrays.layout(str(tmp_path / "text.npy"))

import logging
import math
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from gramweave.operators import tables
from jobs import feature_selection, population_geometry
from jobs.common import configuration, own_configuration

DOCS = "doc_id long, source string, text string"


def corpus(first, n):
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    out = [(i, None if i % 7 == 0 else f"s{i % 3}", " ".join(words[(i * k) % (3 + i % 3)] for k in range(1, 4 + i % 5)) + " Alpha 12") for i in range(first, first + n)]
    return [*out, (first, "s1", None), (first, "s1", ""), out[0]]


def expected(docs, scale=1e4):
    """The donor-balanced statistics and rankings in plain Python, but for the residual."""
    import re

    cells, sums = Counter(), defaultdict(lambda: [0.0, 0.0, 0])
    for _, source, text in docs:
        donor = source or "(none)"
        cells[donor] += 1
        found = Counter(re.findall("[a-z]+", (text or "").lower()))
        for gene, n in found.items():
            x = math.log1p(n * scale / sum(found.values()))
            s = sums[gene, donor]
            s[0] += x
            s[1] += x * x
            s[2] += 1
    genes = {}
    for gene in {g for g, _ in sums}:
        own = [(sums[gene, d], cells[d]) for d in cells if (gene, d) in sums]
        mean, second, rate = (sum(s[i] / n for s, n in own) / len(cells) for i in range(3))
        variance = max(second - mean * mean, 0.0)
        if len(own) / len(cells) >= 0.9 and rate >= 0.02 and variance > 0:
            genes[gene] = {"variance": variance, "fano": variance / mean}
    return {m: [(g, round(genes[g][m], 6)) for g in sorted(genes, key=lambda g: (-round(genes[g][m], 9), g))] for m in ("variance", "fano")}


def rankings(df):
    out = defaultdict(list)
    for r in df.orderBy("method", "rank").collect():
        out[r.method].append((r.gene, round(r.score, 6)))
    return dict(out)


@pytest.fixture
def stream(spark, tmp_path):
    root = tmp_path.as_uri()

    def config(name="job"):
        return own_configuration(spark, feature_selection.__file__, documents=f"{root}/docs", state=f"{root}/{name}/state", output=f"{root}/{name}/ranking")

    def add(rows):
        spark.createDataFrame(rows, DOCS).coalesce(1).write.mode("append").parquet(f"{root}/docs")

    return config, add


def reads(caplog):
    return [r.getMessage() for r in caplog.records if "new documents" in r.getMessage()]


def test_only_new_documents_are_taken(spark, stream, caplog):
    caplog.set_level(logging.INFO, "gramweave.jobs")
    config, add = stream
    old, new = corpus(0, 60), corpus(60, 45)
    add(old)
    assert rankings(feature_selection.run(spark, config())) == expected(old)
    add(new)
    assert rankings(feature_selection.run(spark, config())) == expected(old + new)
    again = feature_selection.run(spark, config())
    assert rankings(again) == expected(old + new)
    assert [m.split()[1] for m in reads(caplog)] == [str(len(old)), str(len(new)), "0"]
    whole = feature_selection.run(spark, config("whole") | {"files_per_batch": 1})
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, again.collect()))


def test_a_broken_run_is_repaired(spark, stream, monkeypatch):
    config, add = stream
    old, new = corpus(0, 50), corpus(50, 20)
    add(old)
    feature_selection.run(spark, config())
    add(new)
    sums, calls = feature_selection.selection.donor_sums, []

    def broken(values):
        calls.append(1)
        raise RuntimeError("lost")

    monkeypatch.setattr(feature_selection.selection, "donor_sums", broken)
    with pytest.raises(Exception, match="lost"):
        feature_selection.run(spark, config())
    assert calls
    monkeypatch.setattr(feature_selection.selection, "donor_sums", sums)
    # The batch had written its sums and went down before its counts and its commit.
    batch = spark.createDataFrame(new, DOCS)
    feature_selection.leave_sums(batch, 1, config())
    feature_selection.leave_sums(batch, 1, config())
    monkeypatch.setattr(feature_selection, "ranked", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        feature_selection.run(spark, config())
    monkeypatch.undo()
    assert rankings(feature_selection.run(spark, config())) == expected(old + new)


def test_no_documents(spark, stream):
    config, add = stream
    add([])
    assert feature_selection.run(spark, config()).collect() == []
    add([(1, None, None)])
    assert feature_selection.run(spark, config()).collect() == []


def test_run_lengths(spark):
    rows = [(["b", "a", "b", "b", "c"],), ([],), (None,), (["x"],), (["y"] * 1000 + ["z"],)]
    df = spark.createDataFrame(rows, "t array<string>").select(F.array_sort("t").alias("t"))
    got = [r[0] for r in df.select(tables.run_lengths(F.col("t"))).collect()]
    assert [None if g is None else [tuple(x) for x in g] for g in got] == [[("a", 1), ("b", 3), ("c", 1)], [], None, [("x", 1)], [("y", 1000), ("z", 1)]]


def measurements(n):
    draw = np.random.default_rng(4)
    rows = [(s, float(a), float(b), float(c)) for s in range(n) for a, b, c in draw.normal(size=(5, 3))]
    return [*rows, *((90, 1.0, float(k), float(k * k)) for k in range(4)), (91, 1.0, 2.0, 3.0), (None, 1.0, 1.0, 1.0), *((92, *map(float, x)) for x in draw.normal(size=(4, 3)))]


def test_population_geometry(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO, "gramweave.jobs")
    root, n = tmp_path.as_uri(), 9
    rows = measurements(n)
    # 90 has a constant unit, 91 one row; 92 has no label, 93 no measurements, and 8 is in the measurements alone.
    people = [(s, float(s % 4)) for s in range(n - 1)] + [(90, 1.0), (91, 2.0), (92, None), (93, 3.0), (None, 9.0), (0, -5.0)]
    spark.createDataFrame(rows, "l_suppkey long, l_quantity double, l_extendedprice double, l_discount double").write.parquet(f"{root}/m")
    spark.createDataFrame(people, "s_suppkey long, s_acctbal double").write.parquet(f"{root}/p")
    config = own_configuration(spark, population_geometry.__file__, measurements=f"{root}/m", subjects=f"{root}/p", output=f"{root}/out", grid=[1.0, 2.0, 7.0])
    got = {(r.p, r.s): r for r in population_geometry.run(spark, config | {"grid": [1.0, 2.0]}).collect()}
    again = {(r.p, r.s): r for r in population_geometry.run(spark, config | {"grid": [1.0, 2.0]}).collect()}
    assert got == again and {p for p, _ in got} == {1.0, 2.0}
    assert {s: got[1.0, s].reason for _, s in got if got[1.0, s].reason} == {8: "no subject", 90: "not finite", 91: "not finite", 92: "no label", 93: "no measurements"}
    label = {s: float(s % 4) for s in range(n - 1)} | {90: 1.0, 91: 2.0, 93: 3.0}
    cut = np.median(list(label.values()))
    rho = {s: np.corrcoef(np.array([r[1:] for r in rows if r[0] == s]).T) / 3 for s in range(n - 1)}
    for p in (1.0, 2.0):
        for s in rho:
            d = {t: (np.abs(np.linalg.eigvalsh(rho[s] - rho[t])) ** p).sum() ** (1 / p) for t in rho if t != s}
            same = [x for t, x in d.items() if (label[t] >= cut) == (label[s] >= cut)]
            other = [x for t, x in d.items() if (label[t] >= cut) != (label[s] >= cut)]
            r = got[p, s]
            assert (r.y, r.n_pairs) == (int(label[s] >= cut), len(d))
            want = [np.mean(list(d.values())), math.sqrt(np.mean([x * x for x in d.values()])), max(d.values()), np.mean(same), np.mean(other), np.mean(other) - np.mean(same)]
            assert [r.mean_distance, r.rms_distance, r.max_distance, r.own_class, r.other_class, r.margin] == pytest.approx(want, abs=1e-8)
    assert all((r.n_pairs, r.mean_distance, r.margin) == (0, None, None) for r in got.values() if r.reason)
    assert any("1 without a subject" in r.getMessage() for r in caplog.records)
    assert {r.p for r in population_geometry.run(spark, config).select("p").distinct().collect()} == {1.0, 2.0, 7.0}


def test_empty_population(spark, tmp_path):
    root = tmp_path.as_uri()
    spark.createDataFrame([], "l_suppkey long, l_quantity double, l_extendedprice double, l_discount double").write.parquet(f"{root}/m")
    spark.createDataFrame([], "s_suppkey long, s_acctbal double").write.parquet(f"{root}/p")
    config = own_configuration(spark, population_geometry.__file__, measurements=f"{root}/m", subjects=f"{root}/p", output=f"{root}/out")
    assert population_geometry.run(spark, config).collect() == []


def test_configuration(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"a": 1,\n "b": [1.5, 2.0]}')
    assert configuration(spark, (tmp_path / "c.json").as_uri(), a=None, output="x") == {"a": 1, "b": [1.5, 2.0], "output": "x"}
    assert all(a < b for a, b in pairwise(own_configuration(spark, population_geometry.__file__)["grid"]))

"""The pipeline's stages against plain Python on a small fixture."""

import random
import sys
import zlib
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from tests.llm.test_bpe import library  # noqa: E402
from tests.llm.test_near_dup import brute  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(9)
    vocab = [a + b + c for a in ("ka", "lo", "mi", "tu") for b in ("na", "so", "vi") for c in ("du", "pe", "ro", "x")]
    make = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(k, make(14)) for k in range(6)]
    rows = {i: make(r.randint(30, 90)) for i in range(160)}
    toxic = set(range(0, 160, 4))
    for i in toxic:
        w = rows[i].split()
        for _ in range(3):
            w.insert(r.randrange(len(w)), r.choice(["idiot", "moron"]))
        rows[i] = " ".join(w)
    quality = {200: "", 201: None, 202: "too short", 203: "same same same " * 20, 204: make(30).replace(" ", " ### ")}
    copies = {300: rows[1], 301: rows[1] + " tail", 302: rows[2].upper()}
    leaked = {400: make(20) + " " + items[2][1].title() + ". " + make(20)}
    rows |= quality | copies | leaked
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash") for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long, token_ids string").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path), rows, toxic, set(quality), set(leaked)


def test_stages(spark, folder):
    path, rows, toxic, bad, leaked = folder
    got = corpus_pipeline.run(spark, path)
    held_in = [i for i in toxic if zlib.crc32(str(i).encode()) % 5]
    assert len(held_in) > 20
    clean = {i: t for i, t in rows.items() if i not in bad and i not in toxic}
    first = {i for i, (_, c) in brute(clean.items(), 5, 80).items() if i == c}
    want = first - leaked
    out = {r.doc_id: r for r in got.collect()}
    assert set(out) == want
    encode = library().encode_ordinary
    assert all(r.text == rows[i] and r.token_ids == encode(rows[i]) and r.lang == "en" for i, r in out.items())
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "token_ids"]


def test_each_stage_keeps_the_columns(spark, folder):
    path = folder[0]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns, name
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, path).count() == 0, name

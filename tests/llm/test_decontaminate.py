import hashlib
import random
import re

from gramweave.llm import decontaminate
from gramweave.llm.decontaminate import clean, op3_decontamination, scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(t):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))


def brute(docs, items, size=10):
    out = {}
    for i, t in docs:
        w = split(t)
        hit, ids = set(), set()
        for item, text in items:
            q = split(text)
            for j in range(max(1, len(q) - size + 1)) if q else ():
                x = q[j : j + size]
                for at in range(len(w) - len(x) + 1):
                    if w[at : at + len(x)] == x:
                        hit.update(range(at, at + len(x)))
                        ids.add(str(item))
        out[i] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
    return out


def cases():
    r = random.Random(5)
    v = ["alpha", "Beta", "gamma2", "é", "DELTA", "x", "漢字"]
    items = [(k, " ".join(r.choice(v) for _ in range(r.choice([1, 3, 9, 10, 11, 25])))) for k in (1, 2, 10, 11, 12, 13)] + [(14, ""), (15, None), (16, "...")]
    docs = []
    for i in range(80):
        words = [r.choice(v) for _ in range(r.choice([0, 1, 5, 30, 60]))]
        if r.random() < 0.6:
            words[len(words) // 2 : len(words) // 2] = (r.choice(items)[1] or "").upper().split()
        docs.append((i, r.choice([" ", ", ", "--", "\n\x00 "]).join(words)))
    return docs + [(80, None), (81, "  "), (82, "é" * 3)], items


def test_against_brute_force(spark, monkeypatch):
    docs, items = cases()
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, n_words int")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)

    def got():
        return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in op3_decontamination(d, b).collect()}

    assert got() == want
    monkeypatch.setattr(decontaminate, "blocks", lambda items, size: decontaminate_blocks(items, size, 40))
    assert got() == want


decontaminate_blocks = decontaminate.blocks


def test_offsets_map_to_the_original(spark):
    item = "one two three four five six seven eight nine ten"
    text = "Ünïcödé — " + item.upper().replace(" ", "; ") + " rest"
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = scan(d, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()[0]
    assert text[row.span_start[0] : row.span_end[0]] == item.upper().replace(" ", "; ")


def test_offsets_over_several_automata(spark, monkeypatch):
    docs, items = cases()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, scan(d, b).collect()))
    monkeypatch.setattr(decontaminate, "blocks", lambda items, size: decontaminate_blocks(items, size, 40))
    assert len(list(decontaminate.blocks(items, 10))) > 1
    assert sorted(map(tuple, scan(d, b).collect())) == one
    assert any(len(r[4]) > 1 for r in one)


def test_string_ids(spark):
    docs = spark.createDataFrame([("a", "one two"), ("b", "three")], "doc_id string, text string")
    items = spark.createDataFrame([("x1", "two"), ("x0", "ONE two")], "item_id string, text string")
    assert {r.doc_id: (r.n_hit, r.n_items, r.items_sha256) for r in op3_decontamination(docs, items).collect()} == {"a": (2, 2, hashlib.sha256(b"x0,x1").hexdigest()), "b": (0, 0, hashlib.sha256(b"").hexdigest())}
    assert [r.doc_id for r in clean(docs, items).collect()] == ["b"]


def test_rows_are_judged_by_their_own_text(spark, monkeypatch):
    docs, items = cases()
    want = brute(docs, items)
    d = spark.createDataFrame([(i % 50, t, i) for i, t in docs], "doc_id long, text string, hit int")
    b = spark.createDataFrame(items, "item_id long, text string")
    for limit in (1 << 20, 40):
        monkeypatch.setattr(decontaminate, "blocks", lambda items, size, limit=limit: decontaminate_blocks(items, size, limit))
        left = clean(d, b)
        assert left.columns == d.columns and {r.hit for r in left.collect()} == {i for i, x in want.items() if not x[4]}


def test_empty_tables(spark):
    none, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert op3_decontamination(none, items).count() == 0
    docs = spark.createDataFrame([(1, "a b"), (None, "c")], "doc_id long, text string")
    assert [r.n_hit for r in op3_decontamination(docs, items).collect()] == [0, 0]
    assert clean(docs, spark.createDataFrame([(1, "c")], "item_id long, text string")).count() == 2

import hashlib
import random
from datetime import datetime

from gramweave.llm import warc
from gramweave.llm.warc import LoserTree, histories, op8_warc, parse, read_archives, record, url_key, write_archives


def test_loser_tree():
    r = random.Random(1)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted((r.randrange(50), r.random()) for _ in range(r.choice([0, 1, 40]))) for _ in range(k)]
        assert list(LoserTree([iter(x) for x in runs])) == sorted(x for run in runs for x in run)


def test_records_and_keys():
    data = record(5, "http://a.b/\r\nX: y", "2024-01-01T00:00:00Z", b"a\r\n\r\nb", "00", None)
    headers, block = parse(data)
    assert headers["warc-target-uri"] == "http://a.b/%0D%0AX: y" and block.endswith(b"\r\n\r\na\r\n\r\nb")
    assert url_key("https://WWW.Example.com/a?b#c") == "com,example,www)/a?b" and url_key(None) == "" and url_key("http://x") == "x)/"


def pages():
    big, other = "é" * 600, "z" * 1000
    rows = [(i, f"http://h{i % 7}.example.com/{i % 3}?q={i}", f"page {i}" * (i % 90)) for i in range(150)]
    rows += [(200, "http://a/", big), (201, None, big), (202, "", big), (203, "u", other), (204, "v\n", other[:-1]), (205, "w", other[:-1]), (206, "x", None), (207, "y", ""), (206, "x", None), (208, "http://k/", other), (208, "http://k/", other), (None, "n", big), (None, "m", "only")]
    return rows


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "RUN_BYTES", 4000)
    monkeypatch.setattr(warc, "RANGE_ROWS", 40)
    rows = pages()
    df = spark.createDataFrame([(a, b, c, 1) for a, b, c in rows], "page_id long, url string, html string, digest int").repartition(4)
    got = op8_warc(df).collect()
    best = {}
    for i, _, t in rows:
        p = (t or "").encode()
        if len(p) >= 1000 and i is not None:
            best[p] = max(best.get(p, -1), i)
    want = []
    for i, _, t in rows:
        p = (t or "").encode()
        refers = best.get(p) if best.get(p) != i else None
        want.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if refers is not None else "response", refers))
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    order = [(r.url_key, r.captured, -1 if r.page_id is None else r.page_id) for r in got]
    assert order == sorted(order)


def test_one_page_in_most_captures(spark, monkeypatch):
    monkeypatch.setattr(warc, "HOT", 1)
    error, other = "e" * 1200, "o" * 1100
    rows = [(i, f"http://h/{i}", error if i % 4 else None if i % 8 else other) for i in range(1600)] + [(None, "http://n/", error)]
    got = {r.page_id: (r.record_type, r.refers_to) for r in op8_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    last = {error: 1599, other: 1592, None: None}
    assert got == {i: ("response", None) if t is None or i == last[t] else ("revisit", last[t]) for i, _, t in rows}


def test_own_times_and_empty(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a/", "x", datetime(2020, 5, 1, 12)), (2, "http://a/", "y", datetime(2019, 5, 1, 12))], "page_id long, url string, html string, captured timestamp")
    folder = f"file://{tmp_path}"
    got = read_archives(histories(write_archives(df, folder)), folder).collect()
    assert [r.page_id for r in got] == [2, 1] and got[0].captured.startswith("2019-05-01T")
    assert op8_warc(df.limit(0).drop("captured")).count() == 0

import random
import re
from collections import Counter

import pyarrow as pa

from gramweave.llm import near_dup
from gramweave.llm.near_dup import drop_near_duplicates, least_matches, near_duplicates

SCHEMA = "doc_id long, text string, component_id string, kept int"


def brute(rows, shingle, percent):
    """All pairs of the rows' shingle sets, then a union-find."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[i] = {tuple(w[j : j + shingle]) for j in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(n=220, seed=3):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows, i = [], 0
    base = []
    while i < n:
        kind = r.random()
        if kind < 0.3 or not base:
            words = [r.choice(vocab) for _ in range(r.choice([1, 2, 3, 30, 80, 200]))]
            base.append(words)
        else:
            words = list(r.choice(base))
            for _ in range(r.choice([0, 1, 2, 5, len(words) // 10])):
                words[r.randrange(len(words))] = r.choice(vocab)
            base.append(words)
        rows.append((i, r.choice([" ", "\n", "  "]).join(words)))
        i += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "Solo"), (n + 4, "SOLO"), (n + 5, "é" * 5), (n + 6, "É" * 5), (n + 7, "x\x00y z q")]
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    for shingle in (2, 5):
        want = brute(rows, shingle, 80)
        df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA).repartition(5)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, shingle, 80).collect()}
        assert got == want
        assert all(r.kept == (r.component_id == r.doc_id) for r in near_duplicates(df, shingle, 80).collect())


def test_chain_and_hub(spark):
    """A chain of near copies of which the ends differ, within one large group."""
    words = [f"c{i}" for i in range(100)]
    rows = []
    for i in range(60):
        words = list(words)
        words[i] = f"x{i}"
        rows.append((i, " ".join(words)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()
    assert {r.component_id for r in got} == {0}


def test_pairs_about_the_threshold_in_cells_of_many_blocks(spark, monkeypatch):
    """Groups whose pairs lie between 0.75 and 0.87: every link is found, whatever the cells; few leaders leave most to the cells."""
    r = random.Random(11)
    rows = []
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(150)]
        for k in range(30):
            own = list(base)
            for j in r.sample(range(150), r.randrange(4, 9)):
                own[j] = f"g{g}k{k}j{j}"
            rows.append((len(rows), " ".join(own)))
    want = {i: c for i, (_, c) in brute(rows, 2, 80).items()}
    assert 6 < len(set(want.values())) < len(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for size, tries in ((8 << 20, 1), (20_000, 1), (3_000, 0), (20_000, 24)):
        monkeypatch.setattr(near_dup, "CELL_BYTES", size)
        monkeypatch.setattr(near_dup, "TRIES", tries)
        assert {x.doc_id: x.component_id for x in near_duplicates(df, 2, 80).collect()} == want


def test_one_text_in_most_rows(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "HOT", 1)
    rows = [(i, "same words here" if i % 3 else f"own text {i}" if i % 2 else None) for i in range(1900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_duplicates(df, 2, 80).collect()}
    assert got == {i: (2 if t else 0, 1 if t == "same words here" else i) for i, t in rows}


def test_defined_cases(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(df).count() == 0
    rows = [(7, "a b c", "x", 1), (7, "a b c", "x", 1), (None, "a b c", "x", 1), (None, "q r s", "x", 1), (9, None, None, None), (3, "A b C", "x", 1)]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA), 2).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [("3", "3", True), ("7", "3", False), ("7", "3", False), ("9", "9", True), ("None", "3", False), ("None", "None", True)]
    left = drop_near_duplicates(spark.createDataFrame(rows, SCHEMA), 2)
    assert left.columns == ["doc_id", "text", "component_id", "kept"]
    assert sorted(str(r.doc_id) for r in left.collect()) == ["3", "9", "None", "None"]


def test_rows_of_repeated_ids_are_dropped_one_by_one(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "a b c"), (1, "a b c"), (1, "other text here"), (2, "A b C"), (4, long), (5, long + " x"), (5, "quite another one"), (None, long + " y"), (None, "n o n e")]
    left = drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 2)
    assert left.columns == ["doc_id", "text"]
    got = sorted((str(r.doc_id), r.text) for r in left.collect())
    assert got == sorted([("1", "a b c"), ("1", "other text here"), ("4", long), ("5", "quite another one"), ("None", long + " y"), ("None", "n o n e")])


def test_string_ids(spark):
    rows = [("b", "x y z"), ("a", "X y z"), ("c", "other words"), ("d", None)]
    left = drop_near_duplicates(spark.createDataFrame(rows, "doc_id string, text string"), 2)
    assert sorted(r.doc_id for r in left.collect()) == ["a", "c", "d"]


def test_buckets_over_batches():
    """Runs of equal keys that batches cut anywhere."""
    r = random.Random(4)
    for _ in range(200):
        rows = sorted((r.randrange(6), i, r.randrange(1, 5)) for i in range(r.randrange(12)))
        cuts = sorted(r.randrange(len(rows) + 1) for _ in range(3))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
        batches = [pa.RecordBatch.from_arrays([pa.array([x[k] for x in part], pa.int64()) for k in range(3)], ["key", "id", "n"]) for part in parts]
        got = [tuple(x.values()) for b in near_dup._buckets(iter(batches)) for x in b.to_pylist()]
        members = Counter(k for k, _, _ in rows)
        lead = {k: min(i for q, i, _ in rows if q == k) for k in members}
        assert got == [(k, i, n, lead[k]) for k, i, n in rows if members[k] > 1]


def test_buckets_over_ranges():
    """Whatever ranges cut the sorted rows, members of a bucket stay and are paired with leaders that the first one leads."""
    r = random.Random(5)
    for _ in range(200):
        rows = sorted((r.randrange(4), i, r.randrange(1, 5)) for i in range(r.randrange(1, 14)))
        cuts = sorted(r.randrange(len(rows) + 1) for _ in range(3))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
        got = []
        for part in parts:
            at = r.randrange(len(part) + 1)
            batches = [pa.RecordBatch.from_arrays([pa.array([x[k] for x in some], pa.int64()) for k in range(3)], ["key", "id", "n"]) for some in (part[:at], part[at:])]
            found = [tuple(x.values()) for b in near_dup._buckets(iter(batches), True) for x in b.to_pylist()]
            assert [x[4] for x in found] == [True] * bool(part) + [False] * (len(found) - 1)
            assert all(x[3] == min(i for q, i, _ in part if q == x[0]) for x in found)
            got += found
        members = Counter(k for k, _, _ in rows)
        assert len({x[:2] for x in got}) == len(got)
        assert {x[:3] for x in got} >= {x for x in rows if members[x[0]] > 1}
        marked = {x[0] for x in got if x[4]}
        assert all(k in marked for k in members if len({x[3] for x in got if x[0] == k}) > 1)


def test_led_across_ranges(spark):
    rows = [(1, 1, 9, 1, True), (1, 2, 9, 1, False), (1, 5, 9, 5, True), (1, 6, 9, 5, False), (2, 3, 9, 3, False), (2, 4, 9, 3, False), (3, 7, 9, 7, False)]
    got = near_dup._led(spark.createDataFrame(rows, "key long, id long, n long, leader long, cut boolean"))
    assert sorted(tuple(x) for x in got.collect()) == [(1, 2), (1, 5), (3, 4), (5, 6)]


def test_a_leader_of_many_blocks(spark, monkeypatch):
    """A third of all texts are near copies of one, in a bucket that ranges cut and blocks of two that are copied in groups of two."""
    for name, value in (("BLOCK", 2), ("FAN", 2)):
        monkeypatch.setattr(near_dup, name, value)
    r = random.Random(9)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(120):
        own = list(base) if i % 3 == 0 else [f"d{i // 4}x{j}" for j in range(60)]
        own[r.randrange(len(own))] = f"own{i}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = {i: c for i, (_, c) in brute(rows, 2, 80).items()}
    assert len(set(want.values())) < 40
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert {x.doc_id: x.component_id for x in near_duplicates(df, 2, 80).collect()} == want
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_copies_of_a_leader_come_in_groups(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "FAN", 4)
    blocks = spark.createDataFrame([(1, 1), (2, 4), (3, 5), (4, 23)], "a long, blocks int")
    members = spark.createDataFrame([(i, b"s%d" % i, b"x") for i in range(6)], "id long, signature binary, set binary")
    got = sorted((x.a, x.block, bytes(x.signature)) for x in near_dup._leaders(blocks, members).collect())
    assert got == [(a, k, b"s%d" % a) for a, n in ((1, 1), (2, 4), (3, 5), (4, 23)) for k in range(n)]


def test_posterior_bound():
    assert least_matches(160, 80, 1e-6) > 80
    assert least_matches(32, 80, 1e-6) < 25
    assert least_matches(32, 80, 1e-12) <= least_matches(32, 80, 1e-6)

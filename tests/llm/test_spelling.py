import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gramweave.llm import spelling
from gramweave.llm.spelling import op12_spelling, runs, variants


def is_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=10):
    """Every word against every other, by the definition alone."""
    out = {}
    for w, n in counts.items():
        near = [x for x in counts if is_near(w, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        form = best if best is not None and counts[best] >= ratio * n else None
        out[w] = [form, w, n, len(near), counts[form] if form else None]
    for w in out:
        while out[out[w][1]][0] is not None:
            out[w][1] = out[out[w][1]][0]
    return {w: tuple(v) for w, v in out.items()}


def rows_of(df):
    got = df.collect()
    assert len({r.word for r in got}) == len(got)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got}


def words_by(seed, alphabet, lengths, n):
    draw = random.Random(seed)
    base = ["".join(draw.choices(alphabet, k=draw.choice(lengths))) for _ in range(n)]
    return {w: int(10 ** draw.uniform(0, 5)) + 2 for w in base}


@pytest.mark.parametrize(("alphabet", "lengths", "n"), [("ab", range(1, 9), 300), ("abc", range(0, 6), 300), ("abcdefghijklmnopqrstuvwxyzàÿ×÷", range(2, 4), 500), ("a", range(1, 40), 60), ("zé", range(9, 12), 400)])
@pytest.mark.parametrize("hot", [1, 10_000])
def test_variants_against_brute_force(spark, monkeypatch, alphabet, lengths, n, hot):
    monkeypatch.setattr(spelling, "HOT_WORDS", hot)
    monkeypatch.setattr(spelling, "CHUNK_CHARS", 50)
    counts = words_by(len(alphabet), alphabet, lengths, n)
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert rows_of(variants(df)) == brute(counts)


def test_long_chains_and_ties(spark):
    counts = {"a" * 7 + "b" * i: 10**i for i in range(7)} | {"tie0000": 5, "tie000": 50, "tie00000": 50, "tie000x": 50, "alone": 2}
    got = rows_of(variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == brute(counts)
    assert got["a" * 7][:2] == ("aaaaaaab", "aaaaaaabbbbbb") and got["tie0000"][0] == "tie000"


def test_moves_are_bounded_by_the_logarithm(spark):
    """A word is in at most log2(words) light subtrees, whatever its length."""
    counts = words_by(5, "ab", range(100, 400), 200) | {"a" * i: 2 for i in range(1, 300)}
    df = spark.createDataFrame([(i, w, n) for i, (w, n) in enumerate(counts.items())], "id long, word string, n long")
    most = spelling.light_paths(df).groupBy("id").count().agg(F.max("count")).first()[0]
    assert most <= len(counts).bit_length()


def plain(docs):
    """Counts of the contract's words in plain Python."""
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{low}".encode())
            counts[low[: h % len(low)] + low[h % len(low) + 1 :] if h % 31 == 0 else low] += 1
    return counts


def test_whole_query_against_plain_python(spark):
    draw = random.Random(3)
    stems = ["".join(draw.choices("abcÉéÀÿ×TR", k=draw.randint(5, 10))) for _ in range(40)]
    docs = [(i, "".join(draw.choice(stems) + draw.choice([" ", "\n", "1", "-", "Ā", "😀"]) for _ in range(400))) for i in range(60)]
    giant = "xyzzy" * 50_000
    docs += [(100, None), (101, ""), (102, "a b c"), docs[0], docs[0], (None, docs[1][1]), (103, giant), (104, giant), (105, giant[:-1] + "q"), (106, giant[:-1] + "q")]
    schema = "doc_id long, text string, word string, n int, id long"
    got = rows_of(op12_spelling(spark.createDataFrame([(*d, "w", 1, 2) for d in docs], schema)))
    counts = {w: n for w, n in plain(docs).items() if n >= 2 and len(w) >= 7}
    assert len(counts) > 60 and any(len(w) > 200_000 for w in counts)
    assert got == brute(counts)


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert op12_spelling(empty).collect() == []
    assert runs(spark.createDataFrame([(None, None), (1, "")], "doc_id long, text string")).count() == 0

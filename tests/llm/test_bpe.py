import base64
import hashlib
import random

import public_tokenizers
import tiktoken

from gramweave.llm import bpe_tree
from gramweave.llm.bpe_tree import Encoder, encode_documents, op10_bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(n, seed):
    r = random.Random(seed)
    parts = ["a", "b", " ", "  ", "\n", "\t", "1", "'", "s", "'s", "'re", "é", "漢", "!", "\xa0", "　", "Z", "the", " the", "\r\n", "\x85", "\x1c", "​", "½", "🙂", "<|endoftext|>"]
    for _ in range(n):
        some = r.sample(parts, r.randint(1, 8))
        yield "".join(r.choice(some) for _ in range(r.choice([3, 10, 30, 80])))


def test_tree_equals_library_and_round_trips():
    want = library()
    for leaf, window in ((1, 1), (3, 2), (8, 5)):
        coder = Encoder(PATH, PATTERN, leaf, window)
        for t in texts(1500, leaf):
            got = coder.encode(t)
            assert got == want.encode_ordinary(t), t
            assert coder.decode(got) == t.encode()


def test_long_texts():
    coder, want = Encoder(PATH, PATTERN), library()
    r = random.Random(2)
    for t in ("a" * 50_000, " " * 50_000, " ".join(r.choice(["the", "quick", "naïve", "\n\n", "12345"]) for _ in range(30_000)), "x" * 20_000 + "  \n" * 9000 + "y"):
        assert coder.encode(t) == want.encode_ordinary(t)


def test_every_text_with_white_space_inside_is_joined(monkeypatch):
    coder, joins, join = Encoder(PATH, PATTERN), [], Encoder.join
    monkeypatch.setattr(Encoder, "join", lambda self, text, a, b: joins.append((a.end, b.end)) or join(self, text, a, b))
    for t in ("a b", "Hello world's end", "one\ntwo three four"):
        joins.clear()
        assert coder.encode(t) == library().encode_ordinary(t) and joins
    megabyte = "ab 漢字's\n " * 100_000
    assert coder.encode(megabyte) == library().encode_ordinary(megabyte)


def test_query(spark, monkeypatch):
    want = library()
    rows = [(1, "Hello world's end"), (2, None), (3, ""), (1, "Hello world's end"), (None, "漢字")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_tokens int")
    got = op10_bpe(df, PATH, PATTERN).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expect = sorted(repr((i, len(k := want.encode_ordinary(t or "")), sha(",".join(map(str, k)).encode()), sha((t or "").encode()))) for i, t in rows)
    assert sorted(repr(tuple(r)) for r in got) == expect
    whole = encode_documents(df, PATH, PATTERN).collect()
    assert [r.text for r in whole] == [t or "" for _, t in rows]
    assert op10_bpe(df.limit(0), PATH, PATTERN).count() == 0
    assert bpe_tree.settled("ab  cd", 0, 6) == 2


def test_no_rows_and_repeated_rows(spark):
    schema = "doc_id long, text string, n_tokens string"
    assert op10_bpe(spark.createDataFrame([], schema), PATH, PATTERN).count() == 0
    got = op10_bpe(spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, None, None)], schema), PATH, PATTERN).collect()
    assert len(got) == 3 and got[0] == got[1]
    assert (got[2].n_tokens, got[2].ids_sha256, got[2].decoded_sha256) == (0, *[hashlib.sha256(b"").hexdigest()] * 2)

"""Byte-level BPE as a monoid: halves are encoded apart and joined by re-encoding a window at their boundary.

The splitting pattern never looks behind the place where it starts, so from a given place on the pieces depend only on what follows.
That gives both proofs a join needs:

* left: pieces whose match and look-ahead end before the boundary stay; the window starts at the first piece that does not.
* right: once a piece of the window starts where a piece of the right half starts, all that follows is the right half's.

The window grows, doubling, until such a place is found beyond the boundary and its last piece cannot change with what comes after
it; if none is found up to the end, the window is the rest of the right half.  Decoding concatenates the parts' bytes up the tree.

Every text is halved, at the white space next to its middle, down to leaves of some characters or to runs without white space.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

#: Characters of a leaf; whatever its length, a text with white space inside has two leaves at least.
LEAF_CHARS = 1 << 11
WINDOW_CHARS = 64


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> tuple[tiktoken.Encoding, regex.Pattern, list[bytes], list[str]]:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    size = max(ranks.values()) + 1
    back = [b""] * size
    for token, rank in ranks.items():
        back[rank] = token
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), regex.compile(pattern), back, [str(i) for i in range(size)]


@dataclass
class Part:
    """An encoded stretch of the text: its place and its ids."""

    start: int
    end: int
    ids: list[int]


def settled(text: str, start: int, cut: int) -> int:
    """Start of a piece of text[start:cut] before which no piece depends on what follows ``cut``.

    A piece depends on its own run of white space or of other characters and on the character after it.  The place is where the last
    run of white space begins whose following run reaches ``cut`` (or that does so itself): no piece spans such a place, for white
    space stands only at the front of pieces.  Without one it is ``start``.
    """
    at = cut
    while at > start and not text[at - 1].isspace():
        at -= 1
    while at > start and text[at - 1].isspace():
        at -= 1
    return at


WHITE, LAST_WHITE = regex.compile(r"\s"), regex.compile(r"(?r)\s")


def near_middle(text: str, start: int, end: int) -> int:
    """The white space next to the middle of text[start:end], other than its first character; ``start`` if there is none.

    Long runs without white space are so never cut: no join has to encode them again.
    """
    middle = (start + end) // 2
    after, before = WHITE.search(text, max(middle, start + 1), end), LAST_WHITE.search(text, start + 1, middle) if middle > start + 1 else None
    places = [m.start() for m in (before, after) if m]
    return min(places, key=lambda p: abs(p - middle), default=start)


class Encoder:
    def __init__(self, path: str, pattern: str, leaf: int = LEAF_CHARS, window: int = WINDOW_CHARS):
        self.encoding, self.pattern, self.back, self.shown = codec(path, pattern)
        self.leaf, self.window = leaf, window

    def encode(self, text: str) -> list[int]:
        return self._tree(text, 0, len(text), min(self.leaf, len(text) - 1)).ids

    def _tree(self, text: str, start: int, end: int, leaf: int) -> Part:
        """Halves are cut at the white space next to the middle; a stretch of at most ``leaf`` characters, or without such a place, is a leaf."""
        cut = start if end - start <= leaf else near_middle(text, start, end)
        if cut == start:
            return Part(start, end, self.encoding.encode_ordinary(text[start:end]))
        return self.join(text, self._tree(text, start, cut, self.leaf), self._tree(text, cut, end, self.leaf))

    def _ids(self, text: str, pieces: list[tuple[int, int]]) -> list[int]:
        """Each piece is encoded by itself: a stretch cut at piece ends may split otherwise than it does in its text."""
        return [i for s, e in pieces for i in self.encoding.encode_ordinary(text[s:e])]

    def _pieces(self, text: str, start: int, end: int) -> list[tuple[int, int]]:
        return [m.span() for m in self.pattern.finditer(text, start, end)]

    def join(self, text: str, left: Part, right: Part) -> Part:
        """The two parts' encoding as one; ids outside the window are taken over as they are."""
        cut = left.end
        begin, width = settled(text, left.start, cut), self.window
        while True:
            end = min(right.end, cut + width)
            ours, theirs = self._pieces(text, begin, end), self._pieces(text, cut, end)
            sure = end if end == right.end else settled(text, begin, end)
            meet = next((s for s in sorted({s for s, _ in ours} & {s for s, _ in theirs}) if cut <= s <= sure), None)
            if meet is not None or end == right.end:
                break
            width *= 2
        meet = end if meet is None else meet
        lost = len(self._ids(text, self._pieces(text, begin, cut)))
        inner = self._ids(text, [p for p in ours if p[0] < meet])
        known = len(self._ids(text, [p for p in theirs if p[0] < meet]))
        return Part(left.start, right.end, left.ids[: len(left.ids) - lost] + inner + right.ids[known:])

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the ids, concatenated up a tree of halves."""
        if len(ids) <= self.leaf:
            back = self.back
            return b"".join([back[i] for i in ids])
        return self.decode(ids[: len(ids) // 2]) + self.decode(ids[len(ids) // 2 :])


def _encode(batches: Iterator[pa.RecordBatch], path: str, pattern: str, whole: bool) -> Iterator[pa.RecordBatch]:
    coder = Encoder(path, pattern)
    for batch in batches:
        texts, at = batch.column("text"), batch.schema.names.index("text")
        step = 256
        for lo in range(0, batch.num_rows, step):
            ids, counts, sums, back, decoded = [], [], [], [], []
            for text in texts.slice(lo, step):
                got = coder.encode(text.as_py() or "")
                raw = coder.decode(got)
                if whole:
                    ids.append(got)
                    decoded.append(raw.decode())
                else:
                    shown = coder.shown
                    counts.append(len(got))
                    sums.append(hashlib.sha256(",".join([shown[i] for i in got]).encode()).hexdigest())
                    back.append(hashlib.sha256(raw).hexdigest())
            part = batch.slice(lo, step)
            if whole:
                cols = [pa.array(decoded, pa.string()) if i == at else c for i, c in enumerate(part.columns)] + [pa.array(ids, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names, "token_ids"])
            else:
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(sums), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` with text as decoded again (a null text becomes empty) and ``token_ids``; a column of that name gives way."""
    kept = docs.drop("token_ids")
    return kept.mapInArrow(partial(_encode, path=path, pattern=pattern, whole=True), StructType([*kept.schema.fields, StructField("token_ids", ArrayType(IntegerType()))]))


def op10_bpe(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of ``docs`` (doc_id, text; other columns are ignored).

    A null text is empty: no ids, and the digests of nothing.  Every row is encoded by itself and whole, so repeated rows and null ids give rows like all
    others; ties cannot arise.  No rows give no rows.
    """
    return docs.select(F.col("doc_id"), "text").mapInArrow(partial(_encode, path=path, pattern=pattern, whole=False), StructType([docs.schema["doc_id"], StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]))

"""MinHash near-duplicates with sequential Bayesian verification.

1. Every text gives its set of word shingles: size, an order-free 128-bit digest, hashes of its MinHash bands, and a signature.  Equal
   sets collapse to one node (the least doc_id), so exact copies never reach the pair stages.
2. Band hashes are buckets, found by one sort by hash and id, whose ranges may cut a bucket: one that holds a third of all rows is
   dealt to a third of the tasks.  Every member is paired with the leaders of its buckets, and of these with the TRIES that it
   shares most buckets with: a bounded number of pairs for each node, however many copies a bucket holds.  Links found make components.
3. Pairs are compared in batches of signature positions.  After each batch a pair is dropped if the posterior probability that its
   similarity reaches the threshold, given the matches so far, is below ``MISS``.
4. Survivors are verified on the full shingle sets of the whole texts, streamed behind their leader's in blocks.
5. By then most buckets lie in one component.  In the others, the members outside the bucket's largest component are compared with all
   members of other components, so no link between texts that share a bucket is lost, in cells of two blocks of bounded size.  A first pass
   over sizes and band hashes alone finds which members have anything to compare there; theirs are the signatures and whole shingle sets
   that go to the cells.  Steps 3 and 4 run inside a cell, in the first bucket that a pair shares, and only a spanning forest of the links
   found comes out: the output grows with the members, though the CPU time of a group whose members are near the threshold and not linked
   grows with its square.

Banding misses a pair at the threshold with probability (1 - t**ROWS)**BANDS: 2e-6 with the defaults.  A digest that
many rows have is looked up by broadcast; joins of small rows on a leader or a component are left to adaptive skew joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial
from math import lgamma, log, exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from gramweave.llm.components import connected_components
from gramweave.llm.store import dropped, written
from gramweave.llm.textkernel import mix, shingle_hashes, space_table, words

BANDS, ROWS, POSITIONS, BATCH, MISS, BLOCK = 56, 7, 392, 56, 1e-6, 256
#: Digests with more than this part of all rows are joined by broadcast: there are at most so many.
HOT = 1000
#: Ids (of 8 bytes) that are broadcast at most.
LOOKED_UP = 2_000_000
#: Bytes of sets, signatures and band hashes in a block of a bucket's members.
CELL_BYTES = 8 << 20
#: Copies of a leader that come in one group.
FAN = 256
#: Leaders that a member is paired with: those it shares most buckets with.  Step 5 compares what this leaves open.
TRIES = 24


def minhash(values: np.ndarray, count: int) -> np.ndarray:
    """``count`` 32-bit minima of a set of 64-bit hashes under fixed permutations of the 32-bit words."""
    seeds = mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32)
    xor, factor = seeds[:count, None], seeds[count:, None] | np.uint32(1)
    out, low = np.full(count, 0xFFFFFFFF, np.uint32), (values >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(low), 1024):
        np.minimum(out, ((low[None, i : i + 1024] ^ xor) * factor).min(axis=1), out=out)
    return out


def _features(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """Band hashes as 8 bytes each; of the first POSITIONS minima, the signature keeps 16 bits each."""
    table, salt = space_table(), np.arange(1, BANDS + 1, dtype=np.uint64)
    for batch in batches:
        ids, sizes, high, low, bands, signatures = batch.column(0), [], [], [], [], []
        for part in words(batch.column(1), table):
            hashes = part.hashes()
            for d in range(part.docs):
                found = np.unique(shingle_hashes(hashes[part.first[d] : part.first[d + 1]], shingle))
                sizes.append(len(found))
                low.append(int(found.sum(dtype=np.uint64).astype(np.int64)))
                high.append(int(mix(found ^ np.uint64(0xD1B54A32D192ED03)).sum(dtype=np.uint64).astype(np.int64)))
                if not len(found):
                    bands.append(None), signatures.append(None)
                    continue
                minima = minhash(found, BANDS * ROWS)
                total = salt.copy()
                for column in minima.reshape(BANDS, ROWS).T:
                    total = mix(total + column)
                bands.append(total.astype(np.int64))
                signatures.append(minima[:POSITIONS].astype(np.uint16).tobytes())
        yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(signatures, pa.binary())], ["doc_id", "n_shingles", "high", "low", "bands", "signature"])


def features(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n_shingles, digest (high, low), bands and signature of each row of (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(partial(_features, shingle=shingle), "doc_id long, n_shingles long, high long, low long, bands array<long>, signature binary")


@cache
def least_matches(seen: int, percent: int, miss: float) -> int:
    """Fewest matches among ``seen`` positions with which similarity >= percent/100 keeps a posterior of at least ``miss``.

    The prior of the similarity is uniform, so the posterior is Beta(m + 1, seen - m + 1); its tail at integer parameters is a
    binomial sum: P(S >= t) = P(Binomial(seen + 1, t) <= m).
    """
    n, t, total = seen + 1, percent / 100, 0.0
    for m in range(seen + 1):
        total += exp(lgamma(n + 1) - lgamma(m + 1) - lgamma(n - m + 1) + m * log(t) + (n - m) * (log(1 - t) if t < 1 else -1e9))
        if total >= miss:
            return m
    return seen


def screen(left: np.ndarray, right: np.ndarray, percent: int, miss: float = MISS, step: int = BATCH) -> np.ndarray:
    """Places of the rows of two signature matrices that no batch of positions rules out; a single left row meets all right ones."""
    alive, matches = np.arange(len(right)), np.zeros(len(right), np.int64)
    for at in range(0, right.shape[1], step):
        own = left[:, at : at + step] if len(left) == 1 and len(right) != 1 else left[alive, at : at + step]
        matches = matches + (own == right[alive, at : at + step]).sum(axis=1)
        keep = matches >= least_matches(min(at + step, right.shape[1]), percent, miss)
        alive, matches = alive[keep], matches[keep]
    return alive


def _buckets(batches: Iterator[pa.RecordBatch], ranges: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows (key, id, n) come sorted; those of keys with two members or more go on with the key's first id, the leader.

    With ``ranges`` the rows are one range of a longer sequence, whose first and last key may go on outside: the first and the last row
    stay even if they are their key's only ones here, and the first is marked as a ``cut``.
    """
    names, begun = ["key", "id", "n", "leader"] + ["cut"] * ranges, False
    last: np.ndarray | None = None  # the row before: key, id, n, its key's first id, and whether it is still to be emitted
    for batch in batches:
        rows = np.stack([c.to_numpy() for c in batch.columns])
        if not rows.shape[1]:
            continue
        key = rows[0]
        begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        first = np.repeat(rows[1][begin], np.diff(np.r_[begin, len(key)]))
        keep = np.zeros(len(key), bool)
        keep[1:] = key[1:] == key[:-1]
        keep[:-1] |= keep[1:]
        more: list[np.ndarray] = []
        if last is not None and last[0] == key[0]:
            first[: begin[1] if len(begin) > 1 else len(key)] = last[3]
            keep[0] = True
            if last[4]:
                more.append(last[:4, None])
        cut, begun = ranges and not begun, True
        keep[0] |= cut
        more.append(np.stack([key, rows[1], rows[2], first])[:, keep])
        last = np.array([key[-1], rows[1][-1], rows[2][-1], first[-1], not keep[-1]])
        key, ids, n, lead = np.concatenate(more, axis=1)
        mark = [pa.array(np.arange(len(key)) == 0 if cut else np.zeros(len(key), bool))] * ranges
        yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (key, ids, n, lead)), *mark], names)
    if ranges and last is not None and last[4]:
        yield pa.RecordBatch.from_arrays([*(pa.array(last[k : k + 1]) for k in range(4)), pa.array([False])], names)


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """The sorted shingle hashes of each text as bytes, and the lower halves of its band hashes; other columns stay."""
    table = space_table()
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            piece, out = batch.slice(lo, 512), []
            for part in words(piece.column("text"), table):
                hashes = part.hashes()
                out += [np.unique(shingle_hashes(hashes[part.first[d] : part.first[d + 1]], shingle)).tobytes() for d in range(part.docs)]
            half = [np.array(x, np.int64).astype(np.uint32).tobytes() for x in piece.column("bands").to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("signature"), pa.array(half, pa.binary()), pa.array(out, pa.binary())], ["id", "signature", "packed", "set"])


def first_shared(mine: np.ndarray, others: np.ndarray, key: int) -> np.ndarray:
    """Whether the bucket ``key`` is the first that a member shares with each of others, by the lower halves of their band hashes.

    Two different hashes of a band agree in 32 bits with a probability of 2e-10, far below MISS.
    """
    return mine[(others == mine).argmax(axis=1)] == np.uint32(key & 0xFFFFFFFF)


def near(sizes: np.ndarray, n: int, percent: int) -> np.ndarray:
    """Sets of which one has less than ``percent`` of the other's size can't reach that similarity."""
    return 100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n)


def _live(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows as for ``_cells``, with the set's size in place of signature and set; those that have a member to be compared with go on."""
    at, ids, parts, sizes, bands, on = None, [], [], [], [], []
    left: tuple[np.ndarray, ...] | None = None
    out: list[tuple] = []

    def meet(part: int, n: int, packed: bytes, among: int) -> bool:
        nonlocal left
        if left is None:
            left = np.array(parts), np.array(sizes), np.frombuffer(b"".join(bands), np.uint32).reshape(len(ids), -1)
        some = np.flatnonzero((left[0][:among] != part) & near(left[1][:among], n, percent))
        if len(some):
            some = some[first_shared(np.frombuffer(packed, np.uint32), left[2][some], at[0])]
        for i in some:
            on[i] = True
        return len(some) > 0

    def ended() -> None:
        if ids and at[1] == at[2]:
            for t in range(len(ids)):
                on[t] |= meet(parts[t], sizes[t], bands[t], t)
        out.extend((*at, 0, ids[t], parts[t]) for t in range(len(ids)) if on[t])

    def rows() -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [()] * 6
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["key", "i", "j", "role", "id", "part"])
        out.clear()
        return batch

    for batch in batches:
        for key, i, j, role, member, part, n, packed in zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "role", "id", "part", "n", "packed")), strict=True):
            if (key, i, j) != at:
                ended()
                at, ids, parts, sizes, bands, on, left = (key, i, j), [], [], [], [], [], None
            if role == 0:
                for kept, v in zip((ids, parts, sizes, bands, on), (member, part, n, packed, False), strict=True):
                    kept.append(v)
            elif ids and meet(part, n, packed, len(ids)):
                out.append((key, i, j, 1, member, part))
        yield rows()
    ended()
    yield rows()


class Cell:
    """The left members of a cell of one bucket, and the components that links found here have joined."""

    def __init__(self, key: int, ids: list[int], parts: list[int], signatures: list[bytes], bands: list[bytes], sets: list[bytes]):
        self.key, self.ids, self.parts = key, np.array(ids, np.int64), np.array(parts, np.int64)
        self.signatures = np.frombuffer(b"".join(signatures), np.uint16).reshape(len(ids), -1)
        self.bands = np.frombuffer(b"".join(bands), np.uint32).reshape(len(ids), -1)
        self.sizes = np.array([len(s) // 8 for s in sets], np.int64)
        self.ends = np.r_[0, np.cumsum(self.sizes)]
        self.vocabulary, self.places = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_inverse=True)
        self.marks = np.zeros(len(self.vocabulary), bool)
        self.joined: dict[int, int] = {}

    def component(self, part: int) -> int:
        while part in self.joined:
            part = self.joined[part]
        return part

    def links(self, member: int, part: int, signature: bytes, bands: bytes, shingles: bytes, among: int, percent: int) -> list[int]:
        """Ids of left members, of the first ``among``, that ``member`` is linked with: one of each other component that it reaches.

        A pair that shares several buckets is compared in the first of them alone.
        """
        own, n = self.component(part), len(shingles) // 8
        some = np.flatnonzero((self.parts[:among] != own) & near(self.sizes[:among], n, percent))
        if len(some):
            some = some[first_shared(np.frombuffer(bands, np.uint32), self.bands[some], self.key)]
        if len(some):
            some = some[screen(np.frombuffer(signature, np.uint16)[None, :], self.signatures[some], percent)]
        if not len(some):
            return []
        found = np.frombuffer(shingles, np.uint64)
        at = np.searchsorted(self.vocabulary, found)
        at = at[np.take(self.vocabulary, at, mode="clip") == found]
        self.marks[at] = True
        both = np.array([np.count_nonzero(self.marks[self.places[self.ends[i] : self.ends[i + 1]]]) for i in some])
        self.marks[at] = False
        out = []
        for i in some[100 * both >= percent * (self.sizes[some] + n - both)]:
            other, own = self.parts[i], self.component(own)
            if other != own:
                out.append(int(self.ids[i]))
                self.joined[int(other)] = own
                self.parts[self.parts == other] = own
        return out


def _cells(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows are members sorted by (key, i, j, role): role 0 makes the cell's left side, which role 1 meets; in a cell i = j all meet all."""
    at, left, cell = None, [], None

    def met() -> tuple[list[int], list[int]]:
        """A cell i = j, once all its members are there."""
        a, b = [], []
        if left and at[1] == at[2]:
            own = Cell(at[0], *zip(*left, strict=True))
            for t, (member, *more) in enumerate(left):
                found = own.links(member, *more, t, percent)
                a += found
                b += [member] * len(found)
        return a, b

    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            a, b = [], []
            piece = batch.slice(lo, 256)
            for key, i, j, role, *row in zip(*(piece.column(c).to_pylist() for c in ("key", "i", "j", "role", "id", "part", "signature", "packed", "set")), strict=True):
                if (key, i, j) != at:
                    for into, more in zip((a, b), met(), strict=True):
                        into += more
                    at, left, cell = (key, i, j), [], None
                if role == 0:
                    left.append(row)
                elif left:
                    cell = cell or Cell(key, *zip(*left, strict=True))
                    found = cell.links(*row, len(left), percent)
                    a += found
                    b += [row[0]] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], ["a", "b"])
    a, b = met()
    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], ["a", "b"])


def _star(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (a, block, role): a block's first row is the leader's, the others are screened and then compared with it."""
    at, signature, leader = None, np.zeros(0, np.uint16), np.zeros(0, np.uint64)
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            piece, kept = batch.slice(lo, 1024), []
            for i, (a, block, role, own, shingles) in enumerate(zip(*(piece.column(c).to_pylist() for c in ("a", "block", "role", "signature", "set")), strict=True)):
                signs, found = np.frombuffer(own, np.uint16), np.frombuffer(shingles, np.uint64)
                if role == 0:
                    at, signature, leader = (a, block), signs, found
                    continue
                if at != (a, block):
                    raise ValueError(f"no set of document {a} before its block's members")
                if near(np.array([len(leader)]), len(found), percent)[0] and len(screen(signature[None, :], signs[None, :], percent)):
                    both = len(np.intersect1d(leader, found, assume_unique=True))
                    if 100 * both >= percent * (len(leader) + len(found) - both):
                        kept.append(i)
            yield pa.RecordBatch.from_arrays([piece.column(c).take(pa.array(kept, pa.int64())) for c in ("a", "id")], ["a", "b"])


def _leaders(blocks: DataFrame, members: DataFrame) -> DataFrame:
    """(a, block, signature, set): a leader's set once for each block of its members.

    The copies of one with more than FAN blocks come out in two steps: one for each FAN of them, which are dealt anew and copied on where they lie, so a
    leader of a hundred million members is copied 1,600 times in one task and 256 times in each of so many others.
    """
    many = F.col("blocks") > FAN
    own = members.select(F.col("id").alias("a"), "signature", "set")
    out = blocks.where(~many).select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).join(own, "a").select("a", "block", "signature", "set")
    if blocks.where(many).isEmpty():
        return out
    groups = blocks.where(many).withColumn("group", F.explode(F.sequence(F.lit(0), F.floor((F.col("blocks") - 1) / FAN).cast("int"))))
    groups = groups.join(own, "a").repartition("a", "group")
    ends = F.sequence(F.col("group") * FAN, F.least((F.col("group") + 1) * FAN, "blocks") - 1)
    return out.unionByName(groups.withColumn("block", F.explode(ends)).select("a", "block", "signature", "set"))


def _links(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs (leader a, member b) whose sets reach the threshold; the leader's set is sent once for each block of its members."""
    blocks = written(pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "leader-blocks")
    rows = pairs.join(blocks, "a").select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("role"), F.col("b").alias("id"))
    sent = rows.join(members.select("id", "signature", "set"), "id").select("a", "block", "role", "id", "signature", "set")
    sent = sent.unionByName(_leaders(blocks, members).select("a", "block", F.lit(0).alias("role"), F.col("a").alias("id"), "signature", "set"))
    dealt = sent.repartition("a", "block").sortWithinPartitions("a", "block", "role", "id")
    return written(dealt.mapInArrow(partial(_star, percent=percent), "a long, b long"), "links")


def _rest(placed: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links between members of a bucket outside its largest component and members of other components: a spanning forest a cell.

    A bucket of more than CELL_BYTES is cut into blocks, those outside the largest component first; a cell is one of these with itself
    or with any later block.  Members stream through a cell's task one by one, so it holds one block.
    """
    bytes_ = F.col("n") * 8 + 2 * POSITIONS + 4 * BANDS
    largest = placed.groupBy("key", "part").agg(F.count("*").alias("members"), F.sum(bytes_).alias("size")).groupBy("key").agg(F.max_by(F.struct("part", "size"), F.struct("members", "part")).alias("main"), F.sum("size").alias("size"))
    # A bucket of one block is the cell (0, 0); else blocks 0 to others - 1 hold what is outside the main component.
    cut = lambda size: F.greatest(F.lit(1), F.ceil(size / CELL_BYTES)).cast("int")
    plan = largest.select("key", F.col("main.part").alias("main"), (F.col("size") <= CELL_BYTES).alias("whole"), cut(F.col("size") - F.col("main.size")).alias("others"), cut(F.col("main.size")).alias("blocks"))
    dealt_to = lambda n: F.pmod(F.xxhash64("id", F.lit("block")), F.col(n))
    block = F.when(F.col("whole"), 0).when(F.col("part") != F.col("main"), dealt_to("others")).otherwise(F.col("others") + dealt_to("blocks")).cast("int")
    total = F.when(F.col("whole"), 1).otherwise(F.col("others") + F.col("blocks"))
    cells = F.filter(F.transform(F.sequence(F.lit(0), total - 1), lambda k: F.struct(F.least(k, "block").alias("i"), F.greatest(k, "block").alias("j"))), lambda c: F.col("whole") | (c["i"] < F.col("others")))
    rows = placed.join(plan, "key").withColumn("block", block).select("key", "id", "n", "part", "block", F.inline(cells)).withColumn("role", (F.col("block") != F.col("i")).cast("int"))
    order = ("key", "i", "j", "role")
    first = rows.join(members.select("id", "packed"), "id").select(*order, "id", "part", "n", "packed").repartition("key", "i", "j").sortWithinPartitions(*order, "id")
    live = written(first.mapInArrow(partial(_live, percent=percent), "key long, i int, j int, role int, id long, part long"), "live")
    dealt = live.join(members, "id").select(*order, "id", "part", "signature", "packed", "set").repartition("key", "i", "j").sortWithinPartitions(*order, "id")
    rest = written(dealt.mapInArrow(partial(_cells, percent=percent), "a long, b long").distinct(), "rest")
    dropped(live)
    return rest


def _led(buckets: DataFrame) -> DataFrame:
    """Pairs (leader a, member b) once for each bucket.  A bucket that the sort cut into ranges has a leader in each; these are paired
    with the first of them.  There are at most as many such buckets as partitions, so their keys are broadcast."""
    cut = buckets.where("cut").select("key").distinct()
    heads = buckets.where("id = leader").join(F.broadcast(cut), "key", "left_semi").select("key", "id")
    first = heads.groupBy("key").agg(F.min("id").alias("a"))
    across = heads.join(F.broadcast(first), "key").where("id != a").select("a", F.col("id").alias("b"))
    return buckets.where("id != leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).unionByName(across)


def _closest(pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b), once for each shared bucket, every b's TRIES most frequent ones."""
    w = W.partitionBy("b").orderBy(F.col("shared").desc(), "a")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared")).withColumn("place", F.row_number().over(w)).where(F.col("place") <= TRIES).select("a", "b")


def _placed(buckets: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows (key, id, n, part) of the buckets whose members lie in several components."""
    rows = buckets.join(parts.toDF("id", "in"), "id", "left").select("key", "id", "n", F.coalesce("in", "id").alias("part"))
    mixed = rows.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo != hi").select("key")
    return written(rows.join(mixed, "key"), "placed")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text; other columns are ignored).

    Two texts are linked if 100 * |intersection| >= percent * |union| of their sets of distinct ``shingle``-word shingles (A-Z in
    lower case; a text of fewer words is one shingle).  doc_id is a whole number; ``drop_near_duplicates`` takes any.  component_id is the least doc_id that links reach, kept says it is the
    row's own.  Null, empty and blank texts have no shingles and are linked with nothing.  doc_id names a document: rows that
    repeat it are one document and share its component.  A null doc_id joins the component of an equal set with an id, else its
    component_id is null and it is kept.  No rows give no rows.
    """
    wide = written(features(docs, shingle), "features")
    feats = written(wide.select("doc_id", "n_shingles", "high", "low"), "digests")
    sets = feats.where("n_shingles > 0")
    reps = sets.groupBy("high", "low").agg(F.min("doc_id").alias("id")).where("id is not null")
    same = (F.col("s.doc_id") == F.col("r.id")) & (F.col("s.high") == F.col("r.high")) & (F.col("s.low") == F.col("r.low"))
    nodes = wide.alias("s").join(reps.alias("r"), same).select("s.high", "s.low", "id", F.col("n_shingles").alias("n"), "bands", "signature")
    nodes = written(nodes.dropDuplicates(["high", "low"]) if repeated_ids(feats) else nodes, "nodes")
    dropped(wide)
    rows = nodes.select(F.explode("bands").alias("key"), "id", "n").repartitionByRange("key", "id").sortWithinPartitions("key", "id")
    buckets = written(rows.mapInArrow(partial(_buckets, ranges=True), "key long, id long, n long, leader long, cut boolean"), "buckets")
    members = _members(docs, nodes, written(buckets.select("id").distinct(), "ids"), shingle)
    ids = nodes.select("high", "low", "id")
    ids = written(ids, "names")
    dropped(nodes)
    pairs = written(_closest(_led(buckets)), "pairs")
    links = _links(pairs, members, percent)
    parts = connected_components(links)
    placed = _placed(buckets, parts)
    rest = _rest(placed, members, percent)
    dropped(members, placed, buckets)
    final = parts if rest.isEmpty() else connected_components(links.unionByName(rest))
    member = ids.join(final, "id", "left").select("high", "low", F.coalesce("component", "id").alias("component"))
    own = F.col("doc_id").alias("component_id")
    out = _by_digest(sets.select("doc_id", "n_shingles", "high", "low"), member).select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    out = out.unionByName(feats.where("n_shingles = 0").select("doc_id", "n_shingles", own))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _by_digest(rows: DataFrame, member: DataFrame) -> DataFrame:
    """``rows`` with the component of their digest.  Digests that hold more than a HOT-th of all rows, at most HOT, are joined by
    broadcast, so that no task gets all copies of one text."""
    digest = ["high", "low"]
    most = rows.groupBy(digest).agg(F.count("*").alias("copies")).where(F.col("copies") > max(1000, rows.count() // HOT)).select(digest)
    hot = written(most.join(member, digest, "left"), "hot")
    rest = rows.join(F.broadcast(hot.select(digest)), digest, "left_anti").join(member, digest, "left")
    return rows.join(F.broadcast(hot), digest).unionByName(rest)


def _members(docs: DataFrame, nodes: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """id, signature, the lower halves of the band hashes and the shingle set of every node that shares a bucket.

    Up to LOOKED_UP ids are broadcast, so that the texts need no shuffle; more are joined by sorting."""
    few = F.broadcast(ids) if ids.count() <= LOOKED_UP else ids
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(few, "id", "left_semi")
    signed = nodes.select("id", "signature", "bands").join(few, "id", "left_semi")
    rows = signed.join(texts.dropDuplicates(["id"]), "id").select("id", "signature", "bands", "text")
    return written(rows.mapInArrow(partial(_sets, shingle=shingle), "id long, signature binary, packed binary, set binary"), "members")


def repeated_ids(feats: DataFrame) -> bool:
    """Whether a doc_id stands in several rows; only then the nodes need a pass that drops repeated ones."""
    return not feats.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows that are not the first of their component; rows with a null doc_id stay.

    Where a doc_id is repeated, null or no whole number, rows are linked by a number of their own, dealt once in the order of doc_id: rows that repeat a
    doc_id are compared by their own texts, and of equal ones a single row stays.
    """
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    if isinstance(docs.schema["doc_id"].dataType, IntegralType) and ids.where("n > 1 or doc_id is null").isEmpty():
        gone = near_duplicates(docs, shingle, percent).where("not kept").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti")
    row = "_row"
    while row in docs.columns:
        row += "_"
    rows = written(docs.orderBy(F.col("doc_id").asc_nulls_last()).withColumn(row, F.monotonically_increasing_id()), "rows")
    gone = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), shingle, percent).where("not kept").select(F.col("doc_id").alias(row))
    unnamed = rows.where("doc_id is null")
    named = rows.where("doc_id is not null").join(gone, row, "left_anti").select(*rows.columns)
    return named.unionByName(unnamed).drop(row)


#: All pairs that share a shingle, counted, and their closure.
SQL = r"""
with recursive t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
sh as (select distinct doc_id, case when len(ws) = 1 then ws[1] else ws[i] || ' ' || ws[i + 1] end as s from (select doc_id, ws, unnest(range(1, greatest(2, len(ws)))) as i from t where len(ws) > 0)),
n as (select doc_id, count(*) as n from sh group by doc_id),
shared as (select a.doc_id as x, b.doc_id as y, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by all),
e as (select x, y from shared join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 80 * (a.n + b.n - c)),
l as (select x, y from e union select y, x from e),
r(doc_id, far) as (select x, y from l union select r.doc_id, l.y from r join l on l.x = r.far),
m as (select doc_id, min(far) as low from r group by doc_id)
select t.doc_id, coalesce(n, 0) as n_shingles, least(t.doc_id, coalesce(low, t.doc_id)) as component_id, t.doc_id = least(t.doc_id, coalesce(low, t.doc_id)) as kept
from t left join n using (doc_id) left join m using (doc_id)
"""

"""Hierarchical weighted hash tree: a row descends region, rack and shard by weighted hash draws.

At each level every child draws u in (0, 1) from a hash of the row's key and the child's path, and the child with the least
-ln(u) / weight wins; it wins with a probability in proportion to its weight (the weight of its whole subtree).  A draw depends on
nothing but the key and the path, so a change of weights moves rows only into or out of the subtrees whose weights change.
Growing the tree by a region of its own therefore moves rows into that region alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gramweave.llm.store import written

#: Rows that one task sorts and numbers, about.
RANGE_ROWS = 50_000


@dataclass(frozen=True)
class Node:
    """A leaf has a shard number and a weight of its own; an inner node has children and weighs their sum."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int = -1
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def tree(shards: int = 16, regions: int = 2, racks: int = 2, grown: int = 0) -> Node:
    """``shards`` equal shards dealt to ``regions`` x ``racks``; each of ``grown`` further shards comes in a region of its own."""
    groups = regions * racks
    dealt = [[Node(f"s{s}", shard=s) for s in range(shards) if s * groups // shards == g] for g in range(groups)]
    top = tuple(Node(f"r{r}", tuple(Node(f"k{k}", tuple(dealt[r * racks + k])) for k in range(racks) if dealt[r * racks + k])) for r in range(regions))
    more = tuple(Node(f"r{regions + i}", (Node("k0", (Node(f"s{shards + i}", shard=shards + i),)),)) for i in range(grown))
    return Node("root", tuple(n for n in top if n.children) + more)


def _draw(key: Column, path: str, weight: float) -> Column:
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{path}"))), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(1 << 52))) / F.lit(weight)


def place(key: Column, node: Node, path: str = "") -> Column:
    """Shard number of a string key; a null key draws as the empty string."""
    if not node.children:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return place(key, node.children[0], f"{path}/{node.children[0].name}")
    draws = [(_draw(key, f"{path}/{c.name}", c.weight), place(key, c, f"{path}/{c.name}")) for c in node.children]
    chosen = F.array(*(F.struct(d.alias("d"), F.lit(i).alias("i")) for i, (d, _) in enumerate(draws)))
    win = F.array_min(chosen)["i"]
    return reduce(lambda rest, i: F.when(win == i, draws[i][1]).otherwise(rest), range(len(draws) - 1), draws[-1][1])


def levels(keyed: DataFrame, node: Node, out: str, scratch: str = "_node") -> DataFrame:
    """``keyed`` (with ``_key``) and column ``out``: as ``place``, but each level's winner is a column, so a row draws only for the
    children of the nodes it passes."""
    front: list[tuple[Node, str]] = [(node, "")]
    df = keyed.withColumn(scratch, F.lit(0))
    while any(n.children for n, _ in front):
        below: list[tuple[Node, str]] = []
        step = None
        for i, (n, path) in enumerate(front):
            at = len(below)
            kids = [(c, f"{path}/{c.name}") for c in n.children] or [(n, path)]
            below += kids
            if len(kids) == 1:
                to = F.lit(at)
            else:
                to = F.array_min(F.array(*(F.struct(_draw(F.col("_key"), p, c.weight).alias("d"), F.lit(at + j).alias("i")) for j, (c, p) in enumerate(kids))))["i"]
            step = F.when(F.col(scratch) == i, to) if step is None else step.when(F.col(scratch) == i, to)
        df, front = df.withColumn(scratch, step), below
    leaf = F.element_at(F.array(*(F.lit(n.shard) for n, _ in front)), F.col(scratch) + 1)
    return df.withColumn(out, leaf).drop(scratch)


def numbered(df: DataFrame, group: str, order: list[str], out: str) -> DataFrame:
    """``out``: gapless numbers from 0 within each ``group`` by ``order``, whatever the group's size; ties go in any order.

    Rows are sorted by ranges of group, order and a row id, so even rows alike in all of them are spread over ranges; a range's rows
    follow those of the same group in the ranges before it, which are counted first.
    """
    rows = written(df.withColumn("_id", F.monotonically_increasing_id()), "rows")
    n = max(1, -(-rows.count() // RANGE_ROWS))
    keys = [group, *order, "_id"]
    ranged = written(rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("_at", 33)
    before = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = ranged.groupBy(group, part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return ranged.withColumn("_part", part).join(starts, [group, "_part"]).withColumn(out, (F.col("_start") + F.col("_at") - F.col("_first")).cast("long")).drop("_id", "_at", "_part", "_n", "_first", "_start")


def _sql_place(node: Node, path: str = "") -> str:
    """``place`` as a DuckDB expression over key."""
    if not node.children:
        return str(node.shard)
    if len(node.children) == 1:
        return _sql_place(node.children[0], f"{path}/{node.children[0].name}")
    draws = [f"-ln((cast('0x' || substr(md5(key || '|{path}/{c.name}'), 1, 13) as bigint) + 0.5) / {float(1 << 52)}) / {float(c.weight)}" for c in node.children]
    cases = " ".join(f"when {i + 1} then {_sql_place(c, f'{path}/{c.name}')}" for i, c in enumerate(node.children))
    draws_list = ", ".join(draws)
    return f"(case list_position([{draws_list}], least({draws_list})) {cases} end)"


def sql(shards: int = 16) -> str:
    """DuckDB SQL of the query; it has no CRC, so that is folded over the bytes with a table made by its rule."""
    return f"""
with t as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as crc),
k as (select doc_id, coalesce(cast(doc_id as varchar), '') as key, encode(coalesce(text, '')) as b from documents),
s as (select doc_id, octet_length(b) + 1 as size, {_sql_place(tree(shards))} as shard, {_sql_place(tree(shards, grown=1))} as grown_shard, hex(b) as h from k),
c as (select doc_id, size, shard, grown_shard, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(size - 1), lambda i: cast('0x' || substr(h, 2 * i + 1, 2) as bigint))),
  lambda c, x: xor(c >> 8, t.crc[(xor(c, x) & 255) + 1]))) as text_crc32 from s, t)
select doc_id, size, text_crc32, 'key' as law, shard, row_number() over (partition by shard order by doc_id nulls first, text_crc32, size) - 1 as slot, grown_shard from c
"""


SQL = sql()


def op5_sharding(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law ('key'), shard, slot and grown_shard of every row of ``docs`` (doc_id, text).

    The law is ``key``: doc_id and the shard count decide alone, so copies of a text may part and rows that repeat a doc_id stay
    together.  size is the text's UTF-8 bytes (null: none) plus 1; a null doc_id is placed as the empty key.  slot numbers a
    shard's rows gaplessly from 0, by doc_id (null first), text_crc32 and size.  grown_shard is the shard if there is one more:
    the row's shard as before, or the new one.  Other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_key"))
    placed = levels(levels(rows, tree(shards), "shard"), tree(shards, grown=1), "grown_shard").drop("_key")
    out = numbered(placed, "shard", ["doc_id", "text_crc32", "size"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")

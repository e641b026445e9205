"""Grouping of spelling variants by merging in an errata trie.

1. Words are counted: the only step over the corpus, one aggregation with partial sums.
2. A row for each prefix of each distinct word names its trie node (a hash of the prefix) and the character that follows; counted, they give
   every branching node its heavy child, the one with the most words below.
3. A light subtree is merged into the rest of its node: each of its words is sent on with the character at the node replaced by the heavy
   one, with it skipped, and with the heavy one put before it (the heavy child's character skipped).  A word that ends at the node
   is a light subtree of its own.  As light subtrees are the smaller ones, a word moves at most log2(words) times, whatever its length.
4. Words whose changed forms end in the same terminal are one edit apart.  Two near words part at one node, where one of them is light,
   so each pair is found there and nowhere else: a replaced character among the subtrees merged at the node and its heavy child, a
   skipped one between a moved word and the word it then equals.

A terminal takes the words one edit away from one string, so no group grows with the corpus beyond length x alphabet.  Which child counts as
heavy matters for the work alone: equal hashes of two prefixes (64 bits) would make the two nodes share a heavy character, and every pair
would still be found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramweave.llm.store import written
from gramweave.llm.textkernel import mix

LETTERS = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_CHARS, LEAST_COUNT, RATIO, DELETE = 7, 2, 10, 31

#: Characters whose prefix rows a task makes at once (one word at least).
CHUNK_CHARS = 1 << 18
#: Nodes of more words are hot: their heavy children are looked up by broadcast.  The bound rises with the rows, so that at most HOT_NODES are.
HOT_WORDS, HOT_NODES = 10_000, 100_000


def runs(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """(word) for every maximal run of letters in ``docs`` (doc_id, text): A-Z lower-cased, one code point deleted where the crc32 of
    doc_id and run says so; of ``least`` code points or more.  A null text has none; a null doc_id counts as the empty string."""
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    found = docs.select(doc.alias("doc"), F.explode(F.regexp_extract_all("text", F.lit(f"({LETTERS}{{{least},}})"), F.lit(1))).alias("run"))
    low = found.select("doc", F.translate("run", UPPER, LOWER).alias("run"))
    hashed = low.select("run", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    return hashed.select(F.when(F.col("h") % DELETE == 0, less).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least)


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each prefix of each word, itself and the empty one included: a hash of the prefix, and the character after it (-1: none)."""

    def rows(ids: list[int], words: list[str]) -> pa.RecordBatch:
        lengths = np.array([len(w) for w in words])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        starts = np.cumsum(lengths) - lengths
        place = np.arange(len(codes)) - np.repeat(starts, lengths)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(codes.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(32)) + np.uint64(1)), dtype=np.uint64)))
        at = np.arange(len(codes) + len(words)) - np.repeat(np.cumsum(lengths + 1) - lengths - 1, lengths + 1)
        begin = np.repeat(starts, lengths + 1)
        after = np.append(codes, np.uint32(0)).astype(np.int32)[np.minimum(begin + at, len(codes))]
        after[at == np.repeat(lengths, lengths + 1)] = -1
        node = (sums[begin + at] - sums[begin]).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, np.int64), lengths + 1)), pa.array(at.astype(np.int32)), pa.array(node), pa.array(after)], ["id", "at", "node", "after"])

    for batch in batches:
        ids: list[int] = []
        words: list[str] = []
        size = 0
        for i, word in zip(batch["id"], batch["word"], strict=True):
            ids.append(i.as_py())
            words.append(word.as_py())
            size += len(words[-1])
            if size >= CHUNK_CHARS:
                yield rows(ids, words)
                ids, words, size = [], [], 0
        if ids:
            yield rows(ids, words)


def light_paths(words: DataFrame) -> DataFrame:
    """(id, at, heavy): the nodes at which a word of ``words`` (id, word) lies in a light subtree, by the length of their prefix, and the
    character of the node's heavy child."""
    prefixes = written(words.select("id", "word").mapInArrow(_prefixes, "id long, at int, node long, after int"), "spell-prefixes")
    children = prefixes.groupBy("node", "after").agg(F.count("*").alias("n"))
    # The end of a word is never the heavy child.
    nodes = children.groupBy("node").agg(F.max(F.struct(F.col("after") >= 0, "n", "after"))["after"].alias("heavy"), F.sum("n").alias("below"), F.count("*").alias("kids"))
    nodes = written(nodes.where("kids > 1").select("node", "heavy", "below"), "spell-nodes")
    bound = max(HOT_WORDS, prefixes.count() // HOT_NODES)
    hot = F.broadcast(nodes.where(F.col("below") > bound).select("node", "heavy"))
    upper = prefixes.join(hot, "node").select("id", "at", "after", "heavy")
    lower = prefixes.join(hot.select("node"), "node", "left_anti").join(nodes.where(F.col("below") <= bound), "node").select("id", "at", "after", "heavy")
    return upper.unionByName(lower).where("after <> heavy").select("id", "at", F.decode(F.unhex(F.lpad(F.hex("heavy"), 8, "0")), "UTF-32").alias("heavy"))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best) for every word of ``words`` (id, word, n) that has a near word; best is a struct (less, word) of the near word of largest n,
    the smallest in code-point order of equal ones, with less = -n.  Words are distinct and not null."""
    light = light_paths(words).join(words, "id")
    one, head, tail = F.substr("word", F.col("at") + 1, F.lit(1)), F.substr("word", F.lit(1), F.col("at")), F.substr("word", F.col("at") + 2)
    split = light.select("word", (-F.col("n")).alias("less"), "at", "heavy", one.alias("one"), head.alias("head"), tail.alias("tail"))
    # Terminals of merged subtrees: at = the node for a replaced character, -1 for a skipped one, whose terminal is a word.
    replaced = F.struct(F.col("at"), F.concat("head", "heavy", "tail").alias("end"))
    shorter = F.struct(F.lit(-1).alias("at"), F.concat("head", "tail").alias("end"))
    longer = F.struct(F.lit(-1).alias("at"), F.concat("head", "heavy", "one", "tail").alias("end"))
    # A character equal to the one after it is skipped at its last place, further down.
    moves = F.when(F.col("one") == "", F.array(longer)).when(F.startswith("tail", "one"), F.array(replaced, longer)).otherwise(F.array(replaced, shorter, longer))
    moved = split.select(F.struct("less", "word").alias("moved"), F.explode(moves).alias("to")).select("moved", "to.at", "to.end")
    met = moved.groupBy("end", "at").agg(F.collect_list("moved").alias("moved")).join(words.select(F.col("word").alias("end"), F.struct((-F.col("n")).alias("less"), "word").alias("there")), "end", "left")
    met = met.where("there is not null or (at >= 0 and size(moved) > 1)")
    member = lambda w, k, best: F.struct(w["word"].alias("word"), k.cast("long").alias("n_near"), best.alias("best"))
    among = met.where("at >= 0").select(F.array_sort(F.array_compact(F.concat("moved", F.array("there")))).alias("all"))
    among = among.select(F.explode(F.transform("all", lambda w: member(w, F.size("all") - 1, F.when(w == F.get("all", F.lit(0)), F.get("all", F.lit(1))).otherwise(F.get("all", F.lit(0)))))).alias("m"))
    across = met.where("at < 0").select(F.explode(F.concat(F.transform("moved", lambda w: member(w, F.lit(1), F.col("there"))), F.array(member(F.col("there"), F.size("moved"), F.array_min("moved"))))).alias("m"))
    return among.unionByName(across).select("m.*").groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) for every word of ``links`` (word, form): the last word that following forms leads to.

    Each round takes the root's root, so chains halve; a form's count is a multiple of its word's, so there are no circles."""
    now = written(links.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "spell-roots")
    while not now.where("moved").isEmpty():
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = written(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spell-roots")
    return now.select("word", "root")


def variants(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of ``counts`` (word, n): forms are near words of ``ratio`` times the word's n or more."""
    words = written(counts.select("word", F.col("n").cast("long").alias("n")).withColumn("id", F.monotonically_increasing_id()), "spell-words")
    near = near_words(words)
    common = -F.col("best.less") >= ratio * F.col("n")
    linked = words.join(near, "word", "left").select("word", F.when(common, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(common, -F.col("best.less")).alias("form_n"))
    linked = written(linked, "spell-links")
    last = roots(linked.where("form is not null"))
    return linked.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


SQL = f"""
with recursive t as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as crc),
run as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{{LEAST_CHARS},}}')), '{UPPER}', '{LOWER}') as run from documents),
per as (select doc_id, run, count(*) as n, hex(encode(coalesce(cast(doc_id as varchar), '') || ':' || run)) as b from run group by all),
hashed as (select run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(len(b) // 2), lambda i: cast('0x' || substr(b, 2 * i + 1, 2) as bigint))),
  lambda c, x: xor(c >> 8, t.crc[(xor(c, x) & 255) + 1]))) as h from per, t),
changed as (select case when h % {DELETE} = 0 then left(run, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n from hashed),
words as (select word, sum(n)::bigint as n from changed where length(word) >= {LEAST_CHARS} group by word having sum(n) >= {LEAST_COUNT}),
cut as (select word, n, i, left(word, i - 1) || substr(word, i + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
pairs as (select a.word as word, b.word as other from cut a join cut b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select cut.word, w.word from cut join words w on w.word = cut.rest union select w.word, cut.word from cut join words w on w.word = cut.rest),
ranked as (select pairs.word, other, o.n as other_n, count(*) over (partition by pairs.word) as n_near, row_number() over (partition by pairs.word order by o.n desc, other) as k from pairs join words o on o.word = pairs.other),
linked as (select w.word, w.n, coalesce(r.n_near, 0) as n_near, case when r.other_n >= {RATIO} * w.n then r.other end as form, case when r.other_n >= {RATIO} * w.n then r.other_n end as form_n
  from words w left join ranked r on r.word = w.word and r.k = 1),
chain as (select word, word as root, 0 as depth from words union all select c.word, l.form, depth + 1 from chain c join linked l on l.word = c.root where l.form is not null)
select word, form, (select arg_max(root, depth) from chain where chain.word = linked.word) as root, n, n_near, form_n from linked
"""


def op12_spelling(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n for every word of 7 code points or more that occurs twice or more in ``docs`` (doc_id, text).

    Null and empty texts have no words; a null doc_id hashes as the empty string; repeated rows count again.  Of near words with the same n the
    smallest in code-point order is the form.  Runs of any length are words, a text of one run included.  Other columns are ignored; an empty table
    gives no rows.
    """
    counts = runs(docs).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)
    return variants(counts)

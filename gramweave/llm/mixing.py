"""Mixing sources to target weights by systematic sampling.

Every source gets a target of words from its weight; what would exceed ``cap`` times the source's own words is shared anew by weight among
the others, until none is above.  A document's expected copies are its source's target over its words.  They are summed up within the source,
in the order of size, one random offset is added, and a document is emitted once for each whole number that its part of the sum crosses.
As documents are summed in the order of size, the words taken from a source differ from its target by less than the largest document's.

Sums are whole numbers of 1 / UNITS, so reruns and any partitioning agree to the copy.  Rows are sorted by ranges of (source, size, ...), however
large a source is; a range goes on from the sum of the ranges before it, which are counted first.  Only DataFrame expressions run here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gramweave.llm.sharding import numbered
from gramweave.llm.store import written

WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\x0c\r"
WEIGHTS = (5, 2, 1)
CAP = 3

#: One copy in the units of the prefix sums.  A range's sum, RANGE_ROWS * CAP * UNITS, fits a long; sums over ranges are decimals.
UNITS = 1 << 40
#: Rows that one task sorts and sums, about.
RANGE_ROWS = 50_000


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null: each word becomes one sign, and white space goes."""
    return F.coalesce(F.length(F.translate(F.regexp_replace(text, WORD, "x"), SPACE, "")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Source as a key that is never null and sorts by code point, null last."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("z"))


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(_key, source_size, target) of ``sources`` (_key, source_size): ``weights`` go round the sources by _key and share the sum of all sizes.

    A target is at most ``cap`` times its source's size; the excess is reshared by weight, in as many rounds as bring new sources to their cap,
    each of which brings four numbers to the driver.  No rows give no rows; sources without words have the target 0.
    """
    ranked = numbered(sources.withColumn("_all", F.lit(0)), "_all", ["_key"], "_no")
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("_no") % len(weights) + 1).cast("int"))
    weighed = written(ranked.select("_key", "source_size", weight.alias("_weight"), (F.col("source_size") * cap).alias("_most")), "mix-sources")
    total, share = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_weight"), F.lit(0))).first()
    spare, known = total, 0
    while True:
        # As a long: from 430 million words on, five times them are no int any more.
        wanted = F.col("_weight") * F.lit(spare).cast("long") / F.lit(share) if share else F.col("_most").cast("double")
        full = wanted > F.col("_most")
        n, words, taken, everything = weighed.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("_most"))), F.lit(0)), F.coalesce(F.sum(F.when(full, F.col("_weight"))), F.lit(0)), F.coalesce(F.sum("_weight"), F.lit(0))).first()
        if n == known:
            return weighed.select("_key", "source_size", F.least(wanted, F.col("_most").cast("double")).alias("target"))
        spare, share, known = total - words, everything - taken, n


def mix(rows: DataFrame, order: Sequence[str] = (), weights: Sequence[float] = WEIGHTS, cap: int = CAP, seed: str = "mix") -> DataFrame:
    """``rows`` (source, size and any others) with source_size, target (its source's, in words) and copies, how often the mix takes the row.

    A row is taken ``cap`` times at most.  Rows of a source are summed by size, then by ``order``, which should name a key: rows alike in all
    of these are interchangeable, so a rerun may swap their copies.  A null source is a source of its own, the last one; a null size counts as 0,
    and such rows are taken like others.  Columns of the names that are added give way.  No rows give no rows.
    """
    made = {"source_size", "target", "copies"}
    kept = rows.select(*(F.col(f"`{c}`") for c in rows.columns if c.lower() not in made))
    size = F.coalesce(F.col("size"), F.lit(0)).cast("long")
    keyed = written(kept.withColumns({"size": size, "_key": source_key(F.col("source")), "_id": F.monotonically_increasing_id()}), "mix-rows")
    counted = keyed.groupBy("_key").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    aims = targets(counted.select("_key", "source_size"), weights, cap)
    expected = F.when(F.col("source_size") > 0, F.least(F.lit(cap * UNITS), F.floor(F.col("target") * float(UNITS) / F.col("source_size") + 0.5))).otherwise(0).cast("long")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("_key")).cast("binary")), 1, 10), 16, 10).cast("long")

    keys = ["_key", "size", *order, "_id"]
    n = max(1, -(-keyed.count() // RANGE_ROWS))
    ranged = written(keyed.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "mix-ranges")
    ranged = ranged.withColumn("_part", F.shiftright("_at", 33))
    before = W.partitionBy("_key").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sums = ranged.groupBy("_key", "_part").agg(F.count("*").alias("_n")).join(aims, "_key").withColumns({"_expected": expected, "_offset": offset})
    wide = F.col("_n").cast("decimal(18,0)") * F.col("_expected").cast("decimal(18,0)")
    start = F.coalesce(F.sum(wide).over(before), F.lit(0).cast("decimal(38,0)")) + F.col("_offset").cast("decimal(18,0)")
    # Whole copies of the ranges before have been emitted there; only the part beyond them goes on.
    starts = sums.withColumn("_start", F.pmod(start, F.lit(UNITS).cast("decimal(38,0)")).cast("long")).select("_key", "_part", "source_size", "target", "_expected", "_start")
    upto = F.col("_start") + F.sum("_expected").over(W.partitionBy("_key", "_part").orderBy("_at").rowsBetween(W.unboundedPreceding, 0))
    crossed = F.shiftright("_upto", 40) - F.shiftright(F.col("_upto") - F.col("_expected"), 40)
    return ranged.join(starts, ["_key", "_part"]).withColumn("_upto", upto).withColumn("copies", crossed.cast("long")).select(*kept.columns, "source_size", "target", "copies")


def emitted(mixed: DataFrame, copy: str = "copy") -> DataFrame:
    """The mix itself: each row of ``mix`` once for each of its copies, numbered from 1 in column ``copy``."""
    return mixed.where("copies > 0").withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))


SQL = f"""
with sized as (select doc_id, coalesce('s' || source, 'z') as k, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size from documents),
src as (select k, sum(size)::bigint as source_size from sized group by k),
weighed as (select k, source_size, {list(WEIGHTS)}[(row_number() over (order by k) - 1) % {len(WEIGHTS)} + 1] as w, {CAP} * source_size as most from src),
turn as (select *, sum(source_size) over () as total, sum(w) over () as weights, coalesce(sum(most) over b, 0) as most_before, coalesce(sum(w) over b, 0) as w_before
  from weighed window b as (order by most / w, k rows between unbounded preceding and 1 preceding)),
capped as (select *, w * (total - most_before) / (weights - w_before) > most as is_full from turn),
rest as (select any_value(total) - coalesce(sum(most) filter (is_full), 0) as spare, any_value(weights) - coalesce(sum(w) filter (is_full), 0) as share from capped),
aims as (select k, source_size, case when is_full then most::double else (w * spare / share)::double end as target from capped, rest),
steps as (select k, source_size, target, case when source_size > 0 then least({CAP * UNITS}, floor(target * {float(UNITS)} / source_size + 0.5)::bigint) else 0 end as e,
  cast('0x' || substr(md5('mix|' || k), 1, 10) as bigint) as u from aims),
placed as (select sized.*, row_number() over (partition by k order by size, doc_id nulls first)::hugeint as i from sized)
select doc_id, size, source_size, target, (size * ((i * e + u) // {UNITS} - ((i - 1) * e + u) // {UNITS}))::bigint as taken, ((i * e + u) // {UNITS} - ((i - 1) * e + u) // {UNITS})::bigint as copies
from placed join steps using (k)
"""


def op11_mixing(docs: DataFrame) -> DataFrame:
    """doc_id, size (words), source_size, target (its source's), taken (words that the mix takes, repeats counted) and copies of every row of ``docs``
    (doc_id, text, source).

    Sources by code point, null last, weigh 5, 2, 1 in turn.  A null or blank text has the size 0 and takes nothing, whatever its copies.  Rows that repeat a
    doc_id are rows of their own; ties in size are summed by doc_id, null first.  Very long texts count whole.  Other columns are ignored; an empty
    table gives no rows.
    """
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    out = mix(rows, ["doc_id"])
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")

"""URL filter: host and path rules, and gradient-boosted trees on lexical features where no rule decides.

The trees are trained on labelled URLs.  Features, all of them expressions: lengths, depth, digit ratio, entropy, parameter counts, shares
of other characters, and statistics of the host's suffix over all rows and over the labelled ones.  A labelled row's suffix statistics
leave out the rows of its own fold, and folds go by host.

``pages`` has no labels of its own.  The registered query labels its URLs weakly, by SEED_WORDS in the host's names: a documented
stand-in for a labelled table, independent of suffixes and rules.  No feature sees a word; the trees have to tell by shape.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramweave.llm.boosting import Boosted, boost
from gramweave.llm.store import written

#: The fit reads so many labelled rows at most, chosen by a hash of the URL; all counts and statistics are over all rows.
TRAIN_ROWS, FOLDS = 20_000, 5

#: Words between the hyphens and dots of a host that mark it as unwanted, for want of labels.
SEED_WORDS = ("adult", "ads", "bet", "bets", "casino", "farm", "gambling", "loan", "loans", "pills", "poker", "porn", "spam", "track", "tracker", "viagra", "xxx")

#: verdict, host and path of a rule: it fits its host and all subdomains where the path starts with the rule's.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(df: DataFrame) -> DataFrame:
    """``df`` with host and path of column url: both empty for a null url or one without ``://``."""
    has = F.coalesce(F.instr("url", "://") > 0, F.lit(False))
    rest = F.when(has, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return df.withColumns({"host": F.translate(host, UPPER, LOWER), "path": path})


def with_rule(df: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """``df`` (host, path) with rule and rule_verdict: of the rules that fit, the one whose host and path are longest; else null.

    The longest host comes first, then the longest path.
    """
    order = sorted(rules, key=lambda r: (-len(r[1]), -len(r[2]), r))
    fits = [((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path) for _, host, path in order]
    pick = lambda values: reduce(lambda rest, i: F.when(fits[i], F.lit(values[i])).otherwise(rest), reversed(range(len(order))), F.lit(None).cast("string"))
    return df.withColumns({"rule": pick([h + p for _, h, p in order]), "rule_verdict": pick([v for v, _, _ in order])})


def suffix(host: Column) -> Column:
    """The host's last label."""
    return F.element_at(F.split(host, r"\."), -1)


def seed_labels(urls: DataFrame) -> DataFrame:
    """(url, label) of each row of ``urls`` (url) with a host: 1 if a word of its names is one of SEED_WORDS."""
    words = F.split("host", r"[.\-]")
    return split_url(urls.select("url")).where("host <> ''").select("url", F.arrays_overlap(words, F.array(*map(F.lit, SEED_WORDS))).cast("int").alias("label"))


def fold(host: Column) -> Column:
    return F.pmod(F.xxhash64(host), F.lit(FOLDS)).cast("int")


def statistics(urls: DataFrame, labelled: DataFrame) -> DataFrame:
    """Per suffix and fold, and with a null fold for all: log of its rows among all, its labelled rows outside the fold, and their smoothed
    share of blocked ones."""
    every = urls.groupBy("suffix").agg(F.count("*").alias("rows"))
    own = labelled.groupBy("suffix", "fold").agg(F.count("*").alias("n"), F.sum("label").alias("bad"))
    total = own.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    folds = own.select("suffix", "fold", F.col("n").alias("own_n"), F.col("bad").alias("own_bad")).unionByName(total.select("suffix", F.lit(None).cast("int").alias("fold"), F.lit(0).cast("long").alias("own_n"), F.lit(0).cast("long").alias("own_bad")))
    n, bad = F.col("n") - F.col("own_n"), F.col("bad") - F.col("own_bad")
    known = folds.join(total, "suffix").select("suffix", "fold", F.log1p(n).alias("suffix_known"), ((bad + 1.0) / (n + 2.0)).alias("suffix_rate"))
    bare = every.join(total, "suffix", "left_anti").select("suffix", F.lit(None).cast("int").alias("fold"), F.lit(0.0).alias("suffix_known"), F.lit(0.5).alias("suffix_rate"))
    return known.unionByName(bare).join(every, "suffix", "left").select("suffix", "fold", F.log1p(F.coalesce("rows", F.lit(0))).alias("suffix_log"), "suffix_known", "suffix_rate")


STATS = ("suffix_log", "suffix_known", "suffix_rate")


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features of a URL's text as expressions; those of a null url are those of an empty one."""
    url = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    without = lambda c, some: F.length(c) - F.length(F.translate(c, some, ""))
    share = lambda c: (F.length(url) - F.length(F.replace(url, c))) / n
    entropy = F.aggregate(F.transform(F.array_distinct(F.split(url, "")), lambda c: F.when(c == "", 0.0).otherwise(-share(c) * F.log2(share(c)))), F.lit(0.0), lambda a, b: a + b)
    query = F.regexp_extract(url, r"(?s)^[^#?]*\?([^#]*)", 1)
    labels = F.split(host, r"\.")
    name = F.when(F.size(labels) >= 3, F.element_at(labels, -3)).otherwise("")
    last = F.element_at(F.split(path, "/"), -1)
    digits = "0123456789"
    return {
        "url_length": F.length(url), "host_length": F.length(host), "path_length": F.length(path), "depth": without(path, "/"), "digit_ratio": without(url, digits) / n,
        "entropy": entropy, "parameters": F.size(F.filter(F.split(query, "&"), lambda p: p != "")), "query_length": F.length(query), "host_labels": F.size(labels),
        "host_hyphens": without(host, "-"), "host_digits": without(host, digits), "https": F.lower(F.substring(url, 1, 6)) == "https:", "fragment": F.contains(url, F.lit("#")),
        "slash_end": F.endswith(path, F.lit("/")), "dot_in_last": F.contains(last, F.lit(".")), "vowel_ratio": without(name, "aeiou") / F.greatest(F.length(name), F.lit(1)),
    }


def _features(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _judge(batches: Iterator[pa.RecordBatch], model: Boosted) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        p = model.probability(_features(batch)) if batch.num_rows else np.zeros(0)
        keep = [batch.column(c) for c in ("page_id", "host", "path", "rule", "rule_verdict")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(p)], ["page_id", "host", "path", "rule", "rule_verdict", "block_score"])


def _with_features(rows: DataFrame) -> DataFrame:
    """``rows`` (url, host, path, STATS) with ``features``, an array of doubles; a suffix without statistics has zeros."""
    parts = [*lexical(F.col("url"), F.col("host"), F.col("path")).values(), *(F.coalesce(c, F.lit(0.0)) for c in STATS)]
    return rows.withColumn("features", F.array(*(c.cast("double") for c in parts)))


def sampled(known: DataFrame) -> DataFrame:
    """At most TRAIN_ROWS distinct URLs of ``known``, those of least hash.  A threshold from the count keeps what tasks send near that."""
    distinct = known.agg(F.approx_count_distinct("url").alias("n")).first()["n"]
    draw, width = F.xxhash64("url"), 1 << 62
    share = min(1.0, 1.3 * TRAIN_ROWS / max(1, distinct))
    some = known if share == 1.0 else known.where(F.pmod(draw, F.lit(width)) < int(share * width))
    once = some.groupBy("url", "host", "path", "suffix", "fold").agg(F.max("label").alias("label"))
    return once.orderBy(F.pmod(draw, F.lit(width)), "url").limit(TRAIN_ROWS)


def filter_urls(pages: DataFrame, labelled: DataFrame | None = None, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and block_score of every row of ``pages`` (page_id, url; other columns are ignored).

    ``labelled`` has (url, label), label 1 to block; without it, ``seed_labels`` of the pages; rows with a null label are left out, and of a
    URL's labels the largest counts.  A rule's verdict stands; elsewhere the trees block at a score of one half or more.  A null or
    scheme-less url has empty host and path and is scored so.  Without labelled rows of both classes every URL has the same score: that of
    the class that is there, allow if there is none.  No rows give no rows.
    """
    urls = with_rule(split_url(pages.select("page_id", "url")), rules).withColumn("suffix", suffix(F.col("host")))
    marked = seed_labels(pages) if labelled is None else labelled.select("url", "label")
    known = split_url(marked.where("label is not null")).withColumns({"suffix": suffix(F.col("host")), "fold": fold(F.col("host"))})
    stats = written(statistics(urls, known), "suffixes")
    sample = sampled(known).join(stats.where("fold is not null"), ["suffix", "fold"], "left")
    rows = _with_features(sample).select("url", "features", F.col("label").cast("double").alias("label")).toArrow().combine_chunks().sort_by([("url", "ascending")])
    fitted = rows.to_batches()[0] if rows.num_rows else None
    model = boost(_features(fitted), fitted.column("label").to_numpy()) if fitted is not None else Boosted(-1.0, 1)
    judged = _with_features(urls.join(stats.where("fold is null").drop("fold"), "suffix", "left")).select("page_id", "host", "path", "rule", "rule_verdict", "features")
    kind = dict(pages.select("page_id").dtypes)["page_id"]
    out = judged.mapInArrow(partial(_judge, model=model), f"page_id {kind}, host string, path string, rule string, rule_verdict string, block_score double")
    verdict = F.coalesce("rule_verdict", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_score")

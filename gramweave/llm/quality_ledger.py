"""Rule bitmask ledger: every quality rule is evaluated once, and policies are bit arithmetic over what it left.

A ledger row holds the measurements and ``failed``, a long whose bit i says that rule i failed.  A policy is a named, versioned set of
rules; applying it is one bitwise AND over the stored ledger, so a new policy or an ablation never reads a text again.  Only DataFrame
expressions run here.  Equal windows of words are found by 64-bit hashes: a text of n words has a false repeat with a probability of
about n * n / 2**65.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramweave.llm.store import written

WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Rules in bit order: name and the condition, over the measurements, under which a text fails.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > 1 * n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("stuttering", "100 * n_echo_words > 20 * n_words"),
    ("long_words", "word_chars > 40 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        names = [name for name, _ in RULES]
        return sum(1 << names.index(rule) for rule in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
STANDARD = Policy("standard", 1, tuple(name for name, _ in RULES))


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and n_echo_words (longs).

    Words are runs of other characters than ASCII white space.  n_repeat_words counts the words that lie in a window of five words
    found twice or more in the text; n_dup_lines the lines with a word that equal an earlier line; n_echo_words the words equal to
    the word before.  A null text counts as empty: all are 0.  All columns of ``docs`` stay; those named like a measurement
    give way to it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    taken = {"n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_echo_words", "failed"}
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken]
    split = docs.select(F.struct(*kept).alias("_row"), text.alias("_text"))
    text = F.col("_text")
    split = split.withColumns({
        "_words": F.filter(F.split(text, BLANK), lambda w: w != ""),
        "_chars": F.length(F.regexp_replace(text, BLANK, "")),
        "_marks": F.length(text) - F.length(F.translate(text, SYMBOLS, "")),
        "_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)),
    }).drop("_text")
    size = F.size("_words")
    hashed = split.withColumns({
        "_hash": F.transform("_words", lambda w: F.xxhash64(w)),
        "_n": size,
        "_ln": F.size("_lines"),
        "_ld": F.size(F.array_distinct("_lines")),
    }).drop("_words", "_lines")
    # Window i is hashed with its position, sorted, and found again if a neighbour in that order has its hash.
    shift = lambda c, k: F.slice(c, k + 1, F.greatest(F.size(c), F.lit(1)))
    windows = F.slice(F.arrays_zip(*(shift("_hash", k).alias(f"h{k}") for k in range(WINDOW))), F.lit(1), F.greatest(F.col("_n") - (WINDOW - 1), F.lit(0)))
    keyed = hashed.withColumns({
        "_win": F.array_sort(F.transform(windows, lambda w, i: F.struct(F.xxhash64(*(w[f"h{k}"] for k in range(WINDOW))).alias("h"), i.alias("p")))),
        "_echo": F.size(F.filter(F.zip_with("_hash", shift("_hash", 1), lambda a, b: a == b), lambda same: same)),
    }).drop("_hash")
    paired = keyed.withColumn("_same", F.zip_with("_win", shift("_win", 1), lambda a, b: a["h"] == b["h"]))
    flagged = F.zip_with(F.col("_win"), F.arrays_zip(F.col("_same").alias("n"), F.concat(F.array(F.lit(False)), F.col("_same")).alias("b")), lambda w, s: F.when(s["n"] | s["b"], w["p"]))
    repeated = paired.withColumn("_at", F.array_sort(F.filter(flagged, lambda p: p.isNotNull()))).drop("_win", "_same")
    covered = F.aggregate(F.zip_with("_at", shift("_at", 1), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda x, y: x + y)
    out = {"n_words": F.col("_n"), "word_chars": F.col("_chars"), "n_symbols": F.col("_marks"), "n_lines": F.col("_ln"), "n_dup_lines": F.col("_ln") - F.col("_ld"), "n_repeat_words": covered, "n_echo_words": F.col("_echo")}
    return repeated.select("_row.*", *(v.cast("long").alias(k) for k, v in out.items()))


def judged(docs: DataFrame) -> DataFrame:
    """``measured(docs)`` and ``failed``: bit i is set if rule i of RULES failed."""
    bits = [F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, condition) in enumerate(RULES)]
    return measured(docs).withColumn("failed", reduce(lambda a, b: a.bitwiseOR(b), bits))


def ledger(docs: DataFrame, without: Sequence[str] = ()) -> DataFrame:
    """``judged(docs)``, written to the shared folder but for columns ``without``."""
    return written(judged(docs).drop(*without), "ledger")


def fails(policy: Policy) -> Column:
    return F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def apply_policy(entries: DataFrame, policy: Policy) -> DataFrame:
    """Ledger rows with ``kept``: no rule of the policy failed."""
    return entries.withColumn("kept", ~fails(policy))


def ablations(entries: DataFrame, policies: Sequence[Policy]) -> DataFrame:
    """For each policy and each of its rules, how many rows the rule fails, fails alone, and would be kept without it.

    One row per (policy, version, rule): n_failed, n_alone, n_kept, n_kept_without; rows are counted once over the ledger,
    grouped by the bit patterns, of which there are at most 2 ** len(RULES).
    """
    patterns = entries.groupBy("failed").agg(F.count("*").alias("n"))
    names = [name for name, _ in RULES]
    parts = [F.struct(F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), F.lit(r).alias("rule"), F.lit(p.mask).cast("long").alias("mask"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for p in policies for r in p.rules]
    rows = patterns.select("failed", "n", F.inline(F.array(*parts)))
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    return rows.groupBy("policy", "version", "rule").agg(
        total(hit.bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(hit == F.col("bit")).alias("n_alone"),
        total(hit == 0).alias("n_kept"),
        total((hit == 0) | (hit == F.col("bit"))).alias("n_kept_without"),
    )


def op4_quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept (by STANDARD) and failed of every row of ``docs``
    (doc_id, text; other columns are ignored).

    A null, empty or blank text has no words and fails few_words alone; repeated rows and null ids are rows like all others; ties
    cannot arise; whole texts are measured, however long.  No rows give no rows.
    """
    out = apply_policy(ledger(docs.select("doc_id", "text"), without=["text"]), STANDARD).withColumn("base_failed", fails(BASE))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


#: Policies whose ablations the registered query counts.
POLICIES = (BASE, STANDARD, Policy("repeats", 1, ("repeated_windows", "repeated_lines", "stuttering")))


def quality_ablations(docs: DataFrame) -> DataFrame:
    """``ablations`` of POLICIES over the stored ledger of all rows of ``docs`` (doc_id, text); no rows give no rows."""
    return ablations(ledger(docs.select("text"), without=["text"]), POLICIES)


def reject(docs: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """``docs``, all its columns, without the rows that the policy rejects; every row is judged by its own text, null texts as empty.

    The ledger's rows pass by without being stored, so whoever writes the result writes the texts once.  That the filter reads a row number keeps it behind
    the measurements: moved before them, it would make each anew wherever a rule names it.
    """
    names = list(docs.columns)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col("text"))
    entries = judged(whole).select("row", "failed", F.monotonically_increasing_id().alias("number"))
    return entries.where(~fails(policy) & (F.col("number") >= 0)).select("row.*")


#: Words, lines and windows by DuckDB's lists; the same rules.
_LEDGER = r"""
with w as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
m as (select doc_id, t, ws, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars,
  length(t) - length(translate(t, '#*$%&|<>', '')) as n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from w),
win as (select doc_id, i, ws[i : i + 4] as k from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from m)),
dup as (select doc_id, unnest(list_distinct(flatten(list(range(i, i + 5))))) as p from (select doc_id, i, count(*) over (partition by doc_id, k) as c from win) where c > 1 group by doc_id),
rep as (select doc_id, count(*) as n_repeat_words from dup group by doc_id),
e as (select doc_id, n_words, word_chars, n_symbols, len(ls) as n_lines, len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
  len(list_filter(range(2, n_words + 1), lambda i: ws[i] = ws[i - 1])) as n_echo_words from m left join rep using (doc_id)),
b as (select *, n_words < 10 as b0, 100 * n_repeat_words > 20 * n_words as b1, 10 * n_symbols > n_words as b2, 2 * n_dup_lines > n_lines as b3, 100 * n_echo_words > 20 * n_words as b4, word_chars > 40 * n_words as b5 from e)"""

SQL = _LEDGER + r"""
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, b0 or b1 as base_failed, not (b0 or b1 or b2 or b3 or b4 or b5) as kept,
  cast(b0::int + 2 * b1::int + 4 * b2::int + 8 * b3::int + 16 * b4::int + 32 * b5::int as bigint) as failed from b
"""

ABLATIONS_SQL = _LEDGER + """,
f as (select cast(b0::int + 2 * b1::int + 4 * b2::int + 8 * b3::int + 16 * b4::int + 32 * b5::int as bigint) as failed from b),
r(rule, bit) as (values ('few_words', 1), ('repeated_windows', 2), ('symbols', 4), ('repeated_lines', 8), ('stuttering', 16), ('long_words', 32)),
p(policy, version, mask) as (values ('base', 1, 3), ('standard', 1, 63), ('repeats', 1, 26))
select policy, version, rule, cast(count(*) filter (failed & bit <> 0) as bigint) as n_failed, cast(count(*) filter (failed & mask = bit) as bigint) as n_alone,
  cast(count(*) filter (failed & mask = 0) as bigint) as n_kept, cast(count(*) filter (failed & mask & ~bit = 0) as bigint) as n_kept_without
from f, p join r on mask & bit <> 0 group by policy, version, rule
"""

import random
import re
from collections import Counter

from gramweave.llm.quality_ledger import BASE, STANDARD, Policy, ablations, apply_policy, ledger, measured, op4_quality_rules, reject


def test_measurements(spark):
    rows = [
        (1, None, 5), (2, "", 5), (3, " \n\t ", 5), (4, "a b c d e a b c d e", 5), (5, "a a a a a a", 5), (6, "x\nx\n\n \nx\ny", 5),
        (7, "é漢\x00b \x0b$|<>#*&% q", 5), (8, "a b c d", 5), (9, "p q r s t u p q r s t", 5),
    ]
    got = {r.doc_id: r for r in measured(spark.createDataFrame(rows, "doc_id long, text string, n_words int")).collect()}
    of = lambda i: (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words, got[i].n_echo_words)
    assert of(1) == of(2) == of(3) == (0, 0, 0, 0, 0, 0)
    assert of(4) == (10, 10, 0, 0, 10, 0)
    assert of(5) == (6, 6, 0, 0, 6, 5)
    assert of(6) == (4, 4, 0, 2, 0, 2)
    assert of(7) == (3, 13, 8, 0, 0, 0)
    assert of(8) == (4, 4, 0, 0, 0, 0)
    assert of(9) == (11, 11, 0, 0, 10, 0)


def test_policies_and_ablations(spark):
    rows = [(1, "one two three four five six seven eight nine ten eleven"), (2, "short"), (3, "a b c d e a b c d e a b"), (4, None)]
    entries = ledger(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in apply_policy(entries, STANDARD).where("kept").collect()} == {1}
    got = {(r.policy, r.rule): (r.n_failed, r.n_alone, r.n_kept, r.n_kept_without) for r in ablations(entries, [BASE, Policy("lines", 2, ("repeated_lines",))]).collect()}
    assert got[("base", "few_words")] == (2, 2, 1, 3)
    assert got[("base", "repeated_windows")] == (1, 1, 1, 2)
    assert got[("lines", "repeated_lines")] == (0, 0, 4, 4)


def brute(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    found = Counter(windows)
    repeated = {j for i, w in enumerate(windows) if found[w] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated), sum(a == b for a, b in zip(words, words[1:], strict=False))


def test_against_brute_force(spark):
    r = random.Random(9)
    parts = ["a", "b", "Ab", "é", "漢|", "#", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\xa0", "a b c d e "]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.choice([0, 3, 30, 200])))) for i in range(150)] + [(150, None), (151, "x y z " * 180_000)]
    got = {x.doc_id: (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.n_echo_words) for x in measured(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: brute(t) for i, t in rows}


def test_names_of_the_caller_stay(spark):
    df = spark.createDataFrame([(1, "a b c d e a b c d e f", 7, 8)], "doc_id long, text string, _words int, _at int")
    row = measured(df).first()
    assert (row["_words"], row["_at"], row.n_words, row.n_repeat_words) == (7, 8, 11, 10)
    assert reject(df, Policy("few", 1, ("few_words",))).collect() == df.collect()


def test_reject_keeps_columns(spark):
    rows = [(1, "one two three four five six seven eight nine ten eleven", 3, "f"), (2, "short", 4, "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int, failed string")
    assert reject(df).collect() == [df.collect()[0]]
    assert op4_quality_rules(df.limit(0)).count() == 0

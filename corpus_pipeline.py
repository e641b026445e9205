"""Corpus pipeline: quality rules, toxicity, near-duplicates, benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every stage's result as Parquet to the shared folder
and gives what was written to the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramweave.llm import bpe_tree, decontaminate, near_dup, quality_ledger, toxicity
from gramweave.llm.store import table, written

TOKENS = "byte_bpe_multi_50k.tiktoken"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the standard policy of the rule ledger rejects.

    Every row is judged by its own whole text: a null, empty or blank one has no words and goes, repeated rows and null ids are rows like all
    others.  No rows give no rows; columns of any name stay.
    """
    return quality_ledger.reject(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the tagger, fitted on the labelled documents of the stage's input, scores one half or more.

    Labels of ids whose crc32 is a multiple of 5 are not learnt from.  Every row is judged by its own whole text; null and empty texts stay, and
    without labelled rows of both classes all do.  A doc_id with both labels counts as unlabelled.  No rows give no rows; columns of any name stay.
    """
    labels = table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    return toxicity.reject(docs, toxicity.train(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group, the least doc_id: five-word shingles, similarity of 0.8 or more.

    Null, empty and blank texts are in no group.  Rows that repeat a doc_id are compared by their own texts and of equal ones one stays; rows with a
    null doc_id link others but stay.  No rows give no rows; columns of any name stay.
    """
    return near_dup.drop_near_duplicates(docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that any window of a benchmark item occurs in.

    Every row is judged by its own whole text; null and wordless texts have no window, rows with a null doc_id stay.  Without items nothing goes.
    No rows give no rows; columns of any name stay.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds token_ids to every document; text is what decoding them gives.

    A null text becomes empty, with no ids; a column token_ids of the input gives way.  Rows, repeated ones too, come out one for one.
    """
    return bpe_tree.encode_documents(docs, public_tokenizers.path(TOKENS), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("tokens", tokens)]

#: A fitted tagger and BPE have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    name, stage = STAGES[-1]
    return written(stage(spark, docs, sf_dir), name)

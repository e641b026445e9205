"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gramweave.llm import bpe_tree, decontaminate, html_extract, lm_score, mixing, near_dup, quality_ledger, sharding, spelling, toxicity, url_filter, warc
from gramweave.llm.store import table

TOKENS = "byte_bpe_multi_50k.tiktoken"


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op3_decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_ledger.op4_quality_rules(table(spark, sf_dir, "documents"))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_ledger.quality_ablations(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op5_sharding(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op6_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.op7_lm_scoring(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op8_warc(table(spark, sf_dir, "pages"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.op9_html_extraction(table(spark, sf_dir, "pages"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.op10_bpe(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENS), public_tokenizers.PATTERN)


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op11_mixing(table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.op12_spelling(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_minhash_near_dedup, op2_url_filter, op3_decontamination, op4_quality_rules, op5_sharding, op6_toxicity, op7_lm_scoring, op8_warc, op9_html_extraction, op10_bpe, op11_mixing, op12_spelling, quality_ablations)
}

ORACLES: dict[str, str] = {"op1_minhash_near_dedup": near_dup.SQL, "op3_decontamination": decontaminate.SQL, "op4_quality_rules": quality_ledger.SQL, "quality_ablations": quality_ledger.ABLATIONS_SQL, "op5_sharding": sharding.SQL, "op7_lm_scoring": lm_score.SQL, "op8_warc": warc.SQL, "op11_mixing": mixing.SQL, "op12_spelling": spelling.SQL}

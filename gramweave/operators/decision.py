"""DEC1-DEC9: how held-out decisions change with p.  Inputs are oof rows (p, repeat, fold, s, y, score, prediction)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gramweave.functions.stats import pearson, quartiles, roc_auc, spearman


def provenance(oof: DataFrame) -> DataFrame:
    """DEC1: one row: subjects, p values, repeats, rows, and how many (p, repeat, subject) do not stand there exactly once."""
    wrong = oof.groupBy("p", "repeat", "s").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") != 1).alias("repeated"))
    size = oof.agg(F.count_distinct("s").alias("subjects"), F.count_distinct("p").alias("ps"), F.count_distinct("repeat").alias("repeats"), F.count(F.lit(1)).alias("n_rows"))
    return size.crossJoin(wrong).withColumn("complete", (F.col("repeated") == 0) & (F.col("n_rows") == F.col("subjects") * F.col("ps") * F.col("repeats")))


def subject_summary(oof: DataFrame) -> DataFrame:
    """DEC2: per (p, s), median, mean, deviation and quartiles of the score over repeats; prediction 1 for a median of 0 or more."""
    out = oof.groupBy("p", "s").agg(F.first("y").alias("y"), *quartiles("score"), F.avg("score").alias("score_mean"), F.stddev_samp("score").alias("score_sd"), F.count(F.lit(1)).alias("n_repeats"))
    return out.withColumn("pred_from_median_score", (F.col("score_median") >= 0).cast("int"))


def class_summary(rows: DataFrame) -> DataFrame:
    """DEC3: per (source, p, repeat, y), median, quartiles, mean and deviation."""
    return rows.groupBy("source", "p", "repeat", "y").agg(*quartiles("score"), F.avg("score").alias("score_mean"), F.stddev_samp("score").alias("score_sd"))


def against_reference(oof: DataFrame, reference: float) -> DataFrame:
    """DEC5: per p, agreement of the subjects' median scores with those at the reference p, and quartiles of the repeats' AUCs."""
    subject = subject_summary(oof).select("p", "s", F.col("score_median").alias("x"), F.col("pred_from_median_score").alias("label"))
    ref = subject.where(F.col("p") == reference).select("s", F.col("x").alias("x0"), F.col("label").alias("label0"))
    both = subject.join(ref, "s")
    same = (F.col("label") == F.col("label0")).cast("double")
    out = both.groupBy("p").agg(pearson("x", "x0").alias("pearson"), F.avg(same).alias("label_agreement"), F.count_if(F.col("label") != F.col("label0")).alias("n_label_changes"), F.percentile(F.abs(F.col("x") - F.col("x0")), 0.5).alias("median_abs_delta_score"))
    auc = roc_auc(oof, ["p", "repeat"], "y", "score", "oof_auc").groupBy("p").agg(*quartiles("oof_auc"))
    return out.join(spearman(both, ["p"], "x", "x0", "spearman"), "p").join(auc, "p")


def crossings(subject: DataFrame) -> DataFrame:
    """DEC6: per subject, how often the median score changes its sign between adjacent p, and the first p after such a change."""
    w = W.partitionBy("s").orderBy("p")
    rows = subject.select("s", "y", "p", (F.col("score_median") < 0).alias("neg")).withColumn("before", F.lag("neg").over(w))
    crossed = F.col("neg") != F.col("before")
    out = rows.groupBy("s").agg(F.first("y").alias("y"), F.count_if(crossed).alias("n_adjacent_boundary_crossings"), F.min(F.when(crossed, F.col("p"))).alias("first_p_after_crossing"))
    return out.withColumn("ever_crosses_boundary", F.col("n_adjacent_boundary_crossings") > 0)


def wide(subject: DataFrame, grid: Sequence[float]) -> DataFrame:
    """DEC7: one row per subject with a column p_<p> for each p of the grid."""
    named = subject.groupBy("s").pivot("p", [float(p) for p in grid]).agg(F.first("score_median"))
    return named.select("s", *(F.col(f"`{float(p)}`").alias(f"p_{p:g}".replace(".", "_")) for p in grid))


def trajectories(subject: DataFrame, reference: float) -> DataFrame:
    """DEC8: each subject's change of the median score from the reference p."""
    ref = F.max(F.when(F.col("p") == reference, F.col("score_median"))).over(W.partitionBy("s"))
    return subject.select("p", "s", "y", (F.col("score_median") - ref).alias("delta"))


def heat_map(subject: DataFrame, reference: float) -> DataFrame:
    """DEC9, PLT5: subjects numbered by class, then score at the reference, and the 98 per cent point of |score| as colour limit."""
    ref = subject.where(F.col("p") == reference).select("s", F.row_number().over(W.orderBy("y", "score_median", "s")).alias("row"))
    limit = subject.agg(F.percentile(F.abs("score_median"), 0.98).alias("colour_limit"))
    return subject.select("p", "s", "score_median").join(ref, "s").crossJoin(limit)


def class_curves(oof: DataFrame) -> DataFrame:
    """PLT3: class medians of the score per p."""
    return oof.groupBy("p", "y").agg(F.percentile("score", 0.5).alias("score_median"), F.count(F.lit(1)).alias("n"))

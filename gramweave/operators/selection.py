"""SEL1-SEL11: unsupervised choice of units (genes, sensors) and how stable and faithful it is."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gramweave.operators.spectral import selections


def donor_sums(values: DataFrame) -> DataFrame:
    """SEL1: sums, sums of squares and detected cells of (donor, gene, x), one row a cell and gene; those of parts add up (``merged_sums``)."""
    return values.groupBy("donor", "gene").agg(F.sum("x").alias("sum_x"), F.sum(F.col("x") ** 2).alias("sum_x2"), F.count_if(F.col("x") > 0).alias("detected"))


def merged_sums(parts: DataFrame) -> DataFrame:
    """SEL1: ``donor_sums`` of the whole from those of disjoint parts."""
    return parts.groupBy("donor", "gene").agg(*(F.sum(c).alias(c) for c in ("sum_x", "sum_x2", "detected")))


def group_statistics(values: DataFrame, cells: DataFrame) -> DataFrame:
    """SEL1: per (donor, gene), sums, sums of squares and detected cells of sparse (cell, gene, x), with the donor's number of cells.

    ``cells`` is (cell, donor); a gene that a cell does not list is 0, so means divide by all cells of the donor.
    """
    return sized_sums(values.join(cells, "cell"), cells)


def sized_sums(values: DataFrame, cells: DataFrame) -> DataFrame:
    """SEL1: ``group_statistics`` of values (donor, gene, x) that have their cells' donors already."""
    size = cells.groupBy("donor").agg(F.count(F.lit(1)).alias("n_cells"))
    return donor_sums(values).join(size, "donor")


def gene_statistics(stats: DataFrame, cells: DataFrame) -> DataFrame:
    """SEL2, SEL3: per gene, donors weighing alike: mean, population variance (0 at least), detection, prevalence and Fano factor."""
    donors = cells.agg(F.count_distinct("donor").alias("donors"))
    own = stats.withColumns({"m": F.col("sum_x") / F.col("n_cells"), "m2": F.col("sum_x2") / F.col("n_cells"), "rate": F.col("detected") / F.col("n_cells")})
    g = own.groupBy("gene").agg(F.sum("m").alias("m"), F.sum("m2").alias("m2"), F.sum("rate").alias("rate"), F.count_if(F.col("detected") > 0).alias("present")).crossJoin(F.broadcast(donors))
    mean = F.col("m") / F.col("donors")
    out = g.select("gene", mean.alias("mean"), F.greatest(F.col("m2") / F.col("donors") - mean * mean, F.lit(0.0)).alias("variance"), (F.col("rate") / F.col("donors")).alias("detection"), (F.col("present") / F.col("donors")).alias("prevalence"))
    return out.withColumn("fano", F.col("variance") / F.greatest("mean", F.lit(1e-12)))


def eligible(genes: DataFrame, prevalence: float = 0.9, detection: float = 0.02) -> DataFrame:
    """FLT9: genes that most donors have, that enough cells show, and that vary."""
    return genes.where((F.col("prevalence") >= prevalence) & (F.col("detection") >= detection) & (F.col("variance") > 0))


def hvg_residual(genes: DataFrame, bins: int = 40, least: int = 100) -> DataFrame:
    """SEL4: log10 variance less its trend on log10 mean: the binned medians, joined linearly and held level outside; NULL for under ``least`` genes.

    Bins are right-closed between distinct quantiles; with fewer than 5 quantiles the trend is the overall median.  The trend has at most ``bins``
    points, so it is broadcast.
    """
    rows = genes.select("gene", F.log10(F.greatest("mean", F.lit(1e-12))).alias("x"), F.log10(F.greatest("variance", F.lit(1e-12))).alias("y"))
    at = F.array(*(F.lit(k / bins) for k in range(bins + 1)))
    q = rows.agg(F.count(F.lit(1)).alias("n"), F.array_distinct(F.percentile("x", at)).alias("edges"), F.percentile("y", 0.5).alias("level"))
    inner = F.slice("edges", F.lit(2), F.greatest(F.size("edges") - 2, F.lit(0)))
    binned = rows.crossJoin(F.broadcast(q)).withColumn("bin", F.aggregate(inner, F.lit(0), lambda a, e: a + (F.col("x") > e).cast("int")))
    trend = binned.groupBy("bin").agg(F.percentile("x", 0.5).alias("cx"), F.percentile("y", 0.5).alias("cy")).agg(F.array_sort(F.collect_list(F.struct("cx", "cy"))).alias("trend"))
    both = binned.crossJoin(F.broadcast(trend))
    below, above = F.filter("trend", lambda c: c["cx"] <= F.col("x")), F.filter("trend", lambda c: c["cx"] > F.col("x"))
    lo, hi = F.try_element_at(below, F.lit(-1)), F.try_element_at(above, F.lit(1))
    line = lo["cy"] + (hi["cy"] - lo["cy"]) * F.try_divide(F.col("x") - lo["cx"], hi["cx"] - lo["cx"])
    fit = F.when(F.size("edges") < 5, F.col("level")).otherwise(F.coalesce(line, lo["cy"], hi["cy"]))
    return both.select("gene", F.when(F.col("n") >= least, F.col("y") - fit).alias("hvg_residual"))


def ranking(scores: DataFrame, unit: str, score: str) -> DataFrame:
    """SEL5, WIN3: (unit, score, rank) by falling score; ties go by unit."""
    return scores.where(F.col(score).isNotNull()).select(unit, score, F.row_number().over(W.orderBy(F.col(score).desc(), unit)).alias("rank"))


def sensor_scores(series: DataFrame) -> DataFrame:
    """SEL6: per unit of (s, unit, t, value): mean variance within observations, variance of their means, and the sum of both's z over units."""
    day = series.groupBy("s", "unit").agg(F.var_samp("value").alias("v"), F.avg("value").alias("m"), F.count(F.lit(1)).alias("n"), F.count("value").alias("known"))
    unit = day.groupBy("unit").agg(F.avg("v").alias("within"), F.var_samp("m").alias("between"), (F.sum("known") / F.sum("n")).alias("finite_fraction"), F.avg((F.coalesce("v", F.lit(0.0)) <= 1e-24).cast("double")).alias("constant_fraction"))
    w = W.partitionBy()
    z = lambda c: F.coalesce(F.try_divide(F.col(c) - F.avg(c).over(w), F.stddev_pop(c).over(w)), F.lit(0.0))
    return unit.withColumn("combined", z("within") + z("between"))


def stability(series: DataFrame, m: int, seed: int, reps: int, fraction: float = 0.8) -> DataFrame:
    """SEL7: per repetition, Jaccard of the top ``m`` units by within-variance under a subsample of observations with the full ranking's."""
    day = series.groupBy("s", "unit").agg(F.var_samp("value").alias("v"))
    full = ranking(day.groupBy("unit").agg(F.avg("v").alias("score")), "unit", "score").where(F.col("rank") <= m).select("unit")
    chosen = selections(day.select("s").distinct(), seed, reps, fraction)
    score = day.join(chosen, "s").groupBy("rep", "unit").agg(F.avg("v").alias("score"))
    top = score.withColumn("rank", F.row_number().over(W.partitionBy("rep").orderBy(F.col("score").desc(), "unit"))).where(F.col("rank") <= m)
    shared = top.join(full.withColumn("also", F.lit(1)), "unit", "left").groupBy("rep").agg(F.count("also").alias("k"), F.count(F.lit(1)).alias("n"))
    size = full.agg(F.count(F.lit(1)).alias("full"))
    return shared.crossJoin(F.broadcast(size)).select("rep", (F.col("k") / (F.col("n") + F.col("full") - F.col("k"))).alias("jaccard"))


def best_method(stabilities: DataFrame) -> DataFrame:
    """SEL8: the method with the highest mean of its sizes' mean stability; ties go to the first name."""
    mean = stabilities.groupBy("method", "m").agg(F.avg("jaccard").alias("x")).groupBy("method").agg(F.avg("x").alias("mean_stability"))
    return mean.orderBy(F.col("mean_stability").desc(), "method").limit(1)


def _sweep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for s, m, n, a in zip(frame.s, frame.m, frame.n, frame.a, strict=True):
            x = np.array(a, float).reshape(int(n), int(n))[:m, :m]
            bad = np.isnan(x).all(axis=0) | (np.diag(x) == 0)
            e = np.linalg.eigvalsh(np.nan_to_num(x))
            share = np.clip(e, 0, None) / max(e.clip(0).sum(), 1e-300)
            condition = float(e[-1] / e[e > 1e-10][0]) if (e > 1e-10).any() else float("inf")
            out.append((s, m, int((~bad).sum()), int((e > 1e-10).sum()), float(np.exp(-(share[share > 0] * np.log(share[share > 0])).sum())), float(e[0]), float(e[-1]), condition))
        yield pd.DataFrame(out, columns=["s", "m", "nonconstant", "matrix_rank", "effective_rank", "min_eig", "max_eig", "condition"])


def dimension_sweep(operators: DataFrame, sizes: list[int]) -> DataFrame:
    """SEL9: per (s, m), the leading m x m block's rank, effective rank, eigenvalue range and condition (infinite without an eigenvalue over 1e-10); units
    come in ranking order."""
    kind = dict(operators.dtypes)["s"]
    rows = operators.select("s", F.explode(F.array(*map(F.lit, sizes))).alias("m"), "n", "a")
    return rows.mapInPandas(_sweep, f"s {kind}, m int, nonconstant int, matrix_rank int, effective_rank double, min_eig double, max_eig double, condition double")


def recommendation(sweep: DataFrame, least_rank: float = 0.95) -> DataFrame:
    """SEL10: per m, shares of groups of full rank and without constant units; passes if both reach ``least_rank``; the largest passing m."""
    full = F.avg((F.col("matrix_rank") == F.col("m")).cast("double"))
    varied = F.avg((F.col("nonconstant") == F.col("m")).cast("double"))
    rows = sweep.groupBy("m").agg(full.alias("full_rank_fraction"), varied.alias("nonconstant_fraction"), F.percentile("effective_rank", 0.5).alias("effective_rank_median"))
    passed = rows.withColumn("passes", (F.col("full_rank_fraction") >= least_rank) & (F.col("nonconstant_fraction") >= least_rank))
    return passed.withColumn("recommended", F.max(F.when(F.col("passes"), F.col("m"))).over(W.partitionBy()))


#: The prespecified limits of ``passes``.
LIMITS = {"q": 0.5, "stability": 0.75, "least_eig": -1e-8, "condition": 1e6}


def rolled_up(sweep: DataFrame, observations: int, stabilities: DataFrame | None = None) -> DataFrame:
    """SEL10: per m of a dimension sweep, q = m / observations, the mean stability (NULL if unknown; ``stabilities`` is (m, jaccard)), shares of groups
    without constant units and of full rank, and the worst eigenvalue and condition."""
    share = lambda c: F.avg((F.col(c) == F.col("m")).cast("double"))
    rows = sweep.groupBy("m").agg(share("nonconstant").alias("nonconstant_fraction"), F.avg((F.col("matrix_rank") == F.col("nonconstant")).cast("double")).alias("full_rank_fraction"), F.min("min_eig").alias("least_eig"), F.max("condition").alias("condition"))
    known = rows.select(F.lit(None).cast("int").alias("m"), F.lit(None).cast("double").alias("stability")).limit(0) if stabilities is None else stabilities.groupBy("m").agg(F.avg("jaccard").alias("stability"))
    return rows.join(known, "m", "left").withColumn("q", F.col("m") / F.lit(float(observations)))


def passes(rows: DataFrame, limits: Mapping[str, float] = LIMITS, unknown: bool = True) -> DataFrame:
    """FLT12: ``rows`` (m, q, stability, nonconstant_fraction, full_rank_fraction, least_eig, condition) with whether all six rules hold, and the largest m that
    passes (NULL: none).  ``unknown``: whether an unknown stability passes; any other unknown value does not."""
    stable = F.coalesce(F.col("stability") >= limits["stability"], F.lit(unknown))
    rules = stable & (F.col("q") <= limits["q"]) & (F.col("nonconstant_fraction") == 1) & (F.col("full_rank_fraction") == 1) & (F.col("least_eig") >= limits["least_eig"]) & (F.col("condition") <= limits["condition"])
    out = rows.withColumn("passes", F.coalesce(rules, F.lit(False)))
    return out.withColumn("recommended", F.max(F.when(F.col("passes"), F.col("m"))).over(W.partitionBy()))


def smallest_sufficient(rows: DataFrame, levels: Mapping[str, float]) -> DataFrame:
    """SEL10: one row: the smallest m whose named columns all reach their levels; NULL if none does."""
    enough = reduce(lambda a, b: a & b, [F.coalesce(F.col(c) >= level, F.lit(False)) for c, level in levels.items()])
    return rows.agg(F.min(F.when(enough, F.col("m"))).alias("m"))

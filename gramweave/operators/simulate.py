"""SRC19, SIM1-SIM4: seeded synthetic operators and the summary of simulation grids."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gramweave.functions import kernels
from gramweave.functions.stats import clean


def _toy(frames: Iterator[pd.DataFrame], n: int, rank: int, seed: int, positives: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for s in frame.id:
            rng = np.random.default_rng([seed, int(s)])
            x = rng.normal(size=(n, rank))
            y = int(s >= positives)
            if y:
                x[: n // 2, 0] += 1.0
            a = x @ x.T + 1e-3 * np.eye(n)
            rows.append((int(s), y, n, (a / np.trace(a)).ravel().tolist()))
        yield pd.DataFrame(rows, columns=["s", "y", "n", "rho"])


def toy_population(spark: SparkSession, subjects: int = 40, n: int = 12, rank: int = 4, seed: int = 20260925) -> DataFrame:
    """SRC19: (s, y, n, rho); half the subjects, the later ones, are positive.  A row's draw rests on seed and s alone."""
    return spark.range(subjects).mapInPandas(partial(_toy, n=n, rank=rank, seed=seed, positives=subjects // 2), "s long, y int, n int, rho array<double>")


def _cell(frames: Iterator[pd.DataFrame], subjects: int, n: int, rank: int, base: int, grid: tuple[float, ...], shared: bool) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for i, rep, sigma2 in zip(frame.sigma_index, frame.replicate, frame.sigma2, strict=True):
            rng = np.random.default_rng(base + 100_000 * int(i) + int(rep))
            start = rng.normal(size=(n, rank))
            rho = []
            for _ in range(subjects):
                x = (start if shared else rng.normal(size=(n, rank))) + np.sqrt(sigma2) * rng.normal(size=(n, rank))
                rho.append(x @ x.T / (x * x).sum())
            a, b = np.triu_indices(subjects, 1)
            sv = kernels.spectrum_dense(np.stack([rho[k] for k in a]), np.stack([rho[k] for k in b]))
            d1 = kernels.schatten(sv, grid[0])
            rows = []
            for p in grid:
                d = kernels.schatten(sv, p)
                x, y = pd.Series(d1).rank(), pd.Series(d).rank()
                rows.append((float(sigma2), int(i), int(rep), float(p), float(np.median(d)), float(100 * (1 - np.median(d) / np.median(d1))), float(100 * (1 - np.corrcoef(x, y)[0, 1])), float(np.sqrt((kernels.schatten(sv, 2) ** 2).mean()))))
            yield pd.DataFrame(rows, columns=["sigma2", "sigma_index", "replicate", "p", "median_distance", "scale_contraction", "rank_loss", "pair_rms"])


def run_grid(spark: SparkSession, sigmas: Sequence[float], replicates: int, subjects: int, n: int, rank: int, grid: Sequence[float], seed: int = 20260812, shared: bool = True) -> DataFrame:
    """SIM1: per (sigma2, replicate, p), the geometry of a population X0 + sigma G with child seed base + 100000 i + replicate."""
    cells = spark.createDataFrame([(i, float(s)) for i, s in enumerate(sigmas)], "sigma_index int, sigma2 double")
    work = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate")).repartition("sigma_index", "replicate")
    return work.mapInPandas(partial(_cell, subjects=subjects, n=n, rank=rank, base=seed, grid=tuple(map(float, grid)), shared=shared), "sigma2 double, sigma_index int, replicate int, p double, median_distance double, scale_contraction double, rank_loss double, pair_rms double")


def aggregated(rows: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """SIM2, SIM3: count, mean, deviation, 95 per cent interval of the mean and CV (where the mean is positive) of each column's defined values."""
    cells = []
    for c in columns:
        x = clean(c)
        half = 1.96 * F.stddev_samp(x) / F.sqrt(F.count(x))
        cells += [F.count(x).alias(f"{c}_n"), F.avg(x).alias(f"{c}_mean"), F.stddev_samp(x).alias(f"{c}_sd"), (F.avg(x) - half).alias(f"{c}_low"), (F.avg(x) + half).alias(f"{c}_high"), F.when(F.avg(x) > 0, F.stddev_samp(x) / F.avg(x)).alias(f"{c}_cv")]
    return rows.groupBy(*by).agg(*cells)


def relative_residual(means: DataFrame, level: str, curve: str, value: str, reference: float) -> DataFrame:
    """SIM3: (value - reference curve) / reference curve along ``curve``, the reference being the rows of that ``level``."""
    ref = means.where(F.col(level) == reference).select(curve, F.col(value).alias("_ref"))
    return means.join(ref, curve).select(level, curve, F.try_divide(F.col(value) - F.col("_ref"), F.abs("_ref")).alias("relative_residual"))


def preferred(new: DataFrame, old: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SIM4: each key's new row if there is one, else its old one."""
    both = new.withColumn("_source", F.lit(0)).unionByName(old.withColumn("_source", F.lit(1)))
    return both.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy("_source"))).where("_k = 1").drop("_k", "_source")

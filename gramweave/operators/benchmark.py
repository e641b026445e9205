"""BEN1: what the low-rank geometry costs, and how far it is from the dense one."""

from __future__ import annotations

import time
from collections.abc import Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramweave.functions import kernels
from gramweave.functions.stats import md5_order
from gramweave.operators.geometry import paired


def _timed(s: pa.Array, a: np.ndarray, t: pa.Array, b: np.ndarray, n: int, grid: tuple[float, ...]) -> pa.RecordBatch:
    m = len(s)
    a, b = a.reshape(m, n, -1), b.reshape(m, n, -1)
    started = time.perf_counter()
    low = kernels.spectra_lowrank(a, b)
    middle = time.perf_counter()
    dense = kernels.spectrum_dense(a @ a.transpose(0, 2, 1), b @ b.transpose(0, 2, 1))
    ended = time.perf_counter()
    error = np.zeros(m)
    for p in grid:
        x, y = kernels.schatten(low, p), kernels.schatten(dense, p)
        error = np.maximum(error, np.abs(x - y) / np.maximum(np.abs(y), 1e-15))
    each = lambda seconds: pa.array(np.full(m, seconds / m))
    return pa.RecordBatch.from_arrays([s, t, each(middle - started), each(ended - middle), pa.array(error)], ["s", "t", "low_rank_seconds", "dense_seconds", "relative_error"])


def lowrank_benchmark(factors: DataFrame, n: int, grid: Sequence[float], subjects: int = 25, seed: int = 42) -> DataFrame:
    """One row from the pairs of the first ``subjects`` in a seeded order (the sample is the operator): pairs timed and in all, median seconds a pair of
    both kernels, pairs a second, estimated hours for all pairs in one process, and the largest relative error of a distance."""
    chosen = factors.orderBy(md5_order(seed, "s"), "s").limit(subjects)
    kind = dict(factors.dtypes)["s"]
    rows = paired(chosen, "f", partial(_timed, n=n, grid=tuple(map(float, grid))), f"s {kind}, t {kind}, low_rank_seconds double, dense_seconds double, relative_error double", blocks=1)
    every = factors.agg(F.count(F.lit(1)).alias("n_subjects")).select((F.col("n_subjects") * (F.col("n_subjects") - 1) / 2).cast("long").alias("n_pairs"))
    out = rows.agg(F.count(F.lit(1)).alias("n_timed"), F.percentile("low_rank_seconds", 0.5).alias("low_rank_seconds"), F.percentile("dense_seconds", 0.5).alias("dense_seconds"), F.max("relative_error").alias("max_relative_error"), F.sum("low_rank_seconds").alias("total"))
    rate = F.try_divide(F.col("n_timed"), F.col("total"))
    return out.crossJoin(F.broadcast(every)).select("n_timed", "n_pairs", "low_rank_seconds", "dense_seconds", rate.alias("pairs_per_second"), (F.try_divide(F.col("n_pairs"), rate) / 3600).alias("hours_for_all"), "max_relative_error")

"""GEO1-GEO18: all pairs of operators, their spectra, Schatten distances and what is derived from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gramweave.functions import kernels
from gramweave.functions.masked import between, masked_pairs, masked_points, masked_sums, masks
from gramweave.functions.stats import AVERAGE_RANK, pearson, positions, quantiles_by_ranges, spearman
from gramweave.operators.cells import frobenius_distances, frobenius_sums, grid_rows, pair_points, pair_ranks, pair_sums, profile_sums, rank_one_distances, squares
from gramweave.session import stored


#: Rows of a block: a cell of two blocks has some CELL_ROWS ** 2 pairs at most.
CELL_ROWS = 10_000


def pairs(df: DataFrame, columns: Sequence[str], blocks: int = 8) -> DataFrame:
    """GEO1: every s < t once, with ``columns`` of both as <c>_s and <c>_t.

    Rows are dealt to blocks of about CELL_ROWS at most, ``blocks`` at least; a cell of the block grid is one group of an equality join, so the
    pairs spread over blocks**2 groups and no side is broadcast.
    """
    blocks = max(blocks, -(-df.count() // CELL_ROWS))
    block = F.pmod(F.xxhash64("s"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = df.select(block.alias("_b"), "s", *(F.col(c).alias(f"{c}_s") for c in columns)).withColumn("_c", every)
    right = df.select(block.alias("_c"), F.col("s").alias("t"), *(F.col(c).alias(f"{c}_t") for c in columns)).withColumn("_b", every)
    return left.join(right, ["_b", "_c"]).where("s < t").drop("_b", "_c")


def pair_count(df: DataFrame) -> DataFrame:
    """(n): how many pairs s < t GEO1 has, repeated ids too, from the places of ids in their order: no pair is made.  Ids are numbers below 2**53."""
    return positions(df, [], "s").agg(F.coalesce(F.sum(F.col("_count") * F.col("_start")), F.lit(0)).cast("long").alias("n"))


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


#: Bytes of a block's rows in ``paired``, and of the pairs that a kernel gets at a time.
BLOCK_BYTES, STEP_BYTES = 16 << 20, 8 << 20

Work = Callable[[pa.Array, np.ndarray, pa.Array, np.ndarray], pa.RecordBatch]


Side = tuple[list, np.ndarray]


def _places(left: Side, right: Side, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in left, in right) of all pairs of two lists of rows, ``step`` at a time; of one list with itself if both are the same."""
    n, m = len(left[0]), len(right[0])
    high = max(1, step // max(1, n))
    wide = max(1, min(n, step))
    for lo in range(0, m, high):
        for at in range(0, n, wide):
            k, j = (x.ravel() for x in np.meshgrid(np.arange(at, min(n, at + wide)), np.arange(lo, min(m, lo + high))))
            yield (k[k < j], j[k < j]) if left is right else (k, j)


def _asked(left: Side, right: Side, step: int, partners: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same for the pairs asked for alone: ``partners`` has each id's; what is walked is these, not the pairs of the lists."""
    place = {x: k for k, x in enumerate(left[0])}
    found = [(place[x], j) for j, own in enumerate(right[0]) for x in partners.get(own, ()) if x in place and (left is not right or place[x] < j)]
    for lo in range(0, len(found), step):
        k, j = np.array(found[lo : lo + step]).T
        yield k, j


def _stacks(left: Side, right: Side, kind: pa.DataType, work: Work, step: int, partners: dict | None) -> Iterator[pa.RecordBatch]:
    """``work`` over pairs of two lists of rows, ``step`` at a time: all, or those of ``partners``."""
    ids = pa.array(left[0] + right[0], kind)
    names, n = np.array(left[0] + right[0]), len(left[0])
    for k, j in _places(left, right, step) if partners is None else _asked(left, right, step, partners):
        if len(k):
            less = names[k] < names[n + j]
            s, t = np.where(less, k, n + j), np.where(less, n + j, k)
            one, other, first = left[1][k], right[1][j], less[:, None]
            yield work(ids.take(pa.array(s)), np.where(first, one, other), ids.take(pa.array(t)), np.where(first, other, one))


def _meet(batches: Iterator[pa.RecordBatch], column: str, work: Work, step_bytes: int, chosen: bool) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (i, j, role, s): role 0 is the cell's left block, which role 1 meets; in a cell i = j all meet all.

    ``chosen``: rows of role -1 name the pairs of the cell that are asked for.
    """
    at: tuple | None = None
    sides: tuple[list, list] = ([], [])
    left: Side | None = None
    partners: dict = {}
    kind = pa.int64()

    def step(row: np.ndarray) -> int:
        return max(1, step_bytes // max(1, 16 * row.size))

    def stacked(side: list) -> Side:
        return [x for x, _ in side], np.stack([x for _, x in side])

    def met() -> Iterator[pa.RecordBatch]:
        nonlocal left
        own, other = sides
        if own and (partners or not chosen):
            left = left or stacked(own)
            right = left if at[0] == at[1] else stacked(other) if other else None
            if right:
                yield from _stacks(left, right, kind, work, step(own[0][1]), partners if chosen else None)
        other.clear()

    for batch in batches:
        kind = batch.column("s").type
        values = batch.column(column)
        others = batch.column("t").to_pylist() if chosen else [None] * batch.num_rows
        for k, (i, j, role, s, t) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("i", "j", "role", "s")), others, strict=True)):
            if (i, j) != at:
                yield from met()
                at, left, partners = (i, j), None, {}
                sides[0].clear()
            if role < 0:
                partners.setdefault(s, set()).add(t)
                partners.setdefault(t, set()).add(s)
                continue
            row = values.slice(k, 1).flatten().to_numpy(zero_copy_only=False)
            sides[role].append((s, row))
            if role and len(sides[0]) * len(sides[1]) >= step(row):
                yield from met()
    yield from met()


def paired(df: DataFrame, column: str, work: Work, schema: str, blocks: int = 8, only: DataFrame | None = None) -> DataFrame:
    """GEO1 for kernels on arrays: ``work(s, rows of s, t, rows of t)`` over every pair s < t once, in stacks of STEP_BYTES.

    Rows are dealt to blocks of about BLOCK_BYTES and CELL_ROWS rows at most, ``blocks`` at least; a cell of the grid of blocks is a group of its own.  A row
    is sent to as many cells as there are blocks and never to a pair, and a task holds one block.  ``only`` (s, t) names the pairs to be
    worked on: a cell without any gets no rows, and in the others these pairs alone are walked.  Ids must be distinct.
    """
    size, n = df.agg(F.coalesce(F.sum(F.size(column)), F.lit(0)), F.count(F.lit(1))).first()
    blocks = max(blocks, -(-8 * size // BLOCK_BYTES), -(-n // CELL_ROWS))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda k: F.struct(F.least(k, "_b").alias("i"), F.greatest(k, "_b").alias("j")))
    rows = df.select("s", F.col(column).cast("array<double>").alias(column), block("s").alias("_b")).select("s", column, "_b", F.inline(cells))
    rows = rows.select("i", "j", (F.col("_b") != F.col("i")).cast("int").alias("role"), "s", column)
    if only is not None:
        ends = only.where("s != t").select(F.least(block("s"), block("t")).alias("i"), F.greatest(block("s"), block("t")).alias("j"), F.lit(-1).alias("role"), F.least("s", "t").alias("s"), F.greatest("s", "t").alias("t"))
        # There are at most blocks**2 cells.
        rows = rows.join(F.broadcast(ends.select("i", "j").distinct()), ["i", "j"], "left_semi").unionByName(ends, allowMissingColumns=True)
    # A number of its own, for small matrices make much work: by their bytes alone, adaptive execution would put many cells into one task.
    tasks = min(blocks * (blocks + 1) // 2, max(200, 4 * df.sparkSession.sparkContext.defaultParallelism))
    dealt = rows.repartition(tasks, "i", "j").sortWithinPartitions("i", "j", "role", "s")
    return dealt.mapInArrow(partial(_meet, column=column, work=work, step_bytes=STEP_BYTES, chosen=only is not None), schema)


def _lists(values: np.ndarray) -> pa.ListArray:
    """Rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1]), pa.int32()), pa.array(np.ascontiguousarray(values).ravel()))


def _square(a: np.ndarray) -> np.ndarray:
    n = int(round(a.shape[1] ** 0.5))
    return a.reshape(-1, n, n)


def _spectra(s: pa.Array, a: np.ndarray, t: pa.Array, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([s, t, _lists(kernels.spectrum_dense(_square(a), _square(b)))], ["s", "t", "sv"])


def spectra(operators: DataFrame, blocks: int = 8) -> DataFrame:
    """GEO2: (s, t, sv), sv the unsorted |eigenvalues| of rho_s - rho_t; all operators have one size."""
    kind = dict(operators.dtypes)["s"]
    return paired(operators, "rho", _spectra, f"s {kind}, t {kind}, sv array<double>", blocks)


def _factor_spectra(s: pa.Array, a: np.ndarray, t: pa.Array, b: np.ndarray, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([s, t, _lists(kernels.spectra_lowrank(a.reshape(len(s), n, -1), b.reshape(len(s), n, -1)))], ["s", "t", "sv"])


def factor_spectra(factors: DataFrame, n: int, blocks: int = 8) -> DataFrame:
    """GEO3: the same from row-major factors f of n rows and one rank r, rho = f f': 2r values, of which vanishing modes are 0."""
    kind = dict(factors.dtypes)["s"]
    return paired(factors, "f", partial(_factor_spectra, n=n), f"s {kind}, t {kind}, sv array<double>", blocks)


def schatten(sv: str | Column, p: Column) -> Column:
    """GEO5: (sum sigma**p)**(1/p); the largest for infinite p; an error below 1."""
    v = F.col(sv) if isinstance(sv, str) else sv
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + F.pow(x, p))
    return F.when(p < 1, F.raise_error(F.lit("Schatten distances need p >= 1"))).when(p == float("inf"), F.array_max(v)).when(p == 1, F.aggregate(v, F.lit(0.0), lambda a, x: a + x)).when(p == 2, F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))).otherwise(F.pow(total, 1 / p))


def distances(spectrum: DataFrame, grid: Sequence[float]) -> DataFrame:
    """GEO6: (p, s, t, d) for every p of the grid from one spectrum."""
    cells = F.array(*(F.struct(F.lit(float(p)).alias("p"), schatten("sv", F.lit(float(p))).alias("d")) for p in grid))
    return spectrum.select("s", "t", F.inline(cells)).select("p", "s", "t", "d")


def factor_distances(factors: DataFrame, n: int, grid: Sequence[float], blocks: int = 8) -> DataFrame:
    """GEO3, GEO6: (p, s, t, d) from factors f of n rows and one rank; those of rank one have a closed form, and no row has a spectrum."""
    width = factors.select(F.max(F.size("f"))).first()[0]
    if width == n and dict(factors.dtypes)["s"] in ("tinyint", "smallint", "int", "bigint"):
        return rank_one_distances(factors.select("s", F.col("f").cast("array<double>").alias("f")), grid, blocks)
    return distances(factor_spectra(factors, n, blocks), grid)


def both_ways(d: DataFrame) -> DataFrame:
    """GEO7: the symmetric closure (p, s, t, d), without the diagonal."""
    return d.select("p", "s", "t", "d").unionByName(d.select("p", F.col("t").alias("s"), F.col("s").alias("t"), "d"))


def frobenius(operators: DataFrame, blocks: int = 8) -> DataFrame:
    """GEO8: d_2 of every pair by the Gram identity sqrt(max(|a|^2 + |b|^2 - 2<a,b>, 0)); column rho holds vectors of one length.  Products are made
    for tiles of pairs inside their cells: no pair has a row of two matrices, and none is shuffled."""
    return frobenius_distances(operators.select("s", "rho"), blocks)


def shape_and_scale(d: DataFrame) -> DataFrame:
    """GEO10: per p, the Frobenius norm of the distance matrix; and the pairs' shares d / norm."""
    norm = d.groupBy("p").agg(F.sqrt(2 * F.sum(F.col("d") ** 2)).alias("scale"))
    return d.join(norm, "p").withColumn("shape", F.when(F.col("scale") > 0, F.col("d") / F.col("scale")).otherwise(0.0))


def _squared_distances(sigma: list[np.ndarray], grid: Sequence[float]) -> Iterator[np.ndarray]:
    for p in grid:
        d = kernels.schatten_of(sigma, p)
        yield d * d


def scales_of_operators(operators: DataFrame, grid: Sequence[float]) -> DataFrame:
    """GEO10 from the operators (s, rho) themselves: (p, scale, n), the norm of the distance matrix and the pairs, summed inside the cells of pairs."""
    found = pair_sums(operators.select("s", "rho"), partial(_squared_distances, grid=tuple(map(float, grid))))
    rows = [(float(p), float(np.sqrt(2 * found[k][1])), found[k][0]) for k, p in enumerate(grid) if k in found]
    return operators.sparkSession.createDataFrame(rows, "p double, scale double, n long")


def responses(d: DataFrame) -> DataFrame:
    """GEO11, GEO12: between adjacent p, |shape change| / dp and |change of ln scale| / dp (NULL for a zero scale)."""
    shaped = shape_and_scale(d)
    w = W.partitionBy("s", "t").orderBy("p")
    step = shaped.select("p", "scale", "shape", F.lag("p").over(w).alias("p0"), F.lag("shape").over(w).alias("shape0"), F.lag("scale").over(w).alias("scale0")).where("p0 is not null")
    dp = F.col("p") - F.col("p0")
    shape = step.groupBy("p0", "p").agg(F.sqrt(2 * F.sum((F.col("shape") - F.col("shape0")) ** 2)).alias("change"), F.min("scale").alias("scale"), F.min("scale0").alias("scale0"))
    moved = F.when((F.col("scale") > 0) & (F.col("scale0") > 0), F.abs(F.log("scale") - F.log("scale0")) / dp)
    return shape.select("p0", "p", (F.col("change") / dp).alias("shape_response"), moved.alias("scale_response"))


def subject_profiles(d: DataFrame) -> DataFrame:
    """GEO13: per subject and adjacent p, |change of the normalised distance profile| / dp."""
    full = both_ways(d)
    unit = full.withColumn("x", F.try_divide(F.col("d"), F.sqrt(F.sum(F.col("d") ** 2).over(W.partitionBy("p", "s")))))
    w = W.partitionBy("s", "t").orderBy("p")
    step = unit.select("s", "p", F.lag("p").over(w).alias("p0"), "x", F.lag("x").over(w).alias("x0")).where("p0 is not null")
    return step.groupBy("s", "p0", "p").agg((F.sqrt(F.sum((F.col("x") - F.col("x0")) ** 2)) / (F.first("p") - F.first("p0"))).alias("response"))


def subject_profiles_of_operators(operators: DataFrame, grid: Sequence[float]) -> DataFrame:
    """GEO13 from the operators (s, rho) themselves: sums by subject inside the cells of pairs, no pair is a row.

    |x - x0|^2 of two profiles of norm one is 2 - 2 <x, x0>, whose rounding moves a response by 1e-7 at most, and by far less where it isn't near 0."""
    grid = sorted(map(float, grid))
    operators = stored(operators.select("s", "rho"), "operators")
    if operators.count() < 2:
        return operators.sparkSession.createDataFrame([], f"s {dict(operators.dtypes)['s']}, p0 double, p double, response double")
    at = lambda c, i: F.get(c, F.lit(i))
    cosine = lambda i: F.try_divide(at("cross", i), F.sqrt(at("square", i)) * F.sqrt(at("square", i - 1)))
    steps = F.array(*(F.struct(F.lit(grid[i - 1]).alias("p0"), F.lit(grid[i]).alias("p"), (F.sqrt(F.greatest(2 - 2 * cosine(i), cosine(i) * 0)) / (grid[i] - grid[i - 1])).alias("response")) for i in range(1, len(grid))))
    return profile_sums(operators, grid).select("s", F.inline(steps))


def _ratios(sigma: list[np.ndarray], grid: Sequence[float], reference: float) -> Iterator[np.ndarray]:
    first = kernels.schatten_of(sigma, reference)
    with np.errstate(divide="ignore", invalid="ignore"):
        inverse = np.where(first > 0, 1.0, np.nan)
        for p in grid:
            yield (first if p == reference else kernels.schatten_of(sigma, p)) / first * inverse


def ratios_of_operators(operators: DataFrame, grid: Sequence[float], reference: float) -> DataFrame:
    """JON10: (p, s, t, ratio), every distance over the pair's at the reference, from the operators (s, rho) themselves; NULL for a distance of 0.  A pair's distances at all p
    are made together, so none is joined."""
    values = partial(_ratios, grid=tuple(map(float, grid)), reference=float(reference))
    return grid_rows(operators.select("s", "rho"), grid, values).withColumnRenamed("x", "ratio")


def cumulative_change(d: DataFrame, reference: float) -> DataFrame:
    """GEO14: per p against the reference, in per cent: scale contraction, shape change (of its maximum sqrt 2), pair rank loss."""
    shaped = shape_and_scale(stored(d, "distances"))
    ref = shaped.where(F.col("p") == reference).select("s", "t", F.col("shape").alias("shape0"), F.col("scale").alias("scale0"), F.col("d").alias("d0"))
    both = stored(shaped.join(ref, ["s", "t"]), "against-reference")
    moved = both.groupBy("p").agg((100 * (1 - F.first("scale") / F.first("scale0"))).alias("scale_contraction"), (100 * F.sqrt(2 * F.sum((F.col("shape") - F.col("shape0")) ** 2)) / 2**0.5).alias("shape_change"))
    rank = spearman(both, ["p"], "d", "d0", "rho", ranges=True).select("p", (100 * (1 - F.col("rho"))).alias("rank_loss"))
    return moved.join(rank, "p")


def _shape_changes(sigma: list[np.ndarray], scales: Sequence[tuple[float, float]], reference: tuple[float, float]) -> Iterator[np.ndarray]:
    """By (p, scale) the squared change of the pairs' shares d / scale from the reference's; a share of a zero scale is 0."""
    share = lambda p, scale: kernels.schatten_of(sigma, p) / scale if scale > 0 else np.zeros(sigma[0].shape)
    first = share(*reference)
    for p, scale in scales:
        yield (share(p, scale) - first) ** 2


def cumulative_change_of_operators(operators: DataFrame, grid: Sequence[float], reference: float) -> DataFrame:
    """GEO14 from the operators (s, rho) themselves, which have finite cells: up to SORTED_PAIRS pairs are stored and sorted, more are summed and ranked inside their cells, as in
    ``deformation_of_operators``.  The driver holds bins and the result, a row for each p."""
    operators, grid = stored(operators.select("s", "rho"), "operators"), tuple(map(float, grid))
    n = operators.count()
    if n * (n - 1) // 2 <= SORTED_PAIRS:
        return cumulative_change(distances(spectra(operators), grid), reference)
    first = grid.index(reference)
    scales = {k: float(np.sqrt(2 * x)) for k, (_, x) in pair_sums(operators, partial(_squared_distances, grid=grid)).items()}
    at = [(p, scales[k]) for k, p in enumerate(grid)]
    moved = pair_sums(operators, partial(_shape_changes, scales=at, reference=at[first]))
    ranks = pair_ranks(operators, partial(_grid_distances, grid=grid), len(grid), first)
    share = lambda x, of: x / of if of else None
    rows = []
    for k, p in enumerate(grid):
        left, rho = share(scales[k], scales[first]), ranks[k]["rho"]
        rows.append((p, None if left is None else 100 * (1 - left), float(100 * np.sqrt(2 * moved[k][1]) / 2**0.5), None if rho is None else 100 * (1 - rho)))
    return operators.sparkSession.createDataFrame(rows, "p double, scale_contraction double, shape_change double, rank_loss double")


def _leading_distances(square: list[np.ndarray], n: int, sizes: Sequence[int]) -> Iterator[np.ndarray]:
    for m in sizes:
        yield np.sqrt(sum(square[n * i + j] for i in range(m) for j in range(m)))


def preservation(operators: DataFrame, n: int, sizes: Sequence[int]) -> DataFrame:
    """SEL11: (m, spearman) of the pairs' Frobenius distances by the first m of n units with those by all, for each m of ``sizes``, from the operators (s, rho) themselves, which have
    finite cells.  Up to SORTED_PAIRS pairs are stored and sorted, more are ranked inside their cells, as in ``deformation_of_operators``."""
    operators = stored(operators.select("s", "rho"), "operators")
    count = operators.count()
    if count * (count - 1) // 2 > SORTED_PAIRS:
        found = pair_ranks(operators, partial(_leading_distances, n=n, sizes=(*sizes, n)), len(sizes) + 1, len(sizes), measure=squares)
        return operators.sparkSession.createDataFrame([(m, x["rho"]) for m, x in zip(sizes, found, strict=False)], "m int, spearman double")
    full = frobenius(operators).withColumnRenamed("d", "d0")
    cut = lambda m: operators.select("s", F.array(*(F.element_at("rho", n * i + j + 1) for i in range(m) for j in range(m))).alias("rho"))
    rows = [frobenius(cut(m)).join(full, ["s", "t"]).withColumn("m", F.lit(m)) for m in sizes]
    return spearman(stored(reduce(DataFrame.unionByName, rows), "candidates"), ["m"], "d", "d0", "spearman", ranges=True)


def heterogeneity(operators: DataFrame, blocks: int = 8) -> DataFrame:
    """GEO15: mean and root mean square of the pairs' Frobenius distances, and the root mean square about the mean operator.  Pairs are summed inside
    their cells; none is a row."""
    pair = frobenius_sums(operators.select("s", "rho"), blocks).select(F.try_divide("total", "n").alias("pair_mean"), F.sqrt(F.try_divide("square", "n")).alias("pair_rms"))
    cells = operators.select("s", F.posexplode("rho").alias("k", "v"))
    spread = cells.groupBy("k").agg(F.var_pop(F.col("v").cast("double")).alias("var")).agg(F.sqrt(F.sum("var")).alias("about_mean"))
    return pair.crossJoin(spread).withColumn("share_of_sqrt2", 100 * F.col("pair_rms") / F.lit(2**0.5))


def _deformation_of_some(d: DataFrame, reference: float, ranges: bool) -> DataFrame:
    """``deformation`` where some p lack pairs: each is compared with the reference over its own pairs."""
    first = F.max(F.when(F.col("p") == reference, F.col("d"))).over(W.partitionBy("s", "t"))
    both = stored(d.select("p", "s", "t", "d", first.alias("d0")).where("d0 is not null"), "against-reference")
    level = both.groupBy("p").agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("d").alias("mean_distance"), F.avg("d0").alias("_a"))
    level = level.join(quantiles_by_ranges(both, ["p"], ["d", "d0"], {"middle": 0.5}), "p").withColumnsRenamed({"d_middle": "median_distance", "d0_middle": "_m"})
    rho = spearman(both, ["p"], "d0", "d", "distance_spearman_vs_p1", ranges=ranges)
    ratio = F.try_divide(F.col("median_distance"), F.col("_m"))
    return level.join(rho, "p").select("p", "n_pairs", "median_distance", "mean_distance", ratio.alias("median_scale_ratio_vs_p1"), F.try_divide(F.col("mean_distance"), F.col("_a")).alias("mean_scale_ratio_vs_p1"), F.log(ratio).alias("log_median_scale_ratio_vs_p1"), "distance_spearman_vs_p1", (1 - F.col("distance_spearman_vs_p1")).alias("relational_loss"))


def deformation(d: DataFrame, reference: float, ranges: bool = True) -> DataFrame:
    """GEO16, PHC1: per p, median and mean distance, their ratios to the reference, the log ratio and 1 - Spearman against it.

    One order a p, made by ranges, gives its medians and ranks, the reference's too; the ranks of a pair at all p meet in one row.  Where some p lack pairs,
    or without ``ranges``, each p is set against the reference anew.
    """
    d = stored(d.select("p", "s", "t", F.col("d").cast("double").alias("d")).where("d is not null"), "distances")
    level = d.groupBy("p").agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("d").alias("mean_distance")).orderBy("p").collect()
    grid = [r.p for r in level]
    place = stored(positions(d, ["p"], "d").withColumn("_rank", F.expr(AVERAGE_RANK)), "places") if ranges and reference in grid else None
    if place is not None:
        at = [F.max(F.when(F.col("p") == p, F.col("_rank"))).alias(f"r{i}") for i, p in enumerate(grid)]
        wide = stored(d.join(place.select("p", "d", "_rank"), ["p", "d"]).groupBy("s", "t").agg(*at), "ranks-by-pair")
        first = grid.index(reference)
        whole = wide.agg(F.count(F.lit(1)).alias("n"), *(pearson(f"r{i}", f"r{first}", 3).alias(f"x{i}") for i in range(len(grid)))).first()
    if place is None or any(r.n_pairs != whole.n for r in level):
        return _deformation_of_some(d, reference, ranges)
    inside = lambda k: F.max(F.when((F.col("_start") <= k) & (k < F.col("_start") + F.col("_count")), F.col("d")))
    last = F.col("_total") - 1
    middle = {r.p: (r.lo + r.hi) / 2 for r in place.groupBy("p").agg(inside(F.floor(last / 2)).alias("lo"), inside(F.ceil(last / 2)).alias("hi")).collect()}
    rows = [(r.p, r.n_pairs, middle[r.p], r.mean_distance, middle[reference], level[first].mean_distance, whole[f"x{i}"]) for i, r in enumerate(level)]
    return _against_reference(d.sparkSession.createDataFrame(rows, LEVELS))


LEVELS = "p double, n_pairs long, median_distance double, mean_distance double, _m double, _a double, rho double"


def _against_reference(levels: DataFrame) -> DataFrame:
    ratio = F.try_divide(F.col("median_distance"), F.col("_m"))
    return levels.select("p", "n_pairs", "median_distance", "mean_distance", ratio.alias("median_scale_ratio_vs_p1"), F.try_divide(F.col("mean_distance"), F.col("_a")).alias("mean_scale_ratio_vs_p1"), F.log(ratio).alias("log_median_scale_ratio_vs_p1"), F.col("rho").alias("distance_spearman_vs_p1"), (1 - F.col("rho")).alias("relational_loss"))


#: Pairs at a p that ``deformation_of_operators`` stores and sorts; more are ranked inside their cells.
SORTED_PAIRS = 5_000_000


def _grid_distances(sigma: list[np.ndarray], grid: Sequence[float]) -> Iterator[np.ndarray]:
    for p in grid:
        yield kernels.schatten_of(sigma, p)


def deformation_of_operators(operators: DataFrame, grid: Sequence[float], reference: float) -> DataFrame:
    """GEO16, PHC1 from the operators (s, rho) themselves, which have finite cells.

    Up to SORTED_PAIRS pairs are stored and sorted; of more none is a row: they are ranked by passes over the cells of pairs (``cells.pair_ranks``), with exact medians, and
    with pairs tied in the Spearman correlation that share one of its bins.  The driver holds bins and the result, a row for each p.
    """
    operators = stored(operators.select("s", "rho"), "operators")
    n = operators.count()
    if n * (n - 1) // 2 <= SORTED_PAIRS:
        return deformation(distances(spectra(operators), grid), reference)
    found = pair_ranks(operators, partial(_grid_distances, grid=tuple(map(float, grid))), len(grid), list(grid).index(reference))
    first = found[list(grid).index(reference)]
    rows = [(float(p), x["n"], x["median"], x["mean"], first["median"], first["mean"], x["rho"]) for p, x in zip(grid, found, strict=True) if x["n"]]
    return _against_reference(operators.sparkSession.createDataFrame(rows, LEVELS))


#: Pairs in a row of ``packed_pairs``.
CHUNK = 1 << 16


def packed_pairs(d: DataFrame, columns: Sequence[str] = ("d",)) -> DataFrame:
    """(p, s, t, columns) as arrays of about CHUNK pairs a row, stored once: what is copied to several tasks costs its numbers alone."""
    names = ("s", "t", *columns)
    d = stored(d.select("p", *names), "distances")
    most = d.groupBy("p").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    chunk = F.pmod(F.xxhash64("s", "t"), F.lit(max(1, -(-most // CHUNK)))).alias("chunk")
    return stored(d.groupBy("p", chunk).agg(*(F.collect_list(c).alias(c) for c in names)).drop("chunk"), "packed")


def flat(rows: pd.DataFrame, columns: Sequence[str]) -> dict[str, np.ndarray]:
    """The pairs of some rows of ``packed_pairs``."""
    return {c: np.concatenate(list(rows[c])) if len(rows) else np.zeros(0) for c in columns}


def by_folds(d: DataFrame, splits: DataFrame, work: Callable[[dict[str, np.ndarray], np.ndarray, tuple], tuple], schema: str, columns: Sequence[str] = ("d",)) -> DataFrame:
    """``work(pairs, train, (p, repeat, fold))``, a row of ``schema``, for every fold of every p and repeat; ``train`` marks the pairs of which no end is held out.

    ``d`` is (p, s, t, columns), ``splits`` (repeat, fold, s): the subjects held out.  The packed distances of a p are copied for each repeat,
    not for each fold, and a task holds those of one p, as the kernel machines on them do.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def folds(key: tuple, rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        order = held.sort_values("s")
        ids, fold = order["s"].to_numpy(), order["fold"].to_numpy()
        pairs = flat(rows, ("s", "t", *columns))
        known = np.isin(pairs["s"], ids) & np.isin(pairs["t"], ids)
        if not known.any():
            return pd.DataFrame(columns=names)
        pairs = {c: x[known] for c, x in pairs.items()}
        at = [fold[np.searchsorted(ids, pairs[c])] for c in ("s", "t")]
        return pd.DataFrame([work(pairs, (at[0] != f) & (at[1] != f), (*key, f)) for f in np.unique(fold).tolist()], columns=names)

    packed = packed_pairs(d, columns)
    left = packed.crossJoin(F.broadcast(splits.select("repeat").distinct())).groupBy("p", "repeat")
    right = stored(splits.select("repeat", "fold", "s").crossJoin(F.broadcast(packed.select("p").distinct())), "held").groupBy("p", "repeat")
    return left.cogroup(right).applyInPandas(folds, schema)


def train_diagnostics(d: DataFrame, splits: DataFrame) -> DataFrame:
    """GEO17: per (p, repeat, fold), |D| of the train block, medians of d and d^2 over d > 0, and 1 / median d^2.

    ``splits`` is (repeat, fold, s): the subjects held out; all others of the repeat train.  A subject's folds in which it trains are bits, and
    a pair is in the train blocks of both its ends (``functions.masked``): no pair is copied for a fold, and none of a p meet.  The folds
    of all repeats are numbered by the driver.
    """
    folds = splits.select("repeat", "fold").distinct().orderBy("repeat", "fold").collect()
    kinds = dict(splits.dtypes)
    numbered = d.sparkSession.createDataFrame([(r.repeat, r.fold, g) for g, r in enumerate(folds)], f"repeat {kinds['repeat']}, fold {kinds['fold']}, g int")
    every = F.broadcast(numbered.withColumnRenamed("fold", "out"))
    train = splits.join(every, "repeat").where("fold <> out").select("s", "g")
    rows = d.select("p", "s", "t", "d", (F.col("d") * F.col("d")).alias("d2"), F.when(F.col("d") > 0, F.col("d")).alias("some"))
    pairs = stored(masked_pairs(rows, masks(train, len(folds))).select("p", "d2", "some", "mask"), "train-pairs")
    size = masked_sums(pairs, "p", ["d2"], len(folds)).select("p", "g", F.sqrt(2 * F.col("total")).alias("S_train"))
    square = lambda c: F.col(c) * F.col(c)
    middle = masked_points(pairs, "p", ["some"], len(folds)).select("p", "g", between("lo", "hi", "at").alias("median_d"), between(square("lo"), square("hi"), "at").alias("median_d2"))
    out = size.join(middle, ["p", "g"], "left").join(F.broadcast(numbered), "g")
    return out.select("p", "repeat", "fold", "S_train", "median_d", "median_d2", F.try_divide(F.lit(1.0), F.col("median_d2")).alias("gamma_scale"))


def train_units(subjects: DataFrame, grid: Sequence[float], splits: DataFrame) -> DataFrame:
    """(p, repeat, fold) that GEO17 has a row for: folds for which two of the ``subjects`` (s) train."""
    known = splits.join(subjects.select("s", F.lit(1).alias("known")), "s", "left")
    held = known.groupBy("repeat", "fold").agg(F.count("known").alias("n"))
    folds = held.withColumn("others", F.sum("n").over(W.partitionBy("repeat")) - F.col("n")).where("others > 1")
    return folds.select(F.explode(F.array(*(F.lit(float(p)) for p in grid))).alias("p"), "repeat", "fold")


def heterogeneity_ratio(shared: DataFrame, independent: DataFrame) -> DataFrame:
    """GEO18: (replicate, value) tables of two designs: ratio of means, and mean and deviation of the replicates' ratios."""
    both = shared.join(independent.withColumnRenamed("value", "other"), "replicate").withColumn("ratio", F.try_divide(F.col("value"), F.col("other")))
    return both.agg(F.try_divide(F.avg("value"), F.avg("other")).alias("ratio_of_means"), F.avg("ratio").alias("mean_ratio"), F.stddev_samp("ratio").alias("sd_ratio"))


def _factor_frobenius(s: pa.Array, a: np.ndarray, t: pa.Array, b: np.ndarray, n: int) -> pa.RecordBatch:
    square = lambda x, y: (np.einsum("mni,mnj->mij", x, y) ** 2).sum(axis=(1, 2))
    a, b = a.reshape(len(s), n, -1), b.reshape(len(s), n, -1)
    d = np.sqrt(np.maximum(square(a, a) + square(b, b) - 2 * square(a, b), 0))
    return pa.RecordBatch.from_arrays([s, t, pa.array(d)], ["s", "t", "d"])


def factor_frobenius(factors: DataFrame, n: int, blocks: int = 8) -> DataFrame:
    """GEO9: d_2 of every pair from Gram matrices of the factors alone."""
    kind = dict(factors.dtypes)["s"]
    return paired(factors, "f", partial(_factor_frobenius, n=n), f"s {kind}, t {kind}, d double", blocks)


def _dense_error(s: pa.Array, a: np.ndarray, t: pa.Array, b: np.ndarray, n: int) -> pa.RecordBatch:
    a, b = a.reshape(len(s), n, -1), b.reshape(len(s), n, -1)
    dense = np.sort(kernels.spectrum_dense(a @ a.transpose(0, 2, 1), b @ b.transpose(0, 2, 1)), axis=1)[:, ::-1]
    low = np.sort(kernels.spectra_lowrank(a, b), axis=1)[:, ::-1]
    wide = [np.pad(x, ((0, 0), (0, max(dense.shape[1], low.shape[1]) - x.shape[1]))) for x in (dense, low)]
    return pa.RecordBatch.from_arrays([s, t, pa.array(np.abs(wide[0] - wide[1]).max(axis=1))], ["s", "t", "max_error"])


def _dense_check(batches: Iterator[pa.RecordBatch], n: int, step: int) -> Iterator[pa.RecordBatch]:
    """GEO4 over pairs that are at hand with both factors, ``step`` at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, step):
            part = batch.slice(lo, step)
            a, b = (_matrix(part.column(c), part.num_rows) for c in ("f_s", "f_t"))
            yield _dense_error(part.column("s"), a, part.column("t"), b, n)


def dense_check(factors: DataFrame, n: int, blocks: int = 8) -> DataFrame:
    """GEO4: per pair, the largest difference between the low-rank and all n dense singular values; those that one side lacks count as 0."""
    kind = dict(factors.dtypes)["s"]
    return paired(factors, "f", partial(_dense_error, n=n), f"s {kind}, t {kind}, max_error double", blocks)


def _positive_distances(sigma: list[np.ndarray], grid: Sequence[float]) -> Iterator[np.ndarray]:
    for p in grid:
        d = kernels.schatten_of(sigma, p)
        yield np.where(d > 0, d, np.nan)


def train_diagnostics_of_operators(operators: DataFrame, grid: Sequence[float], splits: DataFrame) -> DataFrame:
    """GEO17 from the operators (s, rho) themselves: medians are found by passes over the cells of pairs (``operators.cells``), so no pair is a row or is
    stored.  The driver holds folds and the result, a row for each (p, repeat, fold)."""
    folds = [(r.repeat, r.fold) for r in splits.select("repeat", "fold").distinct().orderBy("repeat", "fold").collect()]
    kinds = dict(splits.dtypes)
    schema = f"p double, repeat {kinds['repeat']}, fold {kinds['fold']}, S_train double, median_d double, median_d2 double, gamma_scale double"
    in_fold = [F.coalesce(F.max(((F.col("repeat") == r) & (F.col("fold") != f)).cast("double")), F.lit(0.0)) for r, f in folds]
    member = splits.groupBy("s").agg((F.array(*in_fold) if folds else F.array().cast("array<double>")).alias("member"))
    rows = stored(operators.select("s", "rho").join(member, "s"), "members")
    sizes = rows.agg(*(F.sum(F.get("member", F.lit(g))).alias(f"n{g}") for g in range(len(folds)))).first() if folds else ()
    found = {(x["k"], x["g"]): x for x in pair_points(rows, partial(_positive_distances, grid=tuple(grid)), len(folds), [0.5])} if folds else {}
    out = []
    for k, p in enumerate(grid):
        for g, (repeat, fold) in enumerate(folds):
            if (sizes[g] or 0) > 1:
                own = found[k, g]
                middle = [(lo * (1 - at) + hi * at, lo * lo * (1 - at) + hi * hi * at) for lo, hi, at in own["points"]]
                d, d2 = middle[0] if middle else (None, None)
                out.append((float(p), repeat, fold, float(np.sqrt(2 * own["square"])), d, d2, 1 / d2 if d2 else None))
    return operators.sparkSession.createDataFrame(out, schema)

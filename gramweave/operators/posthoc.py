"""PHC1-PHC18 and SUM1-SUM3: mechanisms, fragility, resampling uncertainty and the summary across stages."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gramweave.functions import kernels
from gramweave.functions.stats import cosine, md5_int, robust_z, sem, spearman
from gramweave.operators import geometry
from gramweave.operators.cells import BLOCKS, Compared, distance_matrices, field_agreement, pair_ranks, pair_sums
from gramweave.operators.geometry import both_ways, by_folds, distances, spectra
from gramweave.operators.learning import kernel
from gramweave.session import stored


def _gaps_within(z: np.ndarray, x: float) -> int:
    """Pairs of sorted ``z`` that lie no further apart than ``x``, by the very differences that doubles have."""
    n = len(z)
    at = np.searchsorted(z, z + x, "right")
    # z + x is rounded, so the last one within reach may be a few places off.
    while (more := (at < n) & (z[np.minimum(at, n - 1)] - z <= x)).any():
        at = np.where(more, np.searchsorted(z, z[np.minimum(at, n - 1)], "right"), at)
    while (less := z[at - 1] - z > x).any():
        at = np.where(less, np.searchsorted(z, z[at - 1], "left"), at)
    return int((at - np.arange(1, n + 1)).sum())


def gap(z: np.ndarray, place: int) -> float:
    """The gap at a place, from 0, of all pairs' gaps |z_i - z_j| in order, found by bisection over the doubles; no pair is made."""
    z = np.sort(z)
    lo, hi = 0, int(np.array([z[-1] - z[0]]).view(np.int64)[0])
    while lo < hi:
        middle = (lo + hi) // 2
        lo, hi = (lo, middle) if _gaps_within(z, float(np.array([middle]).view(float)[0])) > place else (middle + 1, hi)
    return float(np.array([lo]).view(float)[0])


def _gap_points(rows: pd.DataFrame, points: dict[str, float]) -> pd.DataFrame:
    z = rows["z"].dropna().to_numpy(float) + 0.0
    last = len(z) * (len(z) - 1) // 2 - 1
    out: dict[str, float | None] = dict.fromkeys(points)
    for name, q in points.items():
        if last >= 0:
            at = q * last
            lo, hi = (gap(z, int(k)) for k in (np.floor(at), np.ceil(at)))
            out[name] = lo * (1 - at % 1) + hi * (at % 1)
    return pd.DataFrame({"repeat": rows["repeat"].iloc[:1], **{k: [v] for k, v in out.items()}})


def fragility(reference_scores: DataFrame, boundary: float = 0.5, near: float = 0.1) -> DataFrame:
    """PHC3, FLT11: per repeat at the reference p (rows: repeat, s, y, score), spread, class separation, share near the boundary and
    quantiles of all pairs' gaps of robust z, by selection among a repeat's sorted subjects (N log N)."""
    z = robust_z(reference_scores, ["repeat"], "score", "z")
    level = z.groupBy("repeat").agg(
        F.count(F.lit(1)).alias("n_subjects"), F.stddev_samp("score").alias("score_sd_raw"), (F.percentile("score", 0.75) - F.percentile("score", 0.25)).alias("score_iqr_raw"),
        F.abs(F.avg(F.when(F.col("y") == 1, F.col("z"))) - F.avg(F.when(F.col("y") == 0, F.col("z")))).alias("class_separation_z"), F.avg((F.abs("z") < boundary).cast("double")).alias("near_boundary_fraction_z"),
    )
    points = {"pairwise_gap_q_value_z": near, "pairwise_gap_median_z": 0.5}
    kind = dict(reference_scores.dtypes)["repeat"]
    q = stored(z.select("repeat", "z"), "z").groupBy("repeat").applyInPandas(lambda rows: _gap_points(rows, points), f"repeat {kind}, {', '.join(f'{c} double' for c in points)}")
    return level.join(q, "repeat", "left").withColumn("inverse_small_gap_z", 1 / F.greatest("pairwise_gap_q_value_z", F.lit(1e-12)))


def decision_loss(oof: DataFrame, reference: float, by: Sequence[str] = ("repeat",)) -> DataFrame:
    """PHC4 (per repeat) and PHC13 (per repeat and fold): 1 - Spearman of the scores at p against those at the reference."""
    ref = oof.where(F.col("p") == reference).select(*by, "s", F.col("score").alias("score0"))
    rho = spearman(oof.join(ref, [*by, "s"]), ["p", *by], "score", "score0", "concordance")
    return rho.withColumn("decision_loss", 1 - F.col("concordance"))


def _kernel_change(pairs: dict[str, np.ndarray], train: np.ndarray, key: tuple, gammas: dict[tuple, tuple[float, float]]) -> tuple:
    if key not in gammas or not train.any():
        return (*key, None, None)
    k, k0 = (np.exp(-g * pairs[c][train] ** 2) for c, g in zip(("d", "d0"), gammas[key], strict=True))
    rho = kernels.rank_correlation(k, k0)
    return (*key, None if rho is None else 1 - rho, float(np.abs(k - k0).mean()))


def kernel_deformation(d: DataFrame, splits: DataFrame, gammas: DataFrame, reference: float) -> DataFrame:
    """PHC5: per (p, repeat, fold), 1 - Spearman and the mean absolute change between the train pairs' kernels at the reference and at p, each with
    its own gamma (``gammas``: p, repeat, fold, gamma)."""
    ref = d.where(F.col("p") == reference).select("s", "t", F.col("d").alias("d0"))
    chosen = gammas.select("p", "repeat", "fold", F.col("gamma").cast("double").alias("gamma"))
    first = chosen.where(F.col("p") == reference).select("repeat", "fold", F.col("gamma").alias("gamma0"))
    known = {(r.p, r.repeat, r.fold): (r.gamma, r.gamma0) for r in chosen.join(first, ["repeat", "fold"]).toLocalIterator()}
    kinds = dict(splits.dtypes)
    schema = f"p double, repeat {kinds['repeat']}, fold {kinds['fold']}, kernel_relational_loss double, kernel_mean_abs_change double"
    out = by_folds(d.join(ref, ["s", "t"]), splits, partial(_kernel_change, gammas=known), schema, ("d", "d0"))
    return out.where("kernel_mean_abs_change is not null")


def _kernels(sigma: list[np.ndarray], units: Sequence[tuple[float, float]]) -> Iterator[np.ndarray]:
    for p, gamma in units:
        yield np.exp(-gamma * kernels.schatten_of(sigma, p) ** 2)


def _kernel_changes(sigma: list[np.ndarray], units: Sequence[tuple[float, float]], reference: tuple[float, float]) -> Iterator[np.ndarray]:
    first = next(_kernels(sigma, [reference]))
    for k in _kernels(sigma, units):
        yield np.abs(k - first)


def kernel_deformation_of_operators(operators: DataFrame, grid: Sequence[float], splits: DataFrame, gammas: DataFrame, reference: float) -> DataFrame:
    """PHC5 from the operators (s, rho) themselves, which have finite cells.  Up to SORTED_PAIRS pairs are stored (``kernel_deformation``); of more none is a row: the train pairs of
    each fold are ranked and summed inside their cells, values of one bin counting as tied (``cells.pair_ranks``).  The driver holds bins and a row for each (p, repeat, fold)."""
    operators = stored(operators.select("s", "rho"), "operators")
    n = operators.count()
    if n * (n - 1) // 2 <= geometry.SORTED_PAIRS:
        return kernel_deformation(stored(distances(spectra(operators), grid), "d"), splits, gammas, reference)
    chosen = {(r.repeat, r.fold, float(r.p)): float(r.gamma) for r in gammas.select("repeat", "fold", "p", "gamma").toLocalIterator() if r.gamma is not None}
    kinds, out = dict(splits.dtypes), []
    for repeat, fold in sorted({k[:2] for k in chosen}):
        units = [(float(p), chosen[repeat, fold, float(p)]) for p in grid if (repeat, fold, float(p)) in chosen]
        first = next((k for k, (p, _) in enumerate(units) if p == reference), None)
        if first is None:
            continue
        train = stored(operators.join(splits.where((F.col("repeat") == repeat) & (F.col("fold") != fold)).select("s"), "s", "left_semi"), "train")
        ranks = pair_ranks(train, partial(_kernels, units=units), len(units), first)
        change = pair_sums(train, partial(_kernel_changes, units=units, reference=units[first]))
        out += [(p, repeat, fold, None if x["rho"] is None else 1 - x["rho"], change[k][1] / change[k][0]) for k, ((p, _), x) in enumerate(zip(units, ranks, strict=True)) if x["n"]]
    return operators.sparkSession.createDataFrame(out, f"p double, repeat {kinds['repeat']}, fold {kinds['fold']}, kernel_relational_loss double, kernel_mean_abs_change double")


def means(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """PHC6, PHC15: mean, median and standard error of ``columns`` over their defined values."""
    return df.groupBy(*by).agg(*(e for c in columns for e in (F.avg(c).alias(f"{c}_mean"), F.percentile(c, 0.5).alias(f"{c}_median"), sem(c).alias(f"{c}_sem"))))


def propagation(geometry: DataFrame, decisions: DataFrame, kernels: DataFrame | None = None, explanations: DataFrame | None = None, summary: DataFrame | None = None, fragile: DataFrame | None = None) -> DataFrame:
    """PHC7: geometry and decision loss per p (inner), kernel loss, explanation loss and summary columns (left), the median fragility."""
    ds = decisions.groupBy("p").agg(F.avg("decision_loss").alias("decision_loss"), sem("decision_loss").alias("decision_loss_sem"))
    out = geometry.join(ds, "p")
    if kernels is not None:
        out = out.join(kernels.groupBy("p").agg(F.avg("kernel_relational_loss").alias("kernel_relational_loss"), sem("kernel_relational_loss").alias("kernel_relational_loss_sem"), F.avg("kernel_mean_abs_change").alias("kernel_mean_abs_change")), "p", "left")
    for more in (explanations, summary):
        if more is not None:
            out = out.join(more, "p", "left")
    if fragile is not None:
        middle = fragile.agg(*(F.percentile(c, 0.5).alias(c) for c in fragile.columns if c != "repeat"))
        out = out.crossJoin(F.broadcast(middle))
    return out


def with_decision_loss(summary: DataFrame, losses: DataFrame | None, by: Sequence[str] = ("p",)) -> DataFrame:
    """PHC16: ``summary`` with the mean decision loss of the repeats (left), if there are any, and ``decision_axis``: that mean, or the folds' own
    where no table of repeats was given."""
    if losses is None:
        return summary.withColumn("decision_axis", F.col("decision_loss_fold_mean"))
    means_ = losses.groupBy(*by).agg(F.avg("decision_loss").alias("decision_loss_repeat_mean"))
    return summary.join(means_, list(by), "left").withColumn("decision_axis", F.col("decision_loss_repeat_mean"))


def support_sets(support: DataFrame, reference: float) -> DataFrame:
    """PHC9, PHC11: per (p, repeat, fold) against the reference, Jaccard of the support sets (1 for two empty ones), cosine of the duals
    on the union with zeros for absent ones, and sizes.  ``support``: (p, repeat, fold, sv, alpha)."""
    keys = ["repeat", "fold", "sv"]
    grid = support.select("p", "repeat", "fold").distinct()
    ref = support.where(F.col("p") == reference).select(*keys, F.col("alpha").alias("alpha0"))
    wide = grid.join(ref, ["repeat", "fold"]).join(support, ["p", *keys], "full").select("p", *keys, "alpha", "alpha0")
    n = lambda c: F.count(c)
    both = F.count_if(F.col("alpha").isNotNull() & F.col("alpha0").isNotNull())
    a = wide.withColumns({"a": F.coalesce("alpha", F.lit(0.0)), "a0": F.coalesce("alpha0", F.lit(0.0))})
    out = a.groupBy("p", "repeat", "fold").agg(n("alpha").alias("n_sv"), n("alpha0").alias("n_sv_reference"), F.coalesce(F.try_divide(both.cast("double"), F.count(F.lit(1)).cast("double")), F.lit(1.0)).alias("sv_jaccard"), cosine("a", "a0").alias("dual_cosine"))
    return out.join(spearman(a, ["p", "repeat", "fold"], "a", "a0", "dual_spearman"), ["p", "repeat", "fold"], "left")


def contribution_fields(support: DataFrame, splits: DataFrame, d: DataFrame, gammas: DataFrame, reference: float) -> DataFrame:
    """PHC10, PHC12: per (p, repeat, fold), Spearman of the kernel between held-out subjects and the reference's support vectors, and
    cosine and Spearman of the fields alpha * K over held-out subjects x union of support vectors."""
    keys, fold = ["repeat", "fold", "sv"], ["p", "repeat", "fold"]
    grid = support.select(*fold).distinct()
    ref = support.where(F.col("p") == reference).select(*keys, F.col("alpha").alias("alpha0"))
    union = grid.join(ref, ["repeat", "fold"]).join(support, ["p", *keys], "full").select("p", *keys, F.coalesce("alpha", F.lit(0.0)).alias("alpha"), F.coalesce("alpha0", F.lit(0.0)).alias("alpha0"), F.col("alpha0").isNotNull().alias("in_reference"))
    full = both_ways(d).select("p", "s", F.col("t").alias("sv"), "d")
    at0 = full.where(F.col("p") == reference).select("s", "sv", F.col("d").alias("d0"))
    g0 = gammas.where(F.col("p") == reference).select("repeat", "fold", F.col("gamma").alias("gamma0"))
    rows = union.join(splits, ["repeat", "fold"]).join(full, ["p", "s", "sv"]).join(at0, ["s", "sv"]).join(gammas, fold).join(g0, ["repeat", "fold"])
    rows = rows.withColumns({"k": kernel(F.col("d"), F.col("gamma")), "k0": kernel(F.col("d0"), F.col("gamma0"))}).withColumns({"c": F.col("alpha") * F.col("k"), "c0": F.col("alpha0") * F.col("k0")})
    out = rows.groupBy(*fold).agg(cosine("c", "c0").alias("contribution_cosine"))
    for x, y, name, some in (("k", "k0", "reference_kernel_spearman", rows.where("in_reference")), ("c", "c0", "contribution_spearman", rows)):
        out = out.join(spearman(some, fold, x, y, name), fold, "left")
    return out


#: Pairs of operators whose distances ``contribution_fields_of_operators`` stores; of more, fields are ranked inside the cells of pairs.
FIELD_PAIRS = 1_000_000


def contribution_fields_of_operators(support: DataFrame, splits: DataFrame, operators: DataFrame, gammas: DataFrame, reference: float, bare: bool = True, blocks: int = BLOCKS) -> DataFrame:
    """PHC10, PHC12 from the operators (s, rho) themselves, which have finite cells; without ``bare`` the column reference_kernel_spearman is left out.

    Up to FIELD_PAIRS pairs are stored (``contribution_fields``).  Of more neither a pair nor a value of a field is a row: fields are ranked by passes over the cells of held-out subjects
    and support vectors (``cells.field_agreement``), values of one bin counting as tied.  ``support`` has one row for each (p, repeat, fold, sv), ``gammas`` one for each (p, repeat, fold).
    The driver holds a row for each (p, repeat, fold).
    """
    operators = stored(operators.select("s", "rho"), "operators")
    units = [tuple(r) for r in support.select("p", "repeat", "fold").distinct().orderBy("p", "repeat", "fold").collect()]
    grid = sorted({float(reference), *(float(p) for p, _, _ in units)})
    n = operators.count()
    if n * (n - 1) // 2 <= FIELD_PAIRS:
        out = contribution_fields(support, splits, stored(distances(spectra(operators), grid), "distances"), gammas, reference)
        return out if bare else out.drop("reference_kernel_spearman")
    spark, kinds = operators.sparkSession, dict(splits.dtypes)
    folds = sorted({u[1:] for u in units})
    chosen = {(r.p, r.repeat, r.fold): float(r.gamma) for r in gammas.select("p", "repeat", "fold", "gamma").toLocalIterator() if r.gamma is not None}
    keys = [u for u in units if u in chosen and (reference, *u[1:]) in chosen]
    in_fold = [F.coalesce(F.max(((F.col("repeat") == r) & (F.col("fold") == f)).cast("double")), F.lit(0.0)) for r, f in folds]
    in_unit = [F.coalesce(F.max(F.when((F.col("p") == p) & (F.col("repeat") == r) & (F.col("fold") == f), F.col("alpha").cast("double"))), F.lit(float("nan"))) for p, r, f in units]
    out = []
    if keys:
        held = stored(operators.join(splits.groupBy("s").agg(F.array(*in_fold).alias("member")), "s"), "held-out")
        vectors = stored(operators.join(support.groupBy(F.col("sv").alias("s")).agg(F.array(*in_unit).alias("weight")), "s"), "support-vectors")
        place = {u: i for i, u in enumerate(units)}
        asked = [Compared(grid.index(p), grid.index(reference), chosen[p, r, f], chosen[reference, r, f], folds.index((r, f)), place[p, r, f], place.get((reference, r, f), -1), b) for b in ((False, True) if bare else (False,)) for p, r, f in keys]
        found = field_agreement(held, vectors, grid, asked, blocks)
        for i, (unit, x) in enumerate(zip(keys, found, strict=False)):
            if x["n"]:
                out.append((*unit, x["cosine"], *((found[len(keys) + i]["rho"],) if bare else ()), x["rho"]))
    names = ["contribution_cosine", *(["reference_kernel_spearman"] if bare else []), "contribution_spearman"]
    return spark.createDataFrame(out, f"p double, repeat {kinds['repeat']}, fold {kinds['fold']}, {', '.join(f'{c} double' for c in names)}")


def split_invariance(rows: DataFrame) -> DataFrame:
    """PHC17: (repeat, fold, s) that not all p share; no rows if the splits are the same."""
    ps = rows.select(F.count_distinct("p").alias("ps"))
    return rows.groupBy("repeat", "fold", "s").agg(F.count_distinct("p").alias("seen")).crossJoin(F.broadcast(ps)).where("seen != ps")


def draws(subjects: DataFrame, seed: int, resamples: int, most: int = 1000) -> DataFrame:
    """PHC18: (b, slot, s): in each resample min(n, most) subjects drawn with replacement from their seeded order."""
    w = W.orderBy("s")
    numbered = subjects.select("s", (F.row_number().over(w) - 1).alias("k"))
    size = subjects.agg(F.count(F.lit(1)).alias("n"))
    slots = size.select("n", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("b")).select("n", "b", F.explode(F.sequence(F.lit(0), F.least("n", F.lit(most)).cast("int") - 1)).alias("slot"))
    return slots.withColumn("k", md5_int(seed, "b", "slot") % F.col("n")).join(numbered, "k").select("b", "slot", "s")


def _order(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of ``x`` in order, where runs of equal values begin among them, and the run of each place."""
    order = np.argsort(x, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(x[order]) > 0))
    return order, first, np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))


def _weighted(x: np.ndarray, placed: tuple[np.ndarray, np.ndarray, np.ndarray], w: np.ndarray) -> tuple[float, np.ndarray]:
    """Median, and every value's average rank, as if each stood ``w`` times."""
    order, first, run = placed
    own = np.add.reduceat(w[order], first)
    upto = np.cumsum(own)
    middle = [x[order[first[np.searchsorted(upto, k, "right")]]] for k in ((upto[-1] - 1) // 2, upto[-1] // 2)]
    ranks = np.empty(len(x))
    ranks[order] = (upto - own + (own + 1) / 2)[run]
    return (middle[0] + middle[1]) / 2, ranks


def _resamples(rows: pd.DataFrame, times: pd.DataFrame) -> pd.DataFrame:
    """All resamples of a share over one p's pairs: both orders are made once, a resample is a vector of weights."""
    out = []
    if len(rows) and len(times):
        ids = np.unique(times["s"].to_numpy())
        i, j = (np.searchsorted(ids, rows[c].to_numpy()) for c in ("s", "t"))
        d, d0 = rows["d"].to_numpy(float), rows["d0"].to_numpy(float)
        placed = _order(d), _order(d0)
        for b, own in times.groupby("b"):
            m = np.zeros(len(ids), np.int64)
            m[np.searchsorted(ids, own["s"].to_numpy())] = own["m"].to_numpy()
            w = m[i] * m[j]
            n = int(w.sum())
            if n:
                (middle, r), (middle0, r0) = _weighted(d, placed[0], w), _weighted(d0, placed[1], w)
                r, r0 = r - (n + 1) / 2, r0 - (n + 1) / 2
                spread = (w @ (r * r)) * (w @ (r0 * r0))
                rho = (w @ (r * r0)) / np.sqrt(spread) if n >= 3 and spread > 0 else None
                out.append((rows["p"].iloc[0], b, n, None if middle0 == 0 else 100 * (1 - middle / middle0), None if rho is None else 100 * (1 - rho)))
    return pd.DataFrame(out, columns=["p", "b", "n_pairs", "scale_contraction_pct", "ordering_loss_pct"])


#: Resamples that share one task's order of pairs, where they draw from all subjects.
SHARE = 50


def bootstrap(d: DataFrame, drawn: DataFrame, reference: float, most: int = 1000) -> DataFrame:
    """PHC18: per (p, b), scale contraction and ordering loss in per cent over the drawn pairs; pairs of one subject with itself fall out.

    A pair counts as often as its two subjects' copies meet, which is a weight, never a copy.  Up to ``most`` subjects (as many as a resample
    draws), SHARE resamples take the pairs of a p together; beyond, each takes the pairs that it draws.  Either way a task has no more than
    ``most`` * (``most`` - 1) / 2 pairs.
    """
    times = stored(drawn.groupBy("b", "s").agg(F.count(F.lit(1)).alias("m")), "times")
    subjects = d.select("s").union(d.select("t")).distinct().count()
    share = F.floor(F.col("b") / (SHARE if subjects <= most else 1)).alias("share")
    members = stored(times.select(share, "s").distinct(), "members")
    ref = d.where(F.col("p") == reference).select("s", "t", F.col("d").alias("d0"))
    pairs = d.select("p", "s", "t", "d").join(ref, ["s", "t"]).join(members, "s").join(members.withColumnRenamed("s", "t"), ["share", "t"]).select("p", "share", "s", "t", "d", "d0")
    grid = F.broadcast(d.select("p").distinct())
    weights = stored(times.withColumn("share", share).join(grid), "weights")
    kind = dict(times.dtypes)["b"]
    made = pairs.groupBy("p", "share").cogroup(weights.groupBy("p", "share")).applyInPandas(_resamples, f"p double, b {kind}, n_pairs long, scale_contraction_pct double, ordering_loss_pct double")
    return made


def _resample_of(rows: pd.DataFrame, grid: Sequence[float], reference: float) -> pd.DataFrame:
    """One resample at every p, from the operators of the subjects that it draws and how often it does."""
    rows = rows.sort_values("s")
    a, m = np.stack(list(rows["rho"])).astype(float), rows["m"].to_numpy(np.int64)
    i, j = np.triu_indices(len(a), 1)
    w, upper, out = m[i] * m[j], np.triu(np.ones((len(a), len(a)), bool), 1), []
    if n := int(w.sum()):
        first, *others = (x[upper] for x in distance_matrices(a, [reference, *grid]))
        middle0, r0 = _weighted(first, _order(first), w)
        r0 = r0 - (n + 1) / 2
        for p, d in zip(grid, others, strict=True):
            middle, r = _weighted(d, _order(d), w)
            r = r - (n + 1) / 2
            spread = (w @ (r * r)) * (w @ (r0 * r0))
            rho = (w @ (r * r0)) / np.sqrt(spread) if n >= 3 and spread > 0 else None
            out.append((p, rows["b"].iloc[0], n, None if middle0 == 0 else 100 * (1 - middle / middle0), None if rho is None else 100 * (1 - rho)))
    return pd.DataFrame(out, columns=["p", "b", "n_pairs", "scale_contraction_pct", "ordering_loss_pct"])


def bootstrap_of_operators(operators: DataFrame, drawn: DataFrame, grid: Sequence[float], reference: float) -> DataFrame:
    """``bootstrap`` from the operators (s, rho) themselves: a resample's task gets those of the subjects that it draws, and makes their pairs, so no pair is a row.  What is shuffled
    grows with the resamples and what each draws (``draws``: 1000 subjects at most), not with the subjects."""
    times = drawn.groupBy("b", "s").agg(F.count(F.lit(1)).alias("m"))
    rows = times.join(operators.select("s", "rho"), "s")
    tasks = max(200, 4 * operators.sparkSession.sparkContext.defaultParallelism)
    work = partial(_resample_of, grid=tuple(map(float, grid)), reference=float(reference))
    # A number of its own: by their bytes, adaptive execution would put many resamples into one task.
    return rows.repartition(tasks, "b").groupBy("b").applyInPandas(lambda own: work(own), f"p double, b {dict(drawn.dtypes)['b']}, n_pairs long, scale_contraction_pct double, ordering_loss_pct double")


def bootstrap_intervals(resamples: DataFrame) -> DataFrame:
    """PHC18: per p, the 95 per cent percentile intervals."""
    cells = [F.percentile(c, q).alias(f"{c}_{n}") for c in ("scale_contraction_pct", "ordering_loss_pct") for n, q in (("low", 0.025), ("high", 0.975))]
    return resamples.groupBy("p").agg(F.count(F.lit(1)).alias("n_resamples"), *cells)


def merged(stages: Sequence[DataFrame], key: str = "p") -> DataFrame:
    """SUM1, FLT17: full outer join of stage tables on p; a repeated p collapses to medians of its numbers, and a column whose name is taken gets
    the suffix _stage<columns so far>."""

    def single(df: DataFrame) -> DataFrame:
        numbers = [f.name for f in df.schema.fields if f.name != key and f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte", "decimal")]
        if df.groupBy(key).count().where("count > 1").isEmpty():
            return df
        return df.groupBy(key).agg(*(F.percentile(c, 0.5).alias(c) for c in numbers))

    def join(left: DataFrame, right: DataFrame) -> DataFrame:
        taken = set(left.columns)
        renamed = right.select(key, *(F.col(c).alias(f"{c}_stage{len(taken)}" if c in taken else c) for c in right.columns if c != key))
        return left.join(renamed, key, "full")

    return reduce(join, map(single, stages)).orderBy(key)


#: Columns of the fingerprint and the names that may hold them, first come first.
ALIASES = {
    "auc_heldout": ("test_oof_auc_repeat_median", "oof_auc_repeat_median", "test_auc_median", "pooled_oof_auc_median", "test_auc"),
    "gamma_star": ("gamma_repeat_median", "best_gamma_median", "gamma_median", "best_gamma"),
    "Q_typical": ("Q_kernel_repeat_median", "Q_median", "effective_Q_median", "Q"),
    "decision_concordance": ("decision_spearman_vs_p1", "spearman_vs_p1_subject_median", "spearman_vs_p1"),
    "xai_concordance": ("xai_subject_spearman_median_vs_p1",),
    "leading_mode_share": ("leading_share_resample_median", "leading_share_median_pair"),
}


def resolved(columns: Sequence[str], names: Sequence[str]) -> Column:
    """FLT16: the first of ``names`` among ``columns``; NULL without one."""
    found = next((n for n in names if n in columns), None)
    return F.col(found) if found else F.lit(None).cast("double")


def fingerprint(table: DataFrame) -> DataFrame:
    """SUM2: one row per p, with losses 1 - concordance."""
    out = table.select("p", *(resolved(table.columns, names).alias(c) for c, names in ALIASES.items()))
    return out.withColumns({"decision_loss": 1 - F.col("decision_concordance"), "xai_loss": 1 - F.col("xai_concordance")})


def compare(new: DataFrame, old: DataFrame, rtol: float = 1e-8, atol: float = 1e-10) -> DataFrame:
    """SUM3: per column, whether the p grids agree, the largest difference where both are defined, and whether all are close (both undefined counts)."""
    columns = [c for c in new.columns if c != "p" and c in old.columns]
    both = new.select("p", *(F.col(c).alias(f"a_{c}") for c in columns), F.lit(True).alias("in_a")).join(old.select("p", *(F.col(c).alias(f"b_{c}") for c in columns), F.lit(True).alias("in_b")), "p", "full")
    grid = F.bool_and(F.coalesce(F.col("in_a") & F.col("in_b"), F.lit(False)))
    close = lambda c: F.coalesce(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) <= atol + rtol * F.abs(f"b_{c}"), F.col(f"a_{c}").isNull() & F.col(f"b_{c}").isNull())
    cells = [F.struct(F.lit(c).alias("name"), F.max(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}"))).alias("max_abs_diff"), F.bool_and(close(c)).alias("all_close"), grid.alias("same_grid")) for c in columns]
    return both.agg(F.array(*cells).alias("x")).select(F.inline("x"))

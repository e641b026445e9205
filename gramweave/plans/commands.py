"""The command line's commands: each takes Parquet tables of an earlier step and gives one table."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramweave.functions.stats import spearman
from gramweave.operators import construct, decision, geometry, posthoc, selection, spectral
from gramweave.plans.pipeline import Config, run
from gramweave.session import stored
from gramweave.sources import checkpoints
from gramweave.sources.writers import manifest, report, text_report


def settings(path: str) -> dict[str, Any]:
    """A configuration as JSON or YAML."""
    with open(path) as f:
        if path.endswith(".json"):
            return json.load(f)
        import yaml

        return yaml.safe_load(f)


def compare(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Two fingerprints: per column the largest difference and whether all values are close."""
    return posthoc.compare(spark.read.parquet(a.new), spark.read.parquet(a.old))


def spectral_summary(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Concentration of pair spectra per p, with resampling intervals over the subjects."""
    metrics = stored(spectral.concentration(spectral.relative_powers(spark.read.parquet(a.spectra), a.p)), "metrics")
    chosen = spectral.selections(spark.read.parquet(a.subjects), a.seed, a.resamples, a.fraction)
    return spectral.with_intervals(spectral.summary(metrics), spectral.resampled(metrics, chosen))


def decision_summary(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Decisions per p against the reference p, from held-out scores."""
    return decision.against_reference(stored(spark.read.parquet(a.oof), "oof"), a.reference)


def fold_scores(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Held-out (or train) scores of stored folds."""
    arrays = checkpoints.fold_arrays(spark, a.root, len(a.p), a.folds * a.repeats)
    return checkpoints.fold_scores(arrays, tuple(a.p), a.folds, a.part)


def deformation(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Distances per p against the reference p."""
    return geometry.deformation(spark.read.parquet(a.distances), a.reference)


def propagation(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Geometry and decision loss side by side per p."""
    oof = stored(spark.read.parquet(a.oof), "oof")
    return posthoc.propagation(deformation(spark, a), posthoc.decision_loss(oof, a.reference))


def uncertainty(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Bootstrap intervals of scale contraction and ordering loss per p."""
    d = stored(spark.read.parquet(a.distances), "d")
    subjects = d.selectExpr("s").union(d.selectExpr("t")).distinct()
    return posthoc.bootstrap_intervals(posthoc.bootstrap(d, posthoc.draws(subjects, a.seed, a.draws), a.reference))


def genes(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Eligible genes of sparse counts (cell, gene, count), donors (cell, donor) weighing alike, ranked by variance, Fano factor and residual."""
    cells = spark.read.parquet(a.cells)
    values = construct.log_normalised(spark.read.parquet(a.counts), a.scale) if a.normalise else spark.read.parquet(a.counts).withColumnRenamed("count", "x")
    rows = stored(selection.eligible(selection.gene_statistics(selection.group_statistics(values, cells), cells), a.prevalence, a.detection), "eligible")
    scored = stored(rows.join(selection.hvg_residual(rows), "gene"), "scored")
    ranked = [selection.ranking(scored.select("gene", F.col(c).alias("score")), "gene", "score").withColumn("method", F.lit(c)) for c in ("variance", "fano", "hvg_residual")]
    return reduce(DataFrame.unionByName, ranked).select("method", "gene", "score", "rank")


def sensors(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Scores of the units of series (s, unit, t, value) within and between observations, ranked by both together."""
    scores = stored(selection.sensor_scores(spark.read.parquet(a.series)), "sensors")
    return scores.join(selection.ranking(scores, "unit", "combined").select("unit", "rank"), "unit")


def sweep(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Rank and conditioning of the leading blocks of operators (s, n, a), units in ranking order, and the number of units recommended."""
    return selection.recommendation(selection.dimension_sweep(spark.read.parquet(a.operators), a.sizes))


def preservation(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Per p, rank correlation of a candidate's pair distances (p, s, t, d) with those of the full representation."""
    full = spark.read.parquet(a.full).select("p", "s", "t", F.col("d").alias("d0"))
    both = stored(spark.read.parquet(a.candidate).join(full, ["p", "s", "t"]), "both")
    return spearman(both, ["p"], "d", "d0", "spearman", ranges=True)


def mechanism(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Support vectors (p, repeat, fold, sv, alpha) against those at the reference p: overlap, and cosine and rank correlation of the duals."""
    return posthoc.support_sets(stored(spark.read.parquet(a.support), "support"), a.reference)


def threshold(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """From a spectral summary, the first p whose leading share reaches a level."""
    return spectral.dominance(spark.read.parquet(a.summary), a.level)


#: Rows of a table that are printed; of longer ones their number is.
PRINTED = 200

#: Arguments by command: names of tables or folders that must be given, and options with their defaults.
COMMANDS: dict[str, tuple[Callable[[SparkSession, argparse.Namespace], DataFrame], tuple[str, ...], dict[str, Any]]] = {
    "compare": (compare, ("new", "old"), {}),
    "spectral": (spectral_summary, ("spectra", "subjects"), {"p": Config.grid, "seed": 42, "resamples": 300, "fraction": 0.8}),
    "decision": (decision_summary, ("oof",), {"reference": 1.0}),
    "folds": (fold_scores, ("root",), {"p": Config.grid, "folds": 5, "repeats": 20, "part": "test"}),
    "deformation": (deformation, ("distances",), {"reference": 1.0}),
    "propagation": (propagation, ("distances", "oof"), {"reference": 1.0}),
    "genes": (genes, ("counts", "cells"), {"scale": 1e4, "prevalence": 0.9, "detection": 0.02, "normalise": 1}),
    "sensors": (sensors, ("series",), {}),
    "sweep": (sweep, ("operators",), {"sizes": (64, 128, 256, 512, 1000)}),
    "preservation": (preservation, ("candidate", "full"), {}),
    "mechanism": (mechanism, ("support",), {"reference": 1.0}),
    "threshold": (threshold, ("summary",), {"level": 0.5}),
    "uncertainty": (uncertainty, ("distances",), {"reference": 1.0, "seed": 42, "draws": 500}),
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(description="Commands over tables of an earlier step; 'pipeline' makes them all.")
    kinds = out.add_subparsers(dest="command", required=True)
    whole = kinds.add_parser("pipeline", help="the configured stages from operators, factors or spectra")
    for name in ("config", "subjects", "output"):
        whole.add_argument(f"--{name}", required=True)
    whole.add_argument("--operators", help="(s, n, rho), or (s, f) with --factor-rows")
    whole.add_argument("--factor-rows", type=int, default=0)
    whole.add_argument("--spectra", help="(s, t, sv) of an earlier run")
    for name, (f, needed, options) in COMMANDS.items():
        one = kinds.add_parser(name, help=f.__doc__)
        for x in needed:
            one.add_argument(f"--{x}", required=True)
        for x, value in options.items():
            many = isinstance(value, tuple)
            one.add_argument(f"--{x}", type=type(value[0] if many else value), nargs="+" if many else None, default=value)
        one.add_argument("--output", help="folder of the table as Parquet")
        one.add_argument("--text", help="folder of the table as a text report")
    return out


def execute(spark: SparkSession, arguments: list[str]) -> dict[str, DataFrame]:
    """Runs a command and writes its table where ``--output`` and ``--text`` say; short tables are printed as JSON lines, of others the number of rows.

    The pipeline also leaves a manifest: its tables, their rows and the configuration's key."""
    a = parser().parse_args(arguments)
    read = lambda path: spark.read.parquet(path) if path else None
    if a.command == "pipeline":
        config = Config.load(settings(a.config))
        made = run(spark, a.output, config, read(a.operators), spark.read.parquet(a.subjects), a.factor_rows, read(a.spectra))
    else:
        df = COMMANDS[a.command][0](spark, a)
        if a.output:
            df.write.mode("overwrite").parquet(a.output)
            df = spark.read.parquet(a.output)
        elif a.text:
            df = stored(df, a.command)
        if a.text:
            text_report(df, a.text)
        made = {a.command: df}
    rows = {name: df.count() for name, df in made.items()}
    for name, df in made.items():
        print(name, report(df) if rows[name] <= PRINTED else f"{rows[name]} rows", sep="\n")
    if a.command == "pipeline":
        manifest(spark.createDataFrame([(config.name, config.key, name, n) for name, n in rows.items()], "dataset string, key string, stage string, rows long"), f"{a.output.rstrip('/')}/{config.name}-{config.key}/manifest")
    return made

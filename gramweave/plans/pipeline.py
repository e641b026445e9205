"""The five stages, from density operators to one fingerprint row per p; each stage's tables are kept under its folder, and a run
with the same configuration takes up what is already there.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramweave.functions.stats import roc_auc
from gramweave.operators import decision, explain, geometry, learning, posthoc, spectral
from gramweave.session import scratch
from gramweave.sources.writers import by_units, configuration_hash, try_read

#: Fits that a broken run can lose.
FITS = 64
STAGES = ("classifier", "spectral", "decision", "xai", "summary")


@dataclass(frozen=True)
class Config:
    """What a run depends on; any change names another folder."""

    name: str
    grid: tuple[float, ...] = (1.0, 1.25, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0, 16.0)
    reference: float = 1.0
    folds: int = 5
    repeats: int = 20
    seed: int = 42
    machine: learning.Grid = field(default_factory=learning.Grid)
    resamples: int = 300
    fraction: float = 0.8
    stages: tuple[str, ...] = STAGES

    @staticmethod
    def load(settings: Mapping[str, Any]) -> Config:
        """From nested settings as a YAML or JSON file gives them; unknown stages and a grid without its reference are errors."""
        science, cv, model = (settings.get(k, {}) for k in ("science", "cv", "model"))
        machine = learning.Grid(**{k: tuple(map(float, model[old])) for k, old in (("gammas", "gamma_values"), ("penalties", "C_values")) if old in model}, inner=int(cv.get("inner_folds", 5)), seed=int(cv.get("random_state", 42)))
        out = Config(
            settings["dataset"]["name"], tuple(map(float, science.get("p_values", Config.grid))), float(science.get("reference_p", 1.0)), int(cv.get("outer_folds", 5)), int(cv.get("repeats", 20)), int(cv.get("random_state", 42)), machine,
            int(settings.get("spectral", {}).get("n_resamples", 300)), float(settings.get("spectral", {}).get("fraction", 0.8)), tuple(settings.get("pipeline", {}).get("stages", STAGES)),
        )
        if set(out.stages) - set(STAGES):
            raise ValueError(f"unknown stages: {sorted(set(out.stages) - set(STAGES))}")
        if out.reference not in out.grid or min(out.grid) < 1:
            raise ValueError("every p must be 1 or more, and the reference one of them")
        return out

    @property
    def key(self) -> str:
        return configuration_hash(asdict(self) | {"stages": None})


class Run:
    """Tables of a run under ``folder``/<name>-<hash>/<stage>/<table>, made when first asked for."""

    def __init__(self, spark: SparkSession, folder: str, config: Config, operators: DataFrame | None, subjects: DataFrame, factor_rows: int = 0, spectra: DataFrame | None = None):
        if operators is None and spectra is None:
            raise ValueError("operators, factors or spectra are needed")
        if operators is None and "xai" in config.stages:
            raise ValueError("explanations need operators or factors")
        self.spark, self.config, self.operators, self.subjects = spark, config, operators, subjects
        self.factor_rows, self.known = factor_rows, spectra
        self.root = f"{folder.rstrip('/')}/{config.name}-{config.key}"

    def path(self, stage: str, name: str) -> str:
        return f"{self.root}/{1 + STAGES.index(stage):02d}_{stage}/{name}"

    def kept(self, stage: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        path = self.path(stage, name)
        found = try_read(self.spark, path)
        if found is None:
            with scratch(self.spark):
                make().write.mode("overwrite").parquet(path)
            found = self.spark.read.parquet(path)
        return found

    @property
    def spectra(self) -> DataFrame:
        def make() -> DataFrame:
            if self.known is not None:
                return self.known
            return geometry.factor_spectra(self.operators, self.factor_rows) if self.factor_rows else geometry.spectra(self.operators)

        return self.kept("classifier", "spectra", make)

    @property
    def distances(self) -> DataFrame:
        return self.kept("classifier", "distances", lambda: geometry.distances(self.spectra, self.config.grid))

    @property
    def splits(self) -> DataFrame:
        c = self.config
        return self.kept("classifier", "splits", lambda: learning.stratified_folds(self.subjects, c.folds, c.repeats, c.seed))

    @property
    def fits(self) -> DataFrame:
        """All fits, made FITS at a time: a run that broke off goes on at the first batch that it had not written."""
        packed = self.kept("classifier", "packed", lambda: geometry.packed_pairs(self.distances.withColumns({c: F.col(c).cast("long") for c in ("s", "t")})))
        fit = lambda units: learning.nested_cv(self.distances, self.subjects, self.splits, self.config.machine, only=units, packed=packed.join(F.broadcast(units.select("p").distinct()), "p"))
        return by_units(learning.fold_units(packed, self.splits), self.path("classifier", "fits"), learning.FOLD_SCHEMA, fit, FITS)

    @property
    def oof(self) -> DataFrame:
        return self.kept("classifier", "oof", lambda: learning.oof(self.fits))

    @property
    def repeats(self) -> DataFrame:
        def make() -> DataFrame:
            keys, c = ["p", "repeat", "fold"], self.config
            rows = self.fits.select(*keys, "gamma", "c", "inner_auc", (F.col("gamma") == min(c.machine.gammas)).alias("at_lower"), (F.col("gamma") == max(c.machine.gammas)).alias("at_upper"))
            rows = rows.join(geometry.train_diagnostics(self.distances, self.splits), keys).join(roc_auc(self.oof, keys, "y", "score", "test_auc"), keys, "left")
            return learning.with_pooled_auc(learning.repeat_summary(rows), self.oof)

        return self.kept("classifier", "repeats", make)

    def spectral(self) -> DataFrame:
        def make() -> DataFrame:
            metrics = self.kept("spectral", "metrics", lambda: spectral.concentration(spectral.relative_powers(self.spectra, self.config.grid)))
            chosen = spectral.selections(self.subjects, self.config.seed, self.config.resamples, self.config.fraction)
            return spectral.with_intervals(spectral.summary(metrics), spectral.resampled(metrics, chosen))

        return self.kept("spectral", "summary", make)

    def decision(self) -> DataFrame:
        return self.kept("decision", "summary", lambda: decision.against_reference(self.oof, self.config.reference))

    def xai(self) -> DataFrame:
        def make() -> DataFrame:
            rows = learning.scores(self.fits).where("not test and abs(dual) > 1e-12")
            support = rows.select("p", "repeat", "fold", F.col("s").alias("sv"), F.col("dual").alias("alpha")).join(self.fits.select("p", "repeat", "fold", "gamma"), ["p", "repeat", "fold"])
            need = explain.needed_pairs(support, self.splits)
            parts = self.kept("xai", "contributions", lambda: explain.node_contributions(self.operators, self.config.grid, self.factor_rows, need))
            profiles = self.kept("xai", "profiles", lambda: explain.subject_profiles(explain.importance(parts, support, self.splits)))
            self.kept("xai", "population", lambda: explain.population_profiles(profiles, self.subjects))
            return explain.decision_comparison(self.decision(), explain.concordance(profiles, self.config.reference))

        return self.kept("xai", "comparison", make)

    def summary(self) -> DataFrame:
        def make() -> DataFrame:
            c = learning.across_repeats(self.repeats, ["gamma_repeat", "Q_kernel_repeat", "test_oof_auc_repeat"])
            d = self.decision().select("p", F.col("spearman").alias("decision_spearman_vs_p1"))
            x = self.xai().select("p", F.col("spearman_vs_p1_median").alias("xai_subject_spearman_median_vs_p1"))
            return posthoc.fingerprint(posthoc.merged([c, self.spectral(), d, x]))

        return self.kept("summary", "fingerprint", make)


def run(spark: SparkSession, folder: str, config: Config, operators: DataFrame | None, subjects: DataFrame, factor_rows: int = 0, spectra: DataFrame | None = None) -> dict[str, DataFrame]:
    """The configured stages' main tables; ``operators`` is (s, n, rho), or (s, f) of factors with ``factor_rows`` rows, ``subjects`` (s, y).

    ``spectra`` (s, t, sv) of an earlier run takes the place of the pairs' eigenvalues; without operators there are no explanations.
    """
    job = Run(spark, folder, config, operators, subjects, factor_rows, spectra)
    make: dict[str, Callable[[], DataFrame]] = {"classifier": lambda: job.repeats, "spectral": job.spectral, "decision": job.decision, "xai": job.xai, "summary": job.summary}
    return {stage: make[stage]() for stage in config.stages}

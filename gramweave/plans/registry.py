"""Queries by name, with their DuckDB SQL where there is one; doubles are rounded alike on both sides."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles to so many decimals, never -0.0."""
    return df.select(*((F.round(c, digits) + 0.0).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes))


def query(body: str | None = None, doubles: Sequence[str] = (), ctes: str = "", digits: int = DIGITS) -> Callable[[Callable[[SparkSession, str], DataFrame]], Callable[[SparkSession, str], DataFrame]]:
    """Registers a query under its function's name; ``body`` is the SQL after ``ctes``."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        if body is not None:
            shown = ", ".join(f"round({c}, {digits}) + 0.0 as {c}" for c in doubles)
            ORACLES[f.__name__] = (f"with {ctes} " if ctes else "") + (f"select * replace ({shown}) from ({body})" if shown else body)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""What the jobs share: configurations, the command line and counts for the log."""

from __future__ import annotations

import argparse
import logging
from collections.abc import Callable, Mapping
from pathlib import Path
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gramweave.session import session

log = logging.getLogger("gramweave.jobs")
Config = Mapping[str, Any]


def configuration(spark: SparkSession, path: str, **given: Any) -> dict[str, Any]:
    """The settings of a JSON file that Spark can read, with those ``given`` (not None) in their place."""
    row = spark.read.option("multiLine", True).json(path).first()
    if row is None:
        raise ValueError(f"no settings in {path}")
    return row.asDict(recursive=True) | {k: v for k, v in given.items() if v is not None}


def own_configuration(spark: SparkSession, module: str, **given: Any) -> dict[str, Any]:
    """The settings in the file beside a job."""
    return configuration(spark, Path(module).with_suffix(".json").resolve().as_uri(), **given)


class Tally:
    """Counts that a table's first complete run leaves: rows, and others by name; no pass of their own."""

    def __init__(self, name: str, **more: Column):
        self.seen, self.columns = Observation(name), {"rows": F.count(F.lit(1)), **more}

    def of(self, df: DataFrame) -> DataFrame:
        return df.observe(self.seen, *(c.alias(k) for k, c in self.columns.items()))

    @property
    def counts(self) -> dict[str, int]:
        try:
            return self.seen.get
        except Py4JJavaError:  # a plan without rows is replaced at run time, and its counts with it
            return dict.fromkeys(self.columns, 0)


def command_line(module: str, text: str, paths: Mapping[str, str], run: Callable[[SparkSession, Config], DataFrame]) -> None:
    """Runs a job with paths and a configuration from the command line, in a session of its own."""
    parser = argparse.ArgumentParser(description=text)
    parser.add_argument("--config", help="JSON file; default: the one beside the job")
    for name, say in paths.items():
        parser.add_argument(f"--{name}", required=True, help=say)
    given = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = session(f"gramweave-{Path(module).stem}")
    try:
        path = given.pop("config") or Path(module).with_suffix(".json").resolve().as_uri()
        run(spark, configuration(spark, path, **given))
    finally:
        spark.stop()

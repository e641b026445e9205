"""Raw measurements to the geometry of a population: one row per p and subject.

Each subject's measurements become a correlation operator; matrices that fail the quality rules leave with a reason; all pairs that remain are
compared by Schatten-p distances for every p of the grid.  What is written says how far each subject lies from the others, from its own class and
from the other one, so outliers and the separation of the classes can be followed over p.  Every run writes the whole table anew, so a
broken run is repaired by the next; numbers are rounded, so the order of sums does not show.

    python -m jobs.population_geometry --measurements lineitem.parquet --subjects supplier.parquet --output geometry
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramweave.operators import cells, construct
from gramweave.session import scratch, stored
from jobs.common import Config, Tally, command_line, log

DIGITS = 9


def judged(spark: SparkSession, c: Config) -> DataFrame:
    """(s, y, n, a, reason) of every subject of either table: class, packed matrix, and why it has no place in the geometry (null: it has)."""
    reader = spark.read.format(c["format"])
    key, units = c["subject"], c["units"]
    tally = Tally("measurements", without=F.count_if(F.col(key).isNull()))
    rows = tally.of(reader.load(c["measurements"]).select(F.col(key), *(F.col(u).cast("double") for u in units)))
    matrices = construct.quality_control(construct.correlation(rows.where(F.col(key).isNotNull()), key, units), len(units)).select("s", "n", "a", "reason")
    people = reader.load(c["subjects"]).select(F.col(c["subject_key"]).alias("s"), F.col(c["label"]).cast("double").alias("label"))
    people = people.where("s is not null").groupBy("s").agg(F.max("label").alias("label"))
    cut = people.agg(F.percentile("label", c["label_quantile"]).alias("cut"))
    classes = people.crossJoin(F.broadcast(cut)).select("s", (F.col("label") >= F.col("cut")).cast("int").alias("y"), F.lit(True).alias("known"))
    why = F.when(F.col("known").isNull(), "no subject").when(F.col("n").isNull(), "no measurements").when(F.col("y").isNull(), "no label").otherwise(F.col("reason"))
    out = stored(matrices.join(classes, "s", "full").select("s", "y", "n", "a", why.alias("reason")), "judged")
    log.info("read %(rows)d measurements, %(without)d without a subject", tally.counts)
    return out


def subject_rows(subjects: DataFrame, grid: list[float]) -> DataFrame:
    """Per p and subject: its pairs, and its distances to all, to its own class and to the other."""
    kept = subjects.where("reason is null")
    classes = kept.select("s", "y")
    # Sums by the other end's class, made where the pairs are met; a subject's distance of 0 to itself is among its own class's.
    members = stored(construct.density(kept.select("s", "n", "a")).join(classes.select("s", F.array(F.col("y").cast("double")).alias("member")), "s").select("s", "rho", "member"), "members")
    sums = cells.subject_sums(members, grid, 2)
    sizes = {r.y: r.n for r in classes.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    at = lambda c, k: F.get(c, k)
    both = lambda c: at(c, F.lit(0)) + at(c, F.lit(1))
    size = lambda k: F.get(F.array(*(F.lit(sizes.get(i, 0)) for i in (0, 1))), k)
    own, other, k = F.col("y"), 1 - F.col("y"), F.lit(sum(sizes.values()) - 1)
    rows = sums.join(classes, "s").where(k > 0).select(
        "p", "s", k.cast("long").alias("n_pairs"), (both("total") / k).alias("mean_distance"), F.sqrt(both("square") / k).alias("rms_distance"), F.array_max("most").alias("max_distance"),
        F.try_divide(at("total", own), size(own) - 1).alias("own_class"), F.try_divide(at("total", other), size(other)).alias("other_class"),
    )
    # Kept, for the sort by ranges looks at its input twice, and the pairs should be met once.
    rows = stored(rows.withColumn("margin", F.col("other_class") - F.col("own_class")), "subject-rows")
    every = subjects.select(F.explode(F.array(*(F.lit(float(p)) for p in grid))).alias("p"), "s", "y", "reason")
    out = every.join(rows, ["p", "s"], "left").withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0)))
    return out.select(*((F.round(c, DIGITS) + 0.0).alias(c) if kind == "double" else F.col(c) for c, kind in out.dtypes))


def run(spark: SparkSession, c: Config) -> DataFrame:
    """Writes the table (p, s, y, reason, n_pairs, mean_distance, rms_distance, max_distance, own_class, other_class, margin), a folder for each p, and gives it read back.

    A subject in both tables with a label and a sound matrix takes part; any other has a reason and no numbers.  Measurements without a
    subject are counted in the log and left out.  Of repeated subjects the largest label counts.  Empty tables give an empty table.
    """
    with scratch(spark):
        subjects = judged(spark, c)
        for r in subjects.groupBy("reason").count().orderBy("reason").toLocalIterator():
            log.info("%d subjects: %s", r["count"], r["reason"] or "kept")
        tally = Tally("geometry")
        # Counted behind the sort, for the same reason.
        made = tally.of(subject_rows(subjects, c["grid"]).repartitionByRange("p", "s").sortWithinPartitions("p", "s"))
        made.write.mode("overwrite").partitionBy("p").parquet(c["output"])
    log.info("wrote %d rows to %s", tally.counts["rows"], c["output"])
    return spark.read.schema(made.schema).parquet(c["output"])


if __name__ == "__main__":
    command_line(__file__, "Raw measurements to the geometry of a population", {"measurements": "table with a subject column and the units", "subjects": "table with a key and a label", "output": "folder"}, run)

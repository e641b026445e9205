"""Unsupervised choice of features from a growing corpus, without reading a document twice.

Documents are cells, their tokens genes, their sources donors.  A file stream takes the files that are new, and each of its batches leaves the
sums of its own documents (SEL1), which add up over batches.  Then all sums are merged, sources weigh alike, and the eligible features are ranked by
variance, Fano factor and residual of the variance on the mean.

``state`` holds the stream's checkpoint and the batches' sums; they belong together.  A batch that is run again overwrites its own folder, and the ranking is always
written whole from the sums, so a run that broke off anywhere is repaired by the next.  Files are added to the input, not changed.

    python -m jobs.feature_selection --documents corpus/ --state state --output ranking
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramweave.operators import construct, selection
from gramweave.session import scratch, stored
from jobs.common import Config, Tally, command_line, log

DIGITS = 9
PARTS = {"sums": "donor string, gene string, sum_x double, sum_x2 double, detected long", "cells": "donor string, n_cells long"}
METHODS = ("variance", "fano", "hvg_residual")


def document_values(docs: DataFrame, scale: float) -> DataFrame:
    """(donor, gene, x): the log-normalised count of each distinct token of each document (donor, text); a document is one row, so nothing is shuffled."""
    counts = construct.word_counts(docs, ["donor"])
    return construct.log_normalised(counts, scale, "library").select("donor", "gene", "x")


def leave_sums(batch: DataFrame, number: int, c: Config) -> int:
    """Leaves the sums of one batch of documents in a folder of its number, the same if it is run again, and gives the number of documents."""
    docs = batch.select(F.coalesce(F.col(c["donor"]).cast("string"), F.lit(c["no_donor"])).alias("donor"), F.col(c["text"]).alias("text"))
    tally = Tally(f"batch-{number}", null_texts=F.count_if(F.col("text").isNull()))
    docs = tally.of(docs)
    kept = {"sums": selection.donor_sums(document_values(docs, c["scale"])), "cells": docs.groupBy("donor").agg(F.count(F.lit(1)).alias("n_cells"))}
    for name, df in kept.items():
        df.write.mode("overwrite").parquet(f"{c['state']}/{name}/batch={number}")
    read = tally.counts
    log.info("batch %d: read %d documents, %d of them null", number, read["rows"], read["null_texts"])
    return read["rows"]


def take_new(spark: SparkSession, c: Config) -> int:
    """Takes the files that the checkpoint does not know, and gives the number of documents read."""
    kinds = f"`{c['donor']}` string, `{c['text']}` string"
    files = spark.readStream.format(c["format"]).schema(kinds).option("maxFilesPerTrigger", c["files_per_batch"]).load(c["documents"])
    rows: list[int] = []
    stream = files.writeStream.foreachBatch(lambda batch, number: rows.append(leave_sums(batch, number, c))).option("checkpointLocation", f"{c['state']}/checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination()
    return sum(rows)


def ranked(sums: DataFrame, cells: DataFrame, c: Config) -> DataFrame:
    """(method, gene, mean, variance, detection, prevalence, score, rank) of the eligible genes.

    A gene shows in a share of ``detection`` of all cells at least, so however large the corpus, the eligible are no more than the mean number of a
    document's distinct tokens divided by it: few enough to be ranked in one task."""
    sizes = cells.groupBy("donor").agg(F.sum("n_cells").alias("n_cells"))
    genes = selection.gene_statistics(selection.merged_sums(sums).join(sizes, "donor"), sizes)
    genes = genes.select("gene", *((F.round(x, DIGITS) + 0.0).alias(x) for x in ("mean", "variance", "detection", "prevalence", "fano")))
    genes = stored(selection.eligible(genes, c["prevalence"], c["detection"]), "eligible")
    genes = genes.join(selection.hvg_residual(genes), "gene")
    out = None
    for method in METHODS:
        order = selection.ranking(genes.select("gene", F.round(method, DIGITS).alias("score")), "gene", "score")
        one = order.join(genes, "gene").select(F.lit(method).alias("method"), "gene", "mean", "variance", "detection", "prevalence", "score", "rank")
        out = one if out is None else out.unionByName(one)
    return out


def run(spark: SparkSession, c: Config) -> DataFrame:
    """Takes what is new in ``documents``, writes the ranking of everything taken so far, a folder for each method, and gives it read back.

    A null source is a donor of its own (``no_donor``); null and empty texts are cells without tokens.  Repeated rows are cells of their own.
    A folder without documents gives an empty ranking; residuals need 100 eligible genes.
    """
    for name, kinds in PARTS.items():  # an input without files has no batch, and is ranked all the same
        spark.createDataFrame([], kinds).write.mode("ignore").parquet(f"{c['state']}/{name}/batch=-1")
    log.info("read %d new documents from %s", take_new(spark, c), c["documents"])
    sums, cells = (spark.read.schema(f"{kinds}, batch long").parquet(f"{c['state']}/{name}") for name, kinds in PARTS.items())
    tally = Tally("ranking")
    with scratch(spark):
        made = tally.of(ranked(sums, cells, c))
        made.write.mode("overwrite").partitionBy("method").parquet(c["output"])
    log.info("wrote %d rows to %s", tally.counts["rows"], c["output"])
    return spark.read.schema(made.schema).parquet(c["output"])


if __name__ == "__main__":
    command_line(__file__, "Unsupervised choice of features from a growing corpus", {"documents": "folder of files with a source and a text", "state": "folder of the checkpoint and the batches' sums", "output": "folder of the ranking"}, run)

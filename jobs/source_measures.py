"""Measures new source texts as they arrive and keeps a summary per repository up to date.

``python -m jobs.source_measures --input documents.parquet --output FOLDER [--config FILE]``

The input is a growing folder of Parquet files (doc_id, text, source), or a pattern of
their paths; files never change once written, and a source is a repository. A file stream with a checkpoint takes each file
once and ends when there is no more. Each batch of it writes its measures to partitions of its own (batch,
bucket), so a batch that is run again after a failure replaces what it had left. Then the repositories in the buckets that
new batches touched are summed up anew from measures alone, and the last batch is marked. Texts are read once, when they arrive.

FOLDER holds ``measures`` (a row a text), ``summary`` (a row a repository, by bucket), ``mark`` and ``checkpoint``.
A null text counts as an empty file; a null source is a repository of its own.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, main, overwrite_partitions, stored
from siltmark.functions import scores, strings
from siltmark.sinks.log import observed

MEASURES = "doc_id long, source string, lines int, loc int, asserts int, is_incident boolean, structure string, batch long, bucket int"
SUMMARY = "source string, files long, loc long, asserts long, incident_files long, duplicated_files long, duplicated_lines long, duplication_risk double, bucket int"
MARK = "batch long"


def measured(docs: DataFrame, batch: int, buckets: int) -> DataFrame:
    """A row of MEASURES for each text; texts of one structure differ in names and numbers alone."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", "source", F.when(text == "", 0).otherwise(F.size(F.split(text, "\n"))).alias("lines"), strings.non_blank_lines(text).alias("loc"),
        strings.asserts_in(text).alias("asserts"), strings.is_incident(text).alias("is_incident"), F.sha2(strings.normalised_structure(text), 256).alias("structure"),
        F.lit(batch).cast("long").alias("batch"), F.pmod(F.xxhash64("source"), F.lit(buckets)).cast("int").alias("bucket"),
    )


def summed(measures: DataFrame, min_lines: int) -> DataFrame:
    """A row of SUMMARY for each repository of ``measures``.

    Equal structures of a repository are counted first, so one that is very frequent is a
    row before repositories are summed up.
    """
    counts = [F.count("*").alias("n"), *[F.sum(F.col(c).cast("long")).alias(c) for c in ("loc", "asserts", "is_incident", "lines")]]
    groups = measures.groupBy("bucket", "source", "structure", (F.col("lines") >= min_lines).alias("long")).agg(*counts)
    twice = (F.col("n") > 1) & F.col("long")
    out = groups.groupBy("bucket", "source").agg(
        F.sum("n").alias("files"), F.sum("loc").alias("loc"), F.sum("asserts").alias("asserts"), F.sum("is_incident").alias("incident_files"),
        F.sum(F.when(twice, F.col("n")).otherwise(0)).alias("duplicated_files"), F.sum(F.when(twice, F.col("lines")).otherwise(0)).alias("duplicated_lines"),
    )
    return out.withColumn("duplication_risk", scores.duplication_risk(F.col("duplicated_lines"), F.col("loc")))


def run(spark: SparkSession, documents: str, output: str, settings: dict[str, Any]) -> DataFrame:
    """Takes what is new in ``documents`` and returns the whole summary as it stands then."""

    def take(docs: DataFrame, batch: int) -> None:
        # By (bucket, a hash of the row), so that a large repository is written by several tasks.
        rows = measured(docs, batch, settings["buckets"]).repartition("bucket", F.pmod(F.xxhash64("doc_id", "structure"), F.lit(settings["spread"])))
        with observed(rows, f"batch {batch} measured", loc=F.sum("loc")) as rows:
            overwrite_partitions(rows, f"{output}/measures", "batch", "bucket")

    stream = spark.readStream.schema(spark.read.parquet(documents).schema).option("maxFilesPerTrigger", settings["max_files_per_trigger"]).parquet(documents)
    writer = stream.select("doc_id", "text", "source").writeStream.foreachBatch(take).option("checkpointLocation", f"{output}/checkpoint")
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read %d new texts of %s", sum(p.numInputRows for p in query.recentProgress), documents)

    measures = stored(spark, f"{output}/measures", MEASURES, "batch", "bucket")
    last = stored(spark, f"{output}/mark", MARK).agg(F.max("batch")).first()[0]
    fresh = measures.where(F.col("batch") > (-1 if last is None else last))
    touched = fresh.groupBy("bucket").agg(F.max("batch").alias("batch")).collect()  # a row a bucket
    if touched:
        rows = summed(measures.where(F.col("bucket").isin([r.bucket for r in touched])), settings["min_lines"])
        with observed(rows, f"summary of {len(touched)} buckets written") as rows:
            overwrite_partitions(rows, f"{output}/summary", "bucket")
        spark.createDataFrame([(max(r.batch for r in touched),)], MARK).write.mode("overwrite").parquet(f"{output}/mark")
    else:
        log.info("nothing is new")
    return stored(spark, f"{output}/summary", SUMMARY, "bucket").drop("bucket")


if __name__ == "__main__":
    main("source_measures", __doc__.splitlines()[0], run)

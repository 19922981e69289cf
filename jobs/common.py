"""What the jobs share: configuration, the command line and stored tables."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("siltmark.jobs")


def config(name: str, path: str | None = None) -> dict[str, Any]:
    """The settings of job ``name``: those beside its module, overridden by those at ``path``."""
    own = json.loads((Path(__file__).parent / f"{name}.json").read_text())
    return own | (json.loads(Path(path).read_text()) if path else {})


def stored(spark: SparkSession, path: str, schema: str, *by: str) -> DataFrame:
    """The Parquet table at ``path``, made empty where nothing was written yet, in partitions ``by``."""
    empty = spark.createDataFrame([], schema).write.mode("ignore")
    (empty.partitionBy(*by) if by else empty).parquet(path)
    return spark.read.schema(schema).parquet(path)


def overwrite_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Writes the partitions that ``df`` has rows for; others stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def main(name: str, about: str, run: Callable[[SparkSession, str, str, dict[str, Any]], DataFrame]) -> None:
    """The command line of a job: the only place that creates and stops a session."""
    p = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=about)
    p.add_argument("--input", required=True, help="path of the table that is read")
    p.add_argument("--output", required=True, help="folder for what is written and for what is known of earlier runs")
    p.add_argument("--config", help="a JSON file of settings that differ from the job's own")
    a = p.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, a.input, a.output, config(name, a.config)).show(20, truncate=False)
    finally:
        spark.stop()

"""Structural duplication of functions across files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltmark.functions.scores import duplication_risk
from siltmark.operators.dimensions import dimension, with_mean
from siltmark.schemas import MISSING_PARSE, MISSING_PARTIAL

MIN_LINES = 7


def duplicate_blocks(functions: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(path, start_line, end_line, members) of functions whose structure another one shares.

    ``functions`` has path, start_line, end_line and tokens. Structures are compared by a
    256-bit digest. Group sizes are aggregated and joined back, so that a structure that is
    very frequent is counted before it is shuffled.
    """
    blocks = functions.where(F.col("end_line") - F.col("start_line") + 1 >= min_lines)
    blocks = blocks.select("path", "start_line", "end_line", F.sha2("tokens", 256).alias("structure"))
    groups = blocks.groupBy(F.col("structure").alias("s")).agg(F.count("*").alias("members")).where("members >= 2")
    return blocks.join(groups, F.col("structure") == F.col("s")).select("path", "start_line", "end_line", "structure", "members")


def duplicated_lines(ranges: DataFrame) -> DataFrame:
    """(path, lines): how many different lines the ranges (path, start_line, end_line) of a path cover.

    Ranges are merged in order of their start; lines are not enumerated.
    """
    before = Window.partitionBy("path").orderBy("start_line", "end_line").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.col("start_line"), F.coalesce(F.max("end_line").over(before) + 1, F.col("start_line")))
    return ranges.withColumn("_fresh", fresh).groupBy("path").agg(F.sum(F.greatest(F.lit(0), F.col("end_line") - F.col("_fresh") + 1)).alias("lines"))


def duplication_dimension(parsed: DataFrame, functions: DataFrame) -> DataFrame:
    """Duplication of parsed files (path, language, parsed, parse_incomplete, loc)."""
    lines = duplicated_lines(duplicate_blocks(functions))
    rows = parsed.join(lines, "path", "left").withColumn("lines", F.coalesce("lines", F.lit(0)))
    rows = rows.withColumn("risk", F.when(F.col("parsed"), duplication_risk(F.col("lines"), F.col("loc"))))
    detail = F.to_json(F.struct((F.col("risk") / 150).alias("duplicated_line_ratio"), F.col("lines").alias("duplicated_lines")))
    return with_mean(rows, F.col("risk")).transform(dimension(1, F.col("risk"), F.col("repo_mean"), ~F.col("parsed"), MISSING_PARSE, detail, F.col("parse_incomplete"), MISSING_PARTIAL, F.col("language") == "unknown"))

"""Tests that belong to files, and the test dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltmark.functions.scores import test_risk
from siltmark.functions.strings import SOURCE_ROOTS, TESTS_DIR, line_count, same_directory_tests, tested_candidates
from siltmark.operators.dimensions import confidence
from siltmark.parse.tables import assertion_count, inline_tests
from siltmark.plans.session import ship_package, written
from siltmark.schemas import DIMENSIONS, MISSING_COVERAGE

NEUTRAL_GAP = 50.0
#: Files that every test directly under ``tests/`` tests.
CRATE_ROOT = r"(^|/)src/(lib|main)\.rs$"


def same_directory_links(files: DataFrame) -> DataFrame:
    """(path, test_path): files of the same folder whose name marks them as tests of ``path``."""
    wanted = files.select("path", F.explode(same_directory_tests(F.col("path"))).alias("test_path"))
    return wanted.join(files.select(F.col("path").alias("_p")), F.col("test_path") == F.col("_p")).drop("_p")


def tests_directory_links(files: DataFrame, pattern: str = TESTS_DIR, roots: tuple[str, ...] = SOURCE_ROOTS) -> DataFrame:
    """(path, test_path) by the names of files under ``tests/``: candidates are derived from the test's side and joined by path.

    All tests of a crate want its root files. Those are looked up in a table of the root files that exist, written so that
    its size decides how it is joined; few as they are, the wanted ones are not shuffled to meet in one task.
    """
    tests = files.select(F.col("path").alias("test_path")).where(F.col("test_path").rlike(pattern))
    wanted = tests.select("test_path", F.explode(F.array_distinct(tested_candidates(F.col("test_path"), pattern, roots))).alias("path"))
    names = files.select("path")
    crates = written(names.where(F.col("path").rlike(CRATE_ROOT)), "crates")
    shared = crates.join(wanted.where(F.col("path").rlike(CRATE_ROOT)), "path")
    # Merged by order: paths take far more memory as a table to be sent whole than the shuffled bytes by which Spark would choose that.
    own = names.where(~F.col("path").rlike(CRATE_ROOT)).hint("merge").join(wanted.where(~F.col("path").rlike(CRATE_ROOT)), "path")
    return own.unionByName(shared).select("path", "test_path")


def first_rule(links: DataFrame) -> DataFrame:
    """Of links (path, rule, ...) only those of each path's first rule."""
    return links.withColumn("_first", F.min("rule").over(Window.partitionBy("path"))).where("rule = _first").drop("_first")


def test_links(files: DataFrame, pattern: str = TESTS_DIR, roots: tuple[str, ...] = SOURCE_ROOTS) -> DataFrame:
    """(path, test_path, rule, test_loc, impl_loc, assertions) for files (path, language, source, loc).

    Rule 1: a test file beside it; rule 2: a Rust test module inside; rule 3: a file under
    ``tests/``. The first rule with a hit wins.
    """
    ship_package(files.sparkSession)
    beside = same_directory_links(files).withColumn("rule", F.lit(1))
    below = tests_directory_links(files, pattern, roots).withColumn("rule", F.lit(3))
    named = beside.unionByName(below)
    text = files.select(F.col("path").alias("_t"), F.col("source").alias("_s"), F.col("language").alias("_l"))
    used = text.join(named.select("test_path").distinct(), F.col("_t") == F.col("test_path"), "left_semi")
    counted = used.select("_t", F.greatest(line_count(F.col("_s")), F.lit(1)).alias("test_loc"), assertion_count(F.col("_s"), F.col("_l")).alias("assertions"))
    external = named.join(counted, F.col("test_path") == F.col("_t")).join(files.select("path", "loc"), "path")
    external = external.select("path", "test_path", "rule", "test_loc", F.greatest("loc", F.lit(1)).alias("impl_loc"), "assertions")
    inside = files.where((F.col("language") == "rust") & F.col("source").contains("#[cfg(test)]"))
    inside = inside.select("path", "loc", inline_tests(F.col("source")).alias("t")).where("t.test_loc is not null")
    inside = inside.select("path", F.col("path").alias("test_path"), F.lit(2).alias("rule"), "t.test_loc", F.greatest(F.col("loc") - F.col("t.test_loc"), F.lit(1)).alias("impl_loc"), "t.assertions")
    return first_rule(external.unionByName(inside))


def test_statistics(links: DataFrame) -> DataFrame:
    """(path, test_files, test_loc, impl_loc, assertions): sums over the links of a path."""
    return links.groupBy("path").agg(
        F.array_sort(F.collect_list("test_path")).alias("test_files"),
        F.sum("test_loc").cast("int").alias("test_loc"),
        F.greatest(F.min_by("impl_loc", "test_path"), F.lit(1)).alias("impl_loc"),
        F.sum("assertions").cast("int").alias("assertions"),
    )


def test_dimension(files: DataFrame, statistics: DataFrame, coverage: DataFrame) -> DataFrame:
    """The test dimension of files (path), with coverage (path, pct).

    A file without tests has none. Without own coverage the gap is the mean gap of the whole
    report, or 50 without a report, and counts as missing data.
    """
    mean = coverage.agg(F.avg(100 - F.col("pct")).alias("mean_gap"))
    rows = files.select("path").join(statistics, "path", "left").join(coverage, "path", "left").crossJoin(F.broadcast(mean))
    gap = F.coalesce(100 - F.col("pct"), F.col("mean_gap"), F.lit(NEUTRAL_GAP))
    risk = F.when(F.col("test_loc").isNull(), F.lit(0.0)).otherwise(test_risk(gap, F.col("test_loc"), F.col("impl_loc"), F.col("assertions")))
    kind = F.when(F.col("test_loc").isNull(), confidence("not_applicable")).when(F.col("pct").isNull(), confidence("data_missing", F.lit(MISSING_COVERAGE))).otherwise(confidence("full"))
    shell = (F.col("assertions") == 0) & (F.col("test_loc") > 0)
    detail = F.to_json(F.struct("test_files", "test_loc", F.col("assertions").alias("assertion_count"), F.col("pct").alias("coverage"), shell.alias("empty_shell")))
    return rows.select("path", F.lit(2).alias("dim_idx"), F.lit(DIMENSIONS[2]).alias("dim"), risk.alias("raw_value"), risk.alias("risk_score"), kind.alias("confidence"), detail.alias("detail"))

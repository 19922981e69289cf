"""Keeps a snapshot of every file's change risk at the end of each period, and the trend that follows.

``python -m jobs.risk_snapshots --input events.parquet --output FOLDER [--config FILE]``

The input is a growing table of commits; the config says how path, author, time and incident are read from its columns,
and what a period is: a day, week or month.
A run compares the number of commits of each period, which it takes from the time column alone, with the
numbers of the run before. It reads the commits of the periods that differ, late ones included, and rewrites their
facts and the snapshots from the first of them on, each in a partition of its own. Weights of commits are halved over time, so those
of a period are summed up as of its end and carried on by one factor; no commit of another period is read
again. The numbers are stored last: a run that failed is simply repeated.

FOLDER holds ``facts`` (path, day and author, by period), ``snapshots`` (by period), ``trends`` and ``counts``.
Commits without a path or a time belong to no file or period and are left out. The session's time zone says when periods end.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobs.common import log, main, overwrite_partitions, stored
from siltmark.functions import scores, strings
from siltmark.operators.history import RECENT_SECONDS
from siltmark.operators.scoring import trend_coefficients
from siltmark.sinks.log import observed

FACTS = "path string, day date, author string, commits long, incidents long, weight double, incident_weight double, period date"
SNAPSHOTS = "path string, commits long, incidents long, authors long, recent_commits long, incident_density double, change_risk double, period date"
COUNTS = "period date, commits long"
TRENDS = "path string, trend_coefficient double"


def _period(time: Column, unit: str) -> Column:
    """The first day of the period of a time."""
    return F.date_trunc(unit, time).cast("date")


def _next(period: Column, unit: str) -> Column:
    return (period + F.expr(f"interval 1 {unit}")).cast("date")


def _end(period: Column, unit: str) -> Column:
    """The second at which a period is over."""
    return F.unix_seconds(_next(period, unit).cast("timestamp"))


def facts_of(commits: DataFrame, unit: str) -> DataFrame:
    """Rows of FACTS from (path, author, time, incident, period); weights are as of the period's end."""
    second = F.floor(F.unix_micros(F.col("time").cast("timestamp")) / 1_000_000)
    weight = scores.decay(_end(F.col("period"), unit) - second)
    return commits.groupBy("period", "path", F.col("time").cast("date").alias("day"), "author").agg(
        F.count("*").alias("commits"), F.count_if("incident").alias("incidents"), F.sum(weight).alias("weight"), F.sum(F.when(F.col("incident"), weight).otherwise(0.0)).alias("incident_weight")
    )


def snapshots_of(facts: DataFrame, last: Column, unit: str) -> DataFrame:
    """Rows of SNAPSHOTS: for every path each period from its first to ``last``.

    A path has a row a period in the windows here, whatever its commits. A day counts as recent
    for the periods that end within 90 days of it.
    """
    step = F.expr(f"interval 1 {unit}")
    sums = facts.groupBy("path", "period").agg(*[F.sum(c).alias(c) for c in ("commits", "incidents", "weight", "incident_weight")])
    grid = sums.groupBy("path").agg(F.min("period").alias("first")).select("path", F.explode(F.sequence("first", last, step)).alias("period"))
    joined = grid.join(sums, ["path", "period"], "left")
    new = facts.groupBy("path", "author").agg(F.min("period").alias("period")).groupBy("path", "period").agg(F.count("*").alias("new_authors"))
    joined = joined.join(new, ["path", "period"], "left")
    until = F.date_add("day", RECENT_SECONDS // 86400)
    ends = F.sequence(_period(F.col("day"), unit), _period(until, unit), step)
    recent = facts.groupBy("path", "day").agg(F.sum("commits").alias("n")).select("path", "day", "n", F.explode(ends).alias("period"))
    recent = recent.where(_next(F.col("period"), unit) <= until).groupBy("path", "period").agg(F.sum("n").alias("recent_commits"))
    joined = joined.join(recent, ["path", "period"], "left")
    seen = Window.partitionBy("path").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    age = _end(F.col("period"), unit) - F.first(_end(F.col("period"), unit)).over(seen)

    def carried(weight: str) -> Column:
        """Weights of all periods so far as of this one's end: taken back to the first one's they add up, then are halved together."""
        return F.sum(F.coalesce(weight, F.lit(0.0)) / F.col("factor")).over(seen) * F.col("factor")

    def total(n: str) -> Column:
        return F.sum(F.coalesce(n, F.lit(0))).over(seen)

    rows = joined.withColumn("factor", scores.decay(age)).select(
        "path", "period", total("commits").alias("commits"), total("incidents").alias("incidents"), total("new_authors").alias("authors"), F.coalesce("recent_commits", F.lit(0)).alias("recent_commits"),
        F.coalesce(F.try_divide(carried("incident_weight"), carried("weight")), F.lit(0.0)).alias("incident_density"),
    )
    return rows.withColumn("change_risk", scores.change_risk(F.col("incident_density"), F.col("recent_commits"), F.col("authors")))


def run(spark: SparkSession, events: str, output: str, settings: dict[str, Any]) -> DataFrame:
    """Takes what is new in ``events`` and returns all snapshots as they stand then."""
    table = spark.read.parquet(events)
    unit = settings["period"]
    path, time = F.expr(settings["path"]), F.expr(settings["time"])
    timed = table.where(time.isNotNull())
    counts = timed.groupBy(_period(time, unit).alias("period")).agg(F.count("*").alias("commits"))
    before = stored(spark, f"{output}/counts", COUNTS).select("period", F.col("commits").alias("before"))
    now = counts.join(before, "period", "left").orderBy("period").collect()  # a row a period
    changed = [r.period for r in now if r.commits != r.before]
    log.info("%s: %d periods, %d of them with new commits", events, len(now), len(changed))
    if changed:
        # A range of the time column reaches the scan, the list of periods what it leaves.
        span = (time >= F.lit(changed[0])) & (time < _next(F.lit(changed[-1]), unit)) & _period(time, unit).isin(changed)
        commits = timed.where(span & path.isNotNull()).select(
            path.alias("path"), strings.author(F.expr(settings["author"])).alias("author"), time.alias("time"), F.coalesce(F.expr(settings["incident"]), F.lit(False)).alias("incident"), _period(time, unit).alias("period")
        )
        with observed(commits, "commits read") as commits:
            overwrite_partitions(facts_of(commits, unit), f"{output}/facts", "period")
        facts = stored(spark, f"{output}/facts", FACTS, "period")
        # Periods without commits since the last run have snapshots too.
        known = max((r.period for r in now if r.before is not None), default=changed[0])
        rows = snapshots_of(facts, F.lit(now[-1].period), unit).where((F.col("period") >= F.lit(changed[0])) | (F.col("period") > F.lit(known)))
        with observed(rows, f"snapshots from {changed[0]} on written") as rows:
            overwrite_partitions(rows, f"{output}/snapshots", "period")
        scored = stored(spark, f"{output}/snapshots", SNAPSHOTS, "period").select("path", F.col("period").alias("commit_date"), F.col("change_risk").alias("base_risk_score"))
        trend_coefficients(scored).write.mode("overwrite").parquet(f"{output}/trends")
        spark.createDataFrame([(r.period, r.commits) for r in now], COUNTS).coalesce(1).write.mode("overwrite").parquet(f"{output}/counts")
    return stored(spark, f"{output}/snapshots", SNAPSHOTS, "period")


if __name__ == "__main__":
    main("risk_snapshots", __doc__.splitlines()[0], run)

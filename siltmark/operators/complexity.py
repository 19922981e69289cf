"""File metrics from functions, repository percentiles and the complexity dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltmark.functions.scores import complexity_bands, complexity_raw, complexity_risk
from siltmark.operators.dimensions import dimension, with_mean
from siltmark.operators.ranking import running_total
from siltmark.schemas import MIN_PERCENTILE_SAMPLE, MISSING_PARSE, MISSING_PARTIAL


def file_metrics(parsed: DataFrame) -> DataFrame:
    """Metrics of each parsed file, from its array of functions; no shuffle.

    The mean complexity is rounded half up, and 1 without functions.
    """
    fs = F.col("functions")
    n = F.size(fs)

    def total(name: str) -> Column:
        return F.aggregate(fs, F.lit(0).cast("long"), lambda acc, f: acc + f[name])

    length = F.transform(fs, lambda f: f["end_line"] - f["start_line"] + 1)
    return parsed.select(
        *[c for c in parsed.columns if c != "functions"],
        F.when(n > 0, F.round(total("complexity") / n).cast("int")).otherwise(1).alias("cyclomatic_complexity"),
        F.coalesce(F.array_max(F.transform(fs, lambda f: f["if_max_depth"])), F.lit(0)).alias("max_if_nesting_depth"),
        F.coalesce(F.try_divide(total("if_nested"), total("if_total")), F.lit(0.0)).alias("nested_if_ratio"),
        F.coalesce(F.try_divide(F.aggregate(length, F.lit(0).cast("long"), lambda a, x: a + x), n), F.lit(0.0)).alias("avg_function_length"),
        F.coalesce(F.array_max(length), F.lit(0)).alias("max_function_length"),
    )


def aggregated_metrics(functions: DataFrame) -> DataFrame:
    """The same metrics from long-form functions (path, start_line, end_line, complexity, if counts)."""
    length = F.col("end_line") - F.col("start_line") + 1
    return functions.groupBy("path").agg(
        F.coalesce(F.round(F.avg("complexity")), F.lit(1)).cast("int").alias("cyclomatic_complexity"),
        F.max("if_max_depth").alias("max_if_nesting_depth"),
        F.coalesce(F.try_divide(F.sum("if_nested"), F.sum("if_total")), F.lit(0.0)).alias("nested_if_ratio"),
        F.avg(length).alias("avg_function_length"),
        F.max(length).alias("max_function_length"),
    )


def with_percentile(df: DataFrame, value: str, out: str = "percentile", by: list[str] | None = None) -> DataFrame:
    """Adds the share (in percent) of the least rank of ``value`` in its pool; null values have no part.

    Null for pools of fewer than five values or of equal ones. Ranks come from counts per
    different value, joined back on it. Pools of their own (``by``) are windowed each; the one
    pool of a whole table gets its ranks from range sums, so that no task sorts it all.
    """
    keys = by or []
    pool = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    if keys:
        whole = Window.partitionBy(*keys)
        before = F.coalesce(F.sum("_n").over(whole.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        pool = pool.select("*", before.alias("_before"), F.sum("_n").over(whole).alias("_total"), F.min(value).over(whole).alias("_low"), F.max(value).over(whole).alias("_high"))
    else:
        totals = df.agg(F.count(value).alias("_total"), F.min(value).alias("_low"), F.max(value).alias("_high"))
        pool = running_total(pool, [F.col(value)], "_n", "_before").crossJoin(F.broadcast(totals))
    enough = (F.col("_total") >= MIN_PERCENTILE_SAMPLE) & (F.col("_low") < F.col("_high"))
    share = F.when(enough, (F.col("_before") + 1) / F.col("_total") * F.lit(100.0))
    ranked = pool.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(value).alias("_value"), share.alias(out))
    on = F.col(value) == F.col("_value")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return df.join(ranked, on, "left").drop("_value", *[f"_{k}" for k in keys])


def complexity_risks(metrics: DataFrame) -> DataFrame:
    """Adds raw, percentile and complexity_risk to parsed files; others get nulls."""
    raw = complexity_raw(F.col("cyclomatic_complexity"), F.col("max_if_nesting_depth"), F.col("avg_function_length"))
    rows = with_percentile(metrics.withColumn("raw", F.when(F.col("parsed"), raw)), "raw")
    bands = complexity_bands(F.col("cyclomatic_complexity"), F.col("max_if_nesting_depth"))
    return rows.withColumn("complexity_risk", F.when(F.col("parsed"), complexity_risk(F.col("percentile"), bands)))


def complexity_dimension(metrics: DataFrame) -> DataFrame:
    rows = complexity_risks(metrics)
    detail = F.to_json(F.struct("cyclomatic_complexity", "max_if_nesting_depth", "nested_if_ratio", "avg_function_length", "max_function_length", "percentile"))
    return with_mean(rows, F.col("complexity_risk")).transform(dimension(0, F.col("complexity_risk"), F.col("repo_mean"), ~F.col("parsed"), MISSING_PARSE, detail, F.col("parse_incomplete"), MISSING_PARTIAL))

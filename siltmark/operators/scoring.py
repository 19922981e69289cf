"""From dimension results to file heat and the repository score."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltmark.functions.scores import clamped, final_heat, trend
from siltmark.operators.ranking import LIMITED, first_rows, largest
from siltmark.schemas import DIMENSIONS, WEIGHTS

TOP_SHARE = 0.05


def compositions(results: DataFrame) -> DataFrame:
    """Base risk of each path from long-form results (path, dim_idx, risk_score, confidence).

    Weights of dimensions that don't apply go to the others in proportion. A dimension above
    50 that exceeds the mean of the others by a quarter adds 0.15 of the difference.
    """
    applies = F.col("confidence.type") != "not_applicable"
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("dim_idx") + 1)
    risk, w = F.when(applies, F.col("risk_score")), F.when(applies, weight)
    names = F.array(*map(F.lit, DIMENSIONS))
    name = F.element_at(names, F.col("dim_idx") + 1)
    rows = results.groupBy("path").agg(
        F.sum(w * risk).alias("weighted"),
        F.sum(w).alias("weights"),
        F.max(risk).alias("most"),
        F.sum(risk).alias("total"),
        F.count(risk).alias("n"),
        F.array_sort(F.collect_list(F.when(applies, F.struct("dim_idx", name.alias("name"), weight.alias("w"))))).alias("active"),
        F.array_sort(F.collect_list(F.when(~applies, F.struct("dim_idx", name.alias("name"))))).alias("left_out"),
    )
    others = F.try_divide(F.col("total") - F.col("most"), F.col("n") - 1)
    extra = F.when((F.col("n") > 1) & (F.col("most") > 50) & (F.col("most") > others * F.lit(1.25)), (F.col("most") - others) * F.lit(0.15)).otherwise(F.lit(0.0))
    base = F.when(F.col("n") == 0, F.lit(0.0)).otherwise(clamped(F.col("weighted") / F.col("weights") + extra))
    return rows.select(
        "path",
        base.alias("base_risk_score"),
        extra.alias("extra_penalty"),
        F.transform("active", lambda a: a["name"]).alias("active_dimensions"),
        F.transform("left_out", lambda a: a["name"]).alias("excluded_dimensions"),
        F.transform("active", lambda a: F.struct(a["name"].alias("dim"), (a["w"] / F.col("weights")).alias("weight"))).alias("normalized_weights"),
    )


def trend_coefficients(snapshots: DataFrame) -> DataFrame:
    """(path, trend_coefficient) from earlier scores (path, commit_date, base_risk_score)."""
    rows = snapshots.groupBy("path").agg(F.avg("base_risk_score").alias("mean"), F.max_by("base_risk_score", "commit_date").alias("last"))
    return rows.select("path", trend(F.col("mean"), F.col("last")).alias("trend_coefficient"))


def heats(composed: DataFrame, trends: DataFrame | None = None) -> DataFrame:
    if trends is None:
        rows = composed.withColumn("trend_coefficient", F.lit(1.0))
    else:
        rows = composed.join(trends, "path", "left").withColumn("trend_coefficient", F.coalesce("trend_coefficient", F.lit(1.0)))
    return rows.withColumn("final_heat_score", final_heat(F.col("base_risk_score"), F.col("trend_coefficient")))


def repository_heat(files: DataFrame) -> DataFrame:
    """One row, repo_total_heat_score, from (path, loc, final_heat_score): mean by lines of code plus a fifth of the top files' mean."""
    top = top_files(files, ranked=False).agg(F.avg("final_heat_score").alias("top_mean"))
    total = files.agg(F.sum("loc").alias("loc"), F.sum(F.col("final_heat_score") * F.col("loc")).alias("weighted"))
    score = F.when(F.coalesce("loc", F.lit(0)) == 0, F.lit(0.0)).otherwise(clamped(F.col("weighted") / F.col("loc") + F.lit(0.2) * F.coalesce("top_mean", F.lit(0.0))))
    return total.crossJoin(F.broadcast(top)).select(score.alias("repo_total_heat_score"))


def top_files(files: DataFrame, share: float = TOP_SHARE, value: str = "final_heat_score", tie: str = "path", ranked: bool = True, limited: int = LIMITED) -> DataFrame:
    """The ``share`` of files with the highest heat (one at least), ties by path; adds ``rank`` if ``ranked``.

    A top of more than ``limited`` files is chosen without sorting the others.
    """
    n = files.count()
    most = max(1, math.ceil(n * share)) if n else 0
    chosen = files if most <= limited else largest(files, value, tie, most, limited)
    if not ranked and most > limited:
        return chosen
    return first_rows(chosen, [F.col(value).desc(), F.col(tie)], most, limited)

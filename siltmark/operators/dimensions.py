"""The long form of dimension results, and the rules for missing data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltmark.schemas import DIMENSIONS


def confidence(kind: str, detail: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("type"), (detail if detail is not None else F.lit(None).cast("string")).alias("detail"))


def dimension(idx: int, own: Column, mean: Column, missing: Column, reason: str, detail: Column, partial: Column | None = None, partial_reason: str = "", never: Column | None = None) -> Callable[[DataFrame], DataFrame]:
    """Turns files into (path, dim_idx, dim, raw_value, risk_score, confidence, detail).

    Where ``missing`` holds the mean of the others stands in, marked as missing data; if
    there is no mean (or ``never`` holds), the dimension does not apply: its score is 0 and
    it is left out of the sum. Where ``partial`` holds the own value is kept but marked.
    """
    gone = F.coalesce(missing & mean.isNull(), F.lit(False))
    if never is not None:
        gone = F.coalesce(never, F.lit(False)) | gone
    risk = F.when(gone, F.lit(0.0)).when(missing, mean).otherwise(own)
    kind = F.when(gone, confidence("not_applicable")).when(missing, confidence("data_missing", F.lit(reason)))
    if partial is not None:
        kind = kind.when(partial, confidence("data_missing", F.lit(partial_reason)))

    def run(df: DataFrame) -> DataFrame:
        return df.select(
            "path",
            F.lit(idx).alias("dim_idx"),
            F.lit(DIMENSIONS[idx]).alias("dim"),
            risk.alias("raw_value"),
            risk.alias("risk_score"),
            kind.otherwise(confidence("full")).alias("confidence"),
            detail.alias("detail"),
        )

    return run


def with_mean(df: DataFrame, value: Column, out: str = "repo_mean") -> DataFrame:
    """Adds the mean of ``value`` over all rows (null if there is none), as one broadcast row."""
    return df.crossJoin(F.broadcast(df.agg(F.avg(value).alias(out))))

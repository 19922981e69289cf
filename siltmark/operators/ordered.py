"""What earlier rows say about a row, over tables whose keys may hold any share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltmark.plans.session import written


def carried(df: DataFrame, by: list[str], order: list[str], values: dict[str, Column], before: bool = False) -> DataFrame:
    """Adds for each item (name: value) of ``values`` the last value that isn't null up to each row, or ``before`` it, among rows with the same ``by``.

    Rows are dealt by ranges of (by, order), so a key of any size lies on several tasks; each
    range is scanned by itself, and the last values of a key in a range, a row for both, are carried on to the key's
    later ranges. ``by`` must not be null, ``order`` should be unique within it. A value that can itself be
    null is given as a struct.
    """
    names = list(values)
    held = {n: f"_sm_v{i}" for i, n in enumerate(names)}
    rows = df.select("*", *[values[n].alias(held[n]) for n in names])
    dealt = written(rows.repartitionByRange(*by, *order).withColumn("_sm_part", F.spark_partition_id()), "carried")
    at = F.struct(*order)
    tails = dealt.groupBy("_sm_part", *by).agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), at)).alias(v) for v in held.values()])
    earlier = Window.partitionBy(*by).orderBy("_sm_part").rowsBetween(Window.unboundedPreceding, -1)
    known = [F.last(v, ignorenulls=True).over(earlier).alias(f"_sm_c{i}") for i, v in enumerate(held.values())]
    # Nearly all keys lie in one range; of the others there is at most one in each.
    tails = tails.withColumn("_sm_n", F.count("*").over(Window.partitionBy(*by))).where("_sm_n > 1").select("_sm_part", *by, *known)
    inside = Window.partitionBy("_sm_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    scanned = dealt.select("*", *[F.last(v, ignorenulls=True).over(inside).alias(f"_sm_i{i}") for i, v in enumerate(held.values())])
    out = scanned.join(tails, ["_sm_part", *by], "left")
    return out.select(*df.columns, *[F.coalesce(f"_sm_i{i}", f"_sm_c{i}").alias(n) for i, n in enumerate(names)])


def asof(left: DataFrame, right: DataFrame, by: str, at: str, value: Column, name: str) -> DataFrame:
    """``left`` with ``name``: ``value`` of the last row of ``right`` with the same ``by`` and an earlier ``at``, or null.

    Both sides are one sorted table, in which the latest row of ``right`` is carried on; none is
    joined, so a key with many rows on both sides costs no more than its rows. ``by`` must not be null;
    if several rows of ``right`` share it and ``at``, any of them is taken.
    """
    mine = left.select(F.col(by).alias("_sm_by"), F.col(at).alias("_sm_at"), F.lit(0).alias("_sm_side"), F.struct("*").alias("_sm_row"))
    theirs = right.select(F.col(by).alias("_sm_by"), F.col(at).alias("_sm_at"), F.lit(1).alias("_sm_side"), F.struct(value.alias("v")).alias("_sm_value"))
    both = mine.unionByName(theirs, allowMissingColumns=True)
    # A row of the left stands before those of the right at its time, so it sees earlier ones alone.
    found = carried(both, ["_sm_by"], ["_sm_at", "_sm_side"], {"_sm_last": F.col("_sm_value")})
    return found.where("_sm_side = 0").select("_sm_row.*", F.col("_sm_last.v").alias(name))

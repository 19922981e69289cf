"""Ranks and running totals over a whole table in a global order, without a single-task window."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltmark.plans.session import written

#: Up to so many rows a top is a limited sort, in which every task keeps that many.
LIMITED = 100_000


def running_totals(df: DataFrame, order: list[Column], totals: dict[str, str]) -> DataFrame:
    """Adds a column for each item (value: name) of ``totals``: the sum of value over all rows before this one in ``order``.

    Rows are dealt by ranges of ``order``; each range is summed by its own task, and only
    one row of sums per range meets on the driver. Rows that tie in ``order`` get their totals in
    any order, so ``order`` should end in a unique key. The result has the extra column
    ``_sm_part`` (the range).
    """
    dealt = written(df.repartitionByRange(*order).withColumn("_sm_part", F.spark_partition_id()), "ranges")
    values = list(totals)
    sums = sorted((tuple(r) for r in dealt.groupBy("_sm_part").agg(*[F.coalesce(F.sum(v), F.lit(0)) for v in values]).collect()), key=lambda r: r[0])
    before = zip(*(accumulate(column, initial=type(column[0])(0)) for column in list(zip(*sums))[1:])) if sums else []
    kinds = [dict(dealt.groupBy().agg(F.sum(v).alias(v)).dtypes)[v] for v in values]
    schema = "_sm_part int, " + ", ".join(f"_sm_base{i} {t}" for i, t in enumerate(kinds))
    base = df.sparkSession.createDataFrame([(r[0], *b) for r, b in zip(sums, before)], schema)
    inside = Window.partitionBy("_sm_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_sm_inside{i}") for i, v in enumerate(values)]).join(F.broadcast(base), "_sm_part")
    for i, name in enumerate(totals.values()):
        out = out.withColumn(name, F.col(f"_sm_base{i}") + F.col(f"_sm_inside{i}"))
    return out.drop(*[f"_sm_{x}{i}" for x in ("base", "inside") for i in range(len(values))])


def running_total(df: DataFrame, order: list[Column], value: str, out: str) -> DataFrame:
    """``running_totals`` of one value."""
    return running_totals(df, order, {value: out})


def first_rows(df: DataFrame, order: list[Column], n: int, limited: int = LIMITED) -> DataFrame:
    """The first ``n`` rows in ``order`` (which ends in a unique key), with their ``rank`` from 1.

    A small n is a limited sort; a large one comes from global ranks, so that no task holds n rows.
    """
    if n <= limited:
        return df.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    ranked = running_total(df.withColumn("_sm_one", F.lit(1)), order, "_sm_one", "_sm_before")
    return ranked.where(F.col("_sm_before") < n).withColumn("rank", (F.col("_sm_before") + 1).cast("int")).drop("_sm_one", "_sm_before", "_sm_part")


def largest(df: DataFrame, value: str, tie: str, n: int, limited: int = LIMITED) -> DataFrame:
    """The ``n`` rows of ``df`` with the largest ``value`` (numeric, null last), ties by ascending ``tie``, which is unique; in no order.

    The least value that is taken is found by counting rows in narrowing bins, a scan of the stored table for each factor of 1,024 between its
    rows and ``limited``, so nothing is sorted but the rows of the last bin.
    """
    held = written(df, "largest")
    v = F.col(value).cast("double")
    low, high, have, every = held.agg(F.min(v), F.max(v), F.count(v), F.count("*")).first()
    if n >= every:
        return held
    if n >= have:  # all values, and the first of the nulls
        return held.where(v.isNotNull()).unionByName(_first(held.where(v.isNull()), [F.col(tie)], n - have, limited))
    above, size = 0, have
    while size > limited and low < high:
        bins = 1024
        at = F.least(F.lit(bins - 1), F.floor((v - low) / (high - low) * bins)).cast("int")
        rows = held.where((v >= low) & (v <= high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min(v).alias("low"), F.max(v).alias("high")).collect()
        for r in sorted(rows, key=lambda r: -r.bin):
            low, high, size = r.low, r.high, r.n
            if above + size >= n:
                break
            above += size
    edge = held.where((v >= low) & (v <= high))
    return held.where(v > high).unionByName(_first(edge, [F.col(value).desc(), F.col(tie)], n - above, limited))


def _first(rows: DataFrame, order: list[Column], n: int, limited: int) -> DataFrame:
    return first_rows(rows, order, n, limited).select(rows.columns)

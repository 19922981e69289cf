"""Counts of what a stage reads or writes, taken by the job that runs it anyway."""

from __future__ import annotations

import logging
import os
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

log = logging.getLogger("siltmark")
if os.environ.get("SILTMARK_DEBUG"):
    logging.basicConfig(level=logging.DEBUG)


@contextmanager
def observed(df: DataFrame, stage: str, level: int = logging.INFO, **metrics: Column) -> Iterator[DataFrame]:
    """``df`` with its rows and ``metrics`` (aggregates) observed; they are logged when the block ends.

    The block must run ``df`` to its end once. No further job is started for the counts.
    """
    seen = Observation()
    yield df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in metrics.items()])
    log.log(level, "%s: %s", stage, ", ".join(f"{k} {v}" for k, v in seen.get.items()))

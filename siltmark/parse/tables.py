"""Parsing as DataFrame operators: Python runs in Arrow batches, everything above is native."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltmark.parse.profiles import PROFILES
from siltmark.parse.scanner import count_assertions, rust_test_modules
from siltmark.parse.structure import parse
from siltmark.plans.session import ship_package

TASKS_A_CORE = 4
_FUNCTION = "start_line int, end_line int, complexity int, if_total int, if_nested int, if_chained int, if_max_depth int, tokens string"
_FIELDS = [x.split()[0] for x in _FUNCTION.split(", ")]
_STRUCT = f"array<struct<{_FUNCTION.replace(' int', ':int').replace(' string', ':string')}>>"


def dealt(files: DataFrame, key: str = "path") -> DataFrame:
    """``files`` over all cores, by ``key``: texts that fill few bytes of few files take long to parse.

    There are a few tasks a core, so that slow ones even out; batches are streamed, so more rows make no task larger in memory.
    """
    spark = files.sparkSession
    tasks = max(TASKS_A_CORE * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.repartition(tasks, key)


def parsed_files(files: DataFrame) -> DataFrame:
    """(path, language, parsed, parse_incomplete, loc, functions) of source files (path, language, source).

    Files of a language without a profile are not parsed: their loc counts non-blank lines,
    and they count as incomplete. A null source is an empty one. Texts stay behind here. The result is
    computed wherever it is used: who uses it more than once writes it first.
    """
    ship_package(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, language, source in zip(pdf["path"], pdf["language"], pdf["source"]):
                profile = PROFILES.get(language)
                if profile is None:
                    loc = sum(1 for line in (source or "").split("\n") if line.strip())
                    rows.append((path, language, False, True, loc, []))
                    continue
                p = parse(source or "", profile)
                rows.append((path, language, True, p.parse_incomplete, p.loc, [{f: getattr(x, f) for f in _FIELDS} for x in p.functions]))
            yield pd.DataFrame(rows, columns=["path", "language", "parsed", "parse_incomplete", "loc", "functions"])

    shape = f"path string, language string, parsed boolean, parse_incomplete boolean, loc int, functions {_STRUCT}"
    return dealt(files.select("path", "language", "source")).mapInPandas(run, shape)


def functions(parsed: DataFrame) -> DataFrame:
    """One row a function: (path, start_line, end_line, complexity, if counts, tokens)."""
    return parsed.select("path", F.explode("functions").alias("f")).select("path", "f.*")


@F.pandas_udf(T.IntegerType())
def assertion_count(source: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([count_assertions(s or "", x) for s, x in zip(source, language)])


@F.pandas_udf(T.StructType([T.StructField("test_loc", T.IntegerType()), T.StructField("assertions", T.IntegerType())]))
def inline_tests(source: pd.Series) -> pd.DataFrame:
    """Lines and assertions of a Rust file's test modules; nulls if it has none."""
    rows = [rust_test_modules(s or "") or (None, None) for s in source]
    return pd.DataFrame(rows, columns=["test_loc", "assertions"]).astype("Int64")

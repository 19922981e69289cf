"""Lockfiles of Cargo, npm and Go as dependency tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark.operators.ranking import running_total
from siltmark.plans.session import written
from siltmark.schemas import DEPENDENCIES


def cargo_lock(texts: DataFrame) -> DataFrame:
    """(n, name, version, ecosystem) of texts (content). What stands before the first package is left out."""
    parts = F.split("content", r"(?m)^\s*\[\[package\]\]\s*$")
    rows = texts.select(F.posexplode(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))).alias("i", "p"))

    def last(key: str):
        found = F.regexp_extract_all("p", F.lit(rf'(?m)^\s*{key} = "*([^"\n]*)"*\s*$'), F.lit(1))
        return F.try_element_at(found, F.lit(-1))

    rows = rows.select(F.array("i").alias("n"), last("name").alias("name"), last("version").alias("version"))
    return rows.where("name is not null and version is not null").withColumn("ecosystem", F.lit("crates.io"))


#: Nested dependencies, level by level; ``place`` is the path of positions that leads to one.
_NESTED = """
WITH RECURSIVE found(place, name, info) AS (
  SELECT array(cast(t.pos AS int)), t.key, t.value
  FROM (SELECT parse_json(content) AS root FROM {texts}) l, LATERAL variant_explode(variant_get(l.root, '$.dependencies')) t WHERE t.key IS NOT NULL
  UNION ALL
  SELECT concat(f.place, array(cast(t.pos AS int))), t.key, t.value
  FROM found f, LATERAL variant_explode(CASE WHEN schema_of_variant(f.info) LIKE 'OBJECT%' THEN variant_get(f.info, '$.dependencies') END) t WHERE t.key IS NOT NULL
), versions AS (
  SELECT place AS n, name, CASE WHEN schema_of_variant(info) LIKE 'OBJECT%' THEN variant_get(info, '$.version') END AS version FROM found
)
SELECT n, name, cast(version AS string) AS version FROM versions WHERE schema_of_variant(version) = 'STRING'
"""
#: By default recursion ends with an error beyond 100 levels or a million rows.
_UNBOUNDED = {"spark.sql.cteRecursionLevelLimit": "-1", "spark.sql.cteRecursionRowLimit": "-1"}


def _nested(texts: DataFrame) -> DataFrame:
    """(n, name, version) of npm lockfiles that nest; stored, so that the session's limits and views are as before."""
    spark = texts.sparkSession
    view = f"lock_texts_{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in _UNBOUNDED}
    texts.createOrReplaceTempView(view)
    try:
        for k, v in _UNBOUNDED.items():
            spark.conf.set(k, v)
        return written(spark.sql(_NESTED.format(texts=view)), "nested")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.catalog.dropTempView(view)


def package_lock(texts: DataFrame) -> DataFrame:
    """(n, name, version, ecosystem) of npm lockfiles (content), versions 1 to 3.

    Versions 2 and 3 list packages by folder; the name follows the last ``node_modules/``
    and the root has an empty key. Version 1, also meant by a missing version, nests to any depth.
    A text that isn't JSON raises.
    """
    version = F.coalesce(F.get_json_object("content", "$.lockfileVersion").try_cast("int"), F.lit(1))
    flat = texts.where(version >= 2).select(F.posexplode(F.map_entries(F.from_json("content", "struct<packages:map<string,struct<version:string>>>")["packages"])).alias("n", "e"))
    flat = flat.where("e.key <> '' and e.value.version is not null").select(F.array("n").alias("n"), F.element_at(F.split("e.key", "node_modules/"), -1).alias("name"), F.col("e.value.version").alias("version"))
    return flat.unionByName(_nested(texts.where(version < 2))).withColumn("ecosystem", F.lit("npm"))


def go_sum(texts: DataFrame) -> DataFrame:
    """(n, name, version, ecosystem) of go.sum texts (content), each module and version once."""
    lines = texts.select(F.posexplode(F.split("content", "\n")).alias("n", "line")).withColumn("line", F.trim(F.regexp_replace("line", r"\s+", " ")))
    rows = lines.where("line <> '' and not startswith(line, '//') and contains(line, ' ')")
    version = F.regexp_replace(F.regexp_replace(F.split("line", " ")[1], "/go\\.mod$", ""), "^v", "")
    rows = rows.select("n", F.split("line", " ")[0].alias("name"), version.alias("version"))
    return rows.groupBy("name", "version").agg(F.array(F.min("n")).alias("n")).select("n", "name", "version", F.lit("Go").alias("ecosystem"))


#: File names and their parsers, DataFrame (content) to DataFrame (n, name, version, ecosystem), in the order of their results. n, an array
#: of numbers, says where in its file a dependency stands.
FORMATS: dict[str, Callable[[DataFrame], DataFrame]] = {"Cargo.lock": cargo_lock, "package-lock.json": package_lock, "go.sum": go_sum}


def register(file_name: str, parser: Callable[[DataFrame], DataFrame]) -> None:
    """Adds a lockfile format, or replaces the one of that file name."""
    FORMATS[file_name] = parser


def union(parts: list[DataFrame]) -> DataFrame:
    """Dependencies of several lockfiles, in order: (pos, name, version, ecosystem). Repeats across files stay."""
    rows = [p.select("n", "name", "version", "ecosystem", F.lit(i).alias("file"), F.lit(1).alias("one")) for i, p in enumerate(parts)]
    placed = running_total(reduce(DataFrame.unionByName, rows), [F.col("file"), F.col("n"), F.col("name"), F.col("version")], "one", "pos")
    return placed.select(F.col("pos").cast("int").alias("pos"), "name", "version", "ecosystem")


def dependencies(files: DataFrame) -> DataFrame:
    """(pos, name, version, ecosystem) of all lockfiles among ``files`` (path, content), in whatever folders; other files are left out."""
    name = F.substring_index("path", "/", -1)
    return union([parser(files.where(name == n).select("content")) for n, parser in FORMATS.items()])


def repository(spark: SparkSession, repo: str, permissive: bool = False) -> DataFrame:
    """Dependencies of the lockfiles at a repository's root; a malformed npm lockfile raises unless ``permissive``."""
    texts = {n: (Path(repo) / n).read_text() for n in FORMATS if (Path(repo) / n).is_file()}
    try:
        json.loads(texts.get("package-lock.json", "{}"))
    except ValueError:
        if not permissive:
            raise
        del texts["package-lock.json"]
    if not texts:
        return spark.createDataFrame([], DEPENDENCIES)
    return dependencies(spark.createDataFrame(list(texts.items()), "path string, content string"))

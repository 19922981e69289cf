"""Coverage reports as (path, pct)."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark.functions.strings import report_path
from siltmark.operators.ordered import carried
from siltmark.parse.profiles import CONVENTIONS
from siltmark.schemas import COVERAGE, COVERAGE_FILES


def _numbered(texts: DataFrame) -> DataFrame:
    """Lines of each report (content), with ids of report and line."""
    rows = texts.select("content").withColumn("report", F.monotonically_increasing_id())
    return rows.select("report", F.posexplode(F.split("content", "\n")).alias("n", "line")).withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", ""))


def _share(hit: Column, all_: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), hit / all_ * F.lit(100.0)))


def lcov(texts: DataFrame) -> DataFrame:
    """Coverage from lcov text: LH of LF at each end_of_record.

    Counts carry over to records that lack them, as does nothing else; a record without
    lines or without a file is left out, and a file's last record counts. A report of any
    length is read by several tasks.
    """
    line = F.col("line")
    file, lines, hits, ends = line.startswith("SF:"), line.startswith("LF:"), line.startswith("LH:"), line == "end_of_record"
    rows = _numbered(texts).where(file | lines | hits | ends)
    number = F.coalesce(F.substring("line", 4, 100).try_cast("double"), F.lit(0.0))
    # The name of a record goes with its end, the counts stay.
    name = F.when(file | ends, F.struct(F.when(file, report_path(F.substring("line", 4, 10000))).alias("path")))
    rows = carried(rows, ["report"], ["n"], {"lf": F.when(lines, number), "lh": F.when(hits, number), "name": name}, before=True)
    records = rows.where(ends).withColumn("path", F.col("name.path")).where("lf > 0 and path is not null")
    return records.groupBy("path").agg(F.max_by(_share(F.coalesce("lh", F.lit(0.0)), F.col("lf")), F.struct("report", "n")).alias("pct"))


def cobertura(texts: DataFrame) -> DataFrame:
    """Coverage from Cobertura text, read by line: the share of lines with hits up to each class end.

    A class begins where ``class filename="`` stands; lines before its first end count for it.
    """
    rows = _numbered(texts)
    begins = F.regexp_extract("line", 'class filename="([^"]*)"', 1)
    is_line = F.col("line").startswith("<line ") & F.col("line").contains("hits=")
    is_class = F.col("line").rlike('class filename="[^"]*"')
    hit = F.coalesce(F.regexp_extract("line", 'hits="([^"]*)"', 1).try_cast("double"), F.lit(0.0)) > 0
    rows = rows.withColumn("name", F.when(is_class, report_path(begins))).withColumn("is_line", is_line & ~is_class)
    rows = rows.withColumn("ends", F.col("line").contains("</class>") & ~is_class & ~F.col("is_line")).where("name is not null or is_line or ends")
    # What belongs together has the same end before it.
    rows = carried(rows, ["report"], ["n"], {"part": F.when(F.col("ends"), F.col("n"))}, before=True).fillna(-1, "part")
    rows = rows.groupBy("report", "part").agg(
        F.max_by("name", F.when(F.col("name").isNotNull(), F.col("n"))).alias("path"),
        F.count_if("is_line").alias("total"),
        F.count_if(F.col("is_line") & hit).alias("hits"),
        F.max("ends").alias("ended"),
    )
    rows = rows.where("ended and path is not null and total > 0")
    return rows.groupBy("path").agg(F.max_by(_share(F.col("hits"), F.col("total")), F.struct("report", "part")).alias("pct"))


def go_cover(texts: DataFrame, module: str | None = None) -> DataFrame:
    """Coverage from ``go tool cover`` profiles: the share of blocks that ran; the module's name is cut off paths."""
    rows = _numbered(texts).where("line <> '' and not startswith(line, 'mode:')")
    path = F.regexp_extract("line", r"^(\S*):[^:\s]*\s", 1)
    count = F.coalesce(F.regexp_extract("line", r"^\S+\s+\S+\s+(.*)$", 1).try_cast("int"), F.lit(0))
    if module:
        path = F.when(path.startswith(f"{module}/"), F.substring(path, len(module) + 2, 100000)).otherwise(path)
    rows = rows.where(F.col("line").rlike(r"^\S*:[^:\s]*\s+\S+\s+")).select(report_path(path).alias("path"), (count > 0).cast("double").alias("hit"))
    return rows.groupBy("path").agg((F.avg("hit") * 100).alias("pct"))


def go_module(texts: DataFrame) -> DataFrame:
    """(module) of go.mod texts (content); no row without one."""
    name = F.regexp_extract("content", r"(?m)^[ \t]*module[ \t]+(\S+)", 1)
    return texts.select(name.alias("module")).where("module <> ''")


def any_report(texts: DataFrame) -> DataFrame:
    """Coverage of reports (content), Cobertura if the text begins with ``<``, else lcov."""
    xml = F.col("content").rlike(r"^\s*<")
    return cobertura(texts.where(xml)).unionByName(lcov(texts.where(~xml)))


def first_report(candidates: DataFrame) -> DataFrame:
    """The content with the least priority of (priority, content)."""
    return candidates.agg(F.min_by("content", "priority").alias("content")).where("content is not null")


def repository(spark: SparkSession, repo: str) -> DataFrame:
    """Coverage of a repository: the first of the usual reports, else one by a language's conventions."""

    def text(name: str) -> str | None:
        path = Path(repo) / name
        try:
            return path.read_text() if path.is_file() else None
        except (OSError, UnicodeDecodeError):
            return None

    for name in COVERAGE_FILES:
        if (content := text(name)) is not None:
            return any_report(spark.createDataFrame([(content,)], "content string"))
    for language in CONVENTIONS.values():
        for name in language.coverage_reports:
            if (content := text(name)) is not None:
                mod = go_module(spark.createDataFrame([(text("go.mod") or "",)], "content string")).first()
                return go_cover(spark.createDataFrame([(content,)], "content string"), mod and mod[0])
    return spark.createDataFrame([], COVERAGE)

"""The scan of one repository: from files, history, lockfiles and reports to scores and a report row."""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark import __version__
from siltmark.functions.scores import consistency, severity_name
from siltmark.functions.strings import risk_tier
from siltmark.operators import complexity, dependency, duplication, history, scoring, testing
from siltmark.parse.tables import functions, parsed_files
from siltmark.plans.session import written
from siltmark.schemas import ANALYSIS_VERSION, DIMENSIONS, LANGUAGES, MAX_COMMITS, MIN_FILES, SCHEMA_VERSION
from siltmark.sinks.log import observed
from siltmark.sources import coverage, files, git, lockfiles, osv


@dataclass
class Inputs:
    """The tables that a scan reads."""

    sources: DataFrame
    commits: DataFrame
    changes: DataFrame
    head: DataFrame
    reflog: DataFrame
    dependencies: DataFrame
    osv_batch: DataFrame
    osv_details: DataFrame
    osv_status: str
    coverage: DataFrame


@dataclass
class Options:
    repo_path: str = "."
    as_of: int = 0
    offline: bool = False
    max_commits: int = MAX_COMMITS
    ignore: tuple[str, ...] = ()
    include_generated: bool = False
    min_files: int = MIN_FILES

    def __post_init__(self) -> None:
        self.as_of = self.as_of or int(time.time())


def ingest(spark: SparkSession, options: Options, fetch: osv.Fetch = osv.http) -> Inputs:
    """Reads a working copy and its history; asks for advisories unless offline."""
    repo = options.repo_path
    found = files.listed(spark, repo, options.ignore, options.include_generated)
    deps = written(lockfiles.repository(spark, repo), "dependencies")
    if options.offline:
        batch, details, status = spark.createDataFrame([], osv.OSV_BATCH), spark.createDataFrame([], osv.OSV_DETAILS), "offline"
    else:
        batch, details, status = osv.query(spark, deps, fetch=fetch)
    return Inputs(
        files.read_sources(found), git.commits(spark, repo, options.max_commits), git.file_changes(spark, repo, options.max_commits),
        git.head_files(spark, repo), git.reflog(spark, repo), deps, batch, details, status, coverage.repository(spark, repo),
    )


@dataclass
class Scores:
    """What a scan computes; ``report`` folds it into one row."""

    files: DataFrame
    dimensions: DataFrame
    findings: DataFrame
    top: DataFrame
    repository: DataFrame


def score(inputs: Inputs, options: Options) -> Scores:
    """Scores of all files. Parsed files and dimension results are written once and reused."""
    readable = inputs.sources.where("skip_reason is null")
    skipped = F.col("skip_reason").isNotNull()
    with observed(inputs.sources, "sources", logging.DEBUG, skipped=F.count_if(skipped), bytes=F.sum(F.when(~skipped, F.octet_length("source")))) as sources:
        parsed = written(parsed_files(sources.where(~skipped)), "parsed")
    blocks = functions(parsed)
    metrics = written(complexity.file_metrics(parsed), "metrics")

    renames = written(history.rename_map(inputs.commits, inputs.changes, options.max_commits), "renamed")
    commits = written(history.file_commits(inputs.commits, inputs.changes, renames, options.max_commits), "history")
    timeline = history.timelines(commits, inputs.head, renames)
    git_counts = history.git_metrics(commits, inputs.head, renames, options.as_of)

    found = dependency.enriched(dependency.findings(inputs.dependencies, inputs.osv_batch), inputs.osv_details)
    with observed(found, "advisories", logging.DEBUG, estimated=F.count_if("severity_estimated")) as every:
        every = written(every, "advisories")
    with observed(dependency.merged_aliases(every, inputs.osv_details), "findings without aliases", logging.DEBUG) as found:
        found = written(found, "findings")
    used = written(dependency.imports(readable.select("path", "source")), "imports")
    worst = written(dependency.file_findings(parsed, found, used), "file-findings")
    incomplete = inputs.osv_status in ("offline", "query_failed")

    texts = readable.select("path", "language", "source").join(parsed.select("path", "loc"), "path")
    links = testing.test_statistics(testing.test_links(texts))
    results = complexity.complexity_dimension(metrics)
    for part in (
        duplication.duplication_dimension(parsed, blocks),
        testing.test_dimension(parsed, links, inputs.coverage),
        history.change_dimension(parsed, timeline, options.as_of),
        dependency.dependency_dimension(parsed, worst, incomplete),
    ):
        results = results.unionByName(part)
    with observed(results, "dimensions", logging.DEBUG, missing=F.count_if(F.col("confidence.type") == "data_missing")) as results:
        results = written(results, "dimensions")

    heat = scoring.heats(scoring.compositions(results))
    rewritten = history.history_rewritten(inputs.reflog)
    wide = metrics.join(git_counts, "path", "left").join(worst, "path").join(heat, "path").crossJoin(F.broadcast(rewritten))
    zero = ["commit_count", "distinct_authors", "last_modified_days_ago", "incident_commit_count"]
    wide = wide.select(
        "path", "language", "loc", "cyclomatic_complexity", "max_if_nesting_depth", "nested_if_ratio", "avg_function_length", "max_function_length",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in zero],
        severity_name(F.col("max_rank")).alias("max_cve_severity"), "cve_count", F.lit(0.0).alias("dependency_staleness"),
        F.lit(incomplete).alias("dependency_data_incomplete"), "parse_incomplete", "base_risk_score", "extra_penalty",
        "active_dimensions", "excluded_dimensions", "normalized_weights", "history_rewrite",
        consistency(F.lit(False), F.col("history_rewrite") == "detected", F.lit(False)).alias("consistency_coefficient"),
        "trend_coefficient", "final_heat_score", risk_tier(F.col("final_heat_score")).alias("tier"),
    )
    scored = written(wide, "scores")
    return Scores(scored, results, dependency.with_affected_files(found, used), scoring.top_files(scored), scoring.repository_heat(scored))


def warnings(n_files: int, truncated: bool, incomplete_paths: list[str], options: Options) -> list[str]:
    """What a reader of the report should know, in a fixed order. The texts of the first four."""
    out = []
    if options.offline:
        out.append("Dependency vulnerability scanning is disabled because offline mode is enabled.")
    if options.include_generated:
        out.append("--include-generated enabled: generated artifacts (target/, node_modules/, dist/, build/, *.generated.*) are included in the scan.")
    out.append("Trend analysis is not enabled in this version: no historical snapshots are collected, trend_coefficient is fixed at 1.0.")
    if truncated:
        out.append(f"History analysis limited to the latest {options.max_commits} commits.")
    if n_files == 1:
        out.append("Single-file repository: too few files (< 5) for a complexity percentile; only absolute thresholds apply")
    if n_files < options.min_files:
        out.append(f"Small sample ({n_files} files < {options.min_files}): percentile ranks are noisy; below 5 files they are left out and absolute thresholds apply")
    return out + [f"Parse warning: {p}" for p in incomplete_paths]


def summary(scores: Scores) -> DataFrame:
    """One row of totals: files, lines, dimension means (those that don't apply count as 0), confidence and top share."""
    dims = scores.dimensions.groupBy().pivot("dim", list(DIMENSIONS)).agg(F.sum("risk_score"))
    totals = scores.files.agg(
        F.count("*").alias("file_count"),
        F.coalesce(F.sum("loc"), F.lit(0)).alias("total_loc"),
        F.avg("consistency_coefficient").alias("avg_confidence"),
        F.count_if(F.col("consistency_coefficient") < 0.7).alias("low_confidence_files"),
        F.count_if(F.col("cve_count") > 0).alias("affected_files"),
    )
    top = scores.top.agg(F.count("*").alias("top_risk_files"))
    rows = totals.crossJoin(F.broadcast(dims)).crossJoin(F.broadcast(top)).crossJoin(F.broadcast(scores.repository))
    n = F.greatest("file_count", F.lit(1))
    share = F.coalesce(F.try_divide(F.col("top_risk_files") * 100.0, F.col("file_count")), F.lit(0.0)).alias("top_risk_percentage")
    means = [(F.coalesce(d, F.lit(0.0)) / n).alias(f"avg_{d}") for d in DIMENSIONS]
    return rows.select("file_count", "total_loc", *means, "avg_confidence", "low_confidence_files", "affected_files", "top_risk_files", share, "repo_total_heat_score")


def report(spark: SparkSession, inputs: Inputs, scores: Scores, options: Options, elapsed: float = 0.0) -> DataFrame:
    """The whole report as one nested row."""
    own_dims = scores.dimensions.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim_idx", "dim", "raw_value", "risk_score", "confidence", "detail"))), lambda d: d.dropFields("dim_idx")).alias("dimensions"))
    consistent = F.struct(F.lit(False).alias("coverage_report_stale"), "history_rewrite", F.lit(False).alias("lockfile_mismatch"), F.col("consistency_coefficient").alias("coefficient"))
    raw = F.struct(*scores.files.columns[: scores.files.columns.index("base_risk_score")])
    one = F.struct(raw.alias("raw"), "dimensions", "base_risk_score", consistent.alias("consistency"), "trend_coefficient", "final_heat_score", F.array().cast("array<double>").alias("trend_history"))
    rows = scores.files.join(own_dims, "path").select("path", one.alias("file"))
    every = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("path", "file"))), lambda x: x["file"]).alias("files"))
    top = scores.top.select("path", "rank").join(rows, "path").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "file"))), lambda x: x["file"]).alias("top_risk_files"))
    found = scores.findings.agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "id", "package_name", "ecosystem", "version", "severity", "severity_estimated", "summary", "affected_files"))), lambda x: x.dropFields("seq")).alias("dependency_findings"))
    stats = files.scan_statistics(inputs.sources).first()
    truncated = bool(inputs.commits.agg(history.is_truncated(inputs.commits, options.max_commits)).first()[0])
    broken = [r.path for r in scores.files.where("parse_incomplete").select("path").orderBy("path").collect()]
    notes = warnings(stats.file_count, truncated, broken, options)
    meta = F.struct(
        F.lit(options.max_commits).alias("max_commits"), F.lit(truncated).alias("history_truncated"), F.lit(options.offline).alias("offline"),
        F.lit(inputs.osv_status).alias("osv_status"), F.array(*map(F.lit, LANGUAGES)).alias("supported_languages"), F.lit(elapsed).alias("elapsed_seconds"),
        F.lit(stats.file_count).alias("file_count"), F.lit(stats.file_count < options.min_files).alias("sample_size_warning"),
        F.lit(stats.skipped_symlinks).alias("skipped_symlinks"), F.lit(stats.skipped_files).alias("skipped_files"),
    )
    scanned = datetime.fromtimestamp(options.as_of, timezone.utc).isoformat()
    row = every.crossJoin(top).crossJoin(found).crossJoin(scores.repository)
    return row.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(__version__).alias("tool_version"), F.lit(ANALYSIS_VERSION).alias("analysis_version"),
        F.lit(options.repo_path).alias("repo_path"), F.lit(scanned).alias("scanned_at"), "files", "repo_total_heat_score", "top_risk_files",
        "dependency_findings", F.array().cast("array<struct<type:string,detail:string>>").alias("anomalies"), meta.alias("analysis_metadata"),
        F.array(*map(F.lit, notes)).alias("warnings"),
    )

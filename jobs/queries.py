"""The jobs as registered queries, each run twice into one new folder, with SQL for what it leaves there."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession

from jobs import risk_snapshots, source_measures
from jobs.common import config
from siltmark.plans.session import shared_dir


def _twice(spark: SparkSession, job: ModuleType, name: str, table: str) -> DataFrame:
    """The output as it stands after the second run; the folder stays."""
    output = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    job.run(spark, table, output, config(name))
    return job.run(spark, table, output, config(name))


def job1_source_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source texts of the repositories named by their source.

    The path is a pattern because the table may be one file, whose plain path a file stream does not take.
    """
    return _twice(spark, source_measures, "source_measures", f"{sf_dir}/documents.parque[t]")


JOB1 = r"""
WITH m AS (
  SELECT source, coalesce(text, '') AS t, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split(text, chr(10))) END AS lines,
    len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '\s', ' ', 'g')) <> '')) AS loc,
    len(regexp_extract_all(' ' || regexp_replace(lower(coalesce(text, '')), '[^a-z0-9_]', ' ', 'g'), '[^a-z0-9_](assert|expect)')) AS asserts,
    regexp_matches(lower(coalesce(text, '')), '(^|[^\p{L}\p{M}\p{N}_])(fix|bug|revert|hotfix|patch|error|crash)([^\p{L}\p{M}\p{N}_]|$)') AS incident,
    regexp_replace(regexp_replace(coalesce(text, ''), '[\p{L}_][\p{L}\p{N}_]*', 'IDENT', 'g'), '[0-9]+', 'NUM', 'g') AS structure FROM documents
), g AS (
  SELECT source, structure, lines >= 7 AS long, count(*) AS n, sum(loc) AS loc, sum(asserts) AS asserts, sum(incident::INTEGER) AS incidents, sum(lines) AS lines FROM m GROUP BY ALL
), s AS (
  SELECT source, sum(n)::BIGINT AS files, sum(loc)::BIGINT AS loc, sum(asserts)::BIGINT AS asserts, sum(incidents)::BIGINT AS incident_files,
    coalesce(sum(n) FILTER (long AND n > 1), 0)::BIGINT AS duplicated_files, coalesce(sum(lines) FILTER (long AND n > 1), 0)::BIGINT AS duplicated_lines FROM g GROUP BY source
)
SELECT *, CASE WHEN duplicated_lines > 0 AND loc > 0 THEN least(100::DOUBLE, duplicated_lines::DOUBLE / loc * 150) ELSE 0 END AS duplication_risk FROM s
"""


def job2_risk_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as commits of the files named by their key."""
    rows = _twice(spark, risk_snapshots, "risk_snapshots", f"{sf_dir}/events.parquet")
    return rows.selectExpr("cast(period AS string) AS period", "path", "commits", "incidents", "authors", "recent_commits", "round(incident_density, 6) AS incident_density", "round(change_risk, 6) AS change_risk")


JOB2 = """
WITH e AS (
  SELECT json_extract_string(props, '$.k') AS path, ts, floor(epoch(ts))::BIGINT AS sec, user_id::VARCHAR AS author, coalesce(event_type = 'error', false) AS inc FROM events WHERE ts IS NOT NULL
), m AS (
  SELECT unnest(generate_series(date_trunc('week', min(ts))::TIMESTAMP, date_trunc('week', max(ts))::TIMESTAMP, INTERVAL 7 DAY)) AS period FROM e
), w AS (
  SELECT strftime(period, '%Y-%m-%d') AS period, path, author, inc, epoch(period + INTERVAL 7 DAY)::BIGINT - sec AS age, pow(0.5::DOUBLE, age::DOUBLE / (86400.0::DOUBLE * 30.44) / 6) AS weight
  FROM m JOIN e ON e.ts < period + INTERVAL 7 DAY WHERE path IS NOT NULL
), r AS (
  SELECT period, path, count(*) AS commits, count(*) FILTER (inc) AS incidents, count(DISTINCT author) AS authors, count(*) FILTER (age <= 90 * 86400) AS recent_commits,
    sum(CASE WHEN inc THEN weight ELSE 0 END) / sum(weight) AS density FROM w GROUP BY period, path
)
SELECT period, path, commits, incidents, authors, recent_commits, round(density, 6) AS incident_density,
  round(least(100::DOUBLE, greatest(0::DOUBLE, density * 60 + least(100::DOUBLE, recent_commits / 90::DOUBLE * 100) * 0.2::DOUBLE + least(100::DOUBLE, authors * 10) * 0.2::DOUBLE)), 6) AS change_risk FROM r
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_source_measures": job1_source_measures, "job2_risk_snapshots": job2_risk_snapshots}
ORACLES = {"job1_source_measures": JOB1, "job2_risk_snapshots": JOB2}

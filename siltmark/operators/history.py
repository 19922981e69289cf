"""Commit history: renames, per-file metrics, timelines and the change-risk dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltmark.functions.scores import change_risk, decay
from siltmark.functions.strings import author, is_incident
from siltmark.operators.dimensions import dimension, with_mean
from siltmark.operators.ordered import asof
from siltmark.plans.session import remove, written
from siltmark.schemas import MAX_COMMITS

RECENT_SECONDS = 90 * 86400


def walked(commits: DataFrame, max_commits: int | None = MAX_COMMITS) -> DataFrame:
    """The latest ``max_commits`` commits of the walk, or all for None; walk_pos counts from 0, newest first."""
    return commits if max_commits is None else commits.where(F.col("walk_pos") < max_commits)


def is_truncated(commits: DataFrame, max_commits: int = MAX_COMMITS) -> Column:
    return F.coalesce(F.max("walk_pos") >= max_commits, F.lit(False)).alias("history_truncated")


def rename_map(commits: DataFrame, changes: DataFrame, max_commits: int | None = MAX_COMMITS) -> DataFrame:
    """(path, final): where a renamed path ended up within the walked commits, or all of them for ``max_commits`` None.

    A rename leads on to the latest known fate of its new path among newer commits. Where a
    path was renamed in several commits, the oldest of them decides for changes under the old
    name. Chains are followed by doubling their links, a few joins even for long ones.
    """
    renames = changes.where("status = 'R' and old_path <> new_path").join(walked(commits, max_commits).select("commit_id", "walk_pos"), "commit_id")
    order = F.struct("walk_pos", "delta_pos")
    steps = renames.select("old_path", "new_path", order.alias("at"), F.struct(F.col("walk_pos"), F.col("delta_pos"), F.col("old_path")).alias("id"))
    # The link of a rename: the last rename of its new path that was taken in before it. A path may be renamed any number of times.
    links = asof(steps.withColumn("path", F.col("new_path")), steps.withColumn("path", F.col("old_path")), "path", "at", F.col("id"), "next").drop("path")
    now = written(links, "renames")
    while not now.where("next is not null").isEmpty():
        ahead = now.select(F.col("id").alias("a_id"), F.col("new_path").alias("a_new"), F.col("next").alias("a_next"))
        step = now.join(ahead, F.col("next") == F.col("a_id"), "left").select("id", "old_path", F.coalesce("a_new", "new_path").alias("new_path"), "at", F.col("a_next").alias("next"))
        after = written(step, "renames")
        remove(now)
        now = after
    return now.groupBy(F.col("old_path").alias("path")).agg(F.max_by("new_path", "at").alias("final"))


def _final(df: DataFrame, renames: DataFrame, column: str) -> DataFrame:
    fate = renames.select(F.col("path").alias("_r_path"), F.col("final").alias("_r_final"))
    return df.join(fate, F.col(column) == F.col("_r_path"), "left").withColumn(column, F.coalesce("_r_final", column)).drop("_r_path", "_r_final")


def file_commits(commits: DataFrame, changes: DataFrame, renames: DataFrame, max_commits: int = MAX_COMMITS) -> DataFrame:
    """(path, commit_id, commit_ts, author, is_incident): a row for each commit of a path, under its final name."""
    touched = changes.where("not is_binary").select("commit_id", F.coalesce("new_path", "old_path").alias("path")).where("path is not null")
    touched = _final(touched, renames, "path").distinct()
    who = walked(commits, max_commits).select("commit_id", "commit_ts", author(F.col("author_email")).alias("author"), is_incident(F.col("message")).alias("is_incident"))
    return touched.join(who, "commit_id").select("path", "commit_id", "commit_ts", "author", "is_incident")


def git_metrics(history: DataFrame, head: DataFrame, renames: DataFrame, as_of: int) -> DataFrame:
    """(path, commit_count, distinct_authors, last_modified_days_ago, incident_commit_count) of every file of HEAD."""
    found = history.groupBy(F.col("path").alias("final")).agg(
        F.countDistinct("commit_id").alias("commit_count"),
        F.countDistinct("author").alias("distinct_authors"),
        F.greatest(F.lit(0), F.floor((F.lit(as_of) - F.max("commit_ts")) / 86400)).cast("int").alias("last_modified_days_ago"),
        F.count_if("is_incident").alias("incident_commit_count"),
    )
    files = _final(head.select("path", F.col("path").alias("name")), renames, "name")
    counts = ["commit_count", "distinct_authors", "last_modified_days_ago", "incident_commit_count"]
    return files.join(found, F.col("name") == F.col("final"), "left").select("path", *[F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in counts])


def timelines(history: DataFrame, head: DataFrame, renames: DataFrame) -> DataFrame:
    """The commits of each file of HEAD that has any, under its own name."""
    files = _final(head.select(F.col("path").alias("file"), F.col("path").alias("name")), renames, "name")
    return files.join(history, F.col("name") == F.col("path")).select(F.col("file").alias("path"), "commit_id", "commit_ts", "author", "is_incident")


def change_risks(history: DataFrame, as_of: int) -> DataFrame:
    """Change risk per path of long-form history (path, commit_ts, author, is_incident).

    Returns path, incident_density, recent_commits, authors, commits and change_risk.
    """
    weight = decay(F.lit(as_of) - F.col("commit_ts"))
    out = history.groupBy("path").agg(
        F.coalesce(F.try_divide(F.sum(F.when(F.col("is_incident"), weight).otherwise(0.0)), F.sum(weight)), F.lit(0.0)).alias("incident_density"),
        F.count_if(F.lit(as_of) - F.col("commit_ts") <= RECENT_SECONDS).alias("recent_commits"),
        F.countDistinct("author").alias("authors"),
        F.count("*").alias("commits"),
    )
    return out.withColumn("change_risk", change_risk(F.col("incident_density"), F.col("recent_commits"), F.col("authors")))


def change_dimension(files: DataFrame, history: DataFrame, as_of: int) -> DataFrame:
    """Change risk of all files; those without history get the mean of the others, or none."""
    own = change_risks(history, as_of)
    joined = files.select("path").join(own, "path", "left")
    detail = F.to_json(F.struct(F.col("incident_density"), F.col("recent_commits"), F.col("authors"), F.col("commits").alias("total_commits_in_window")))
    return with_mean(joined, F.col("change_risk")).transform(dimension(3, F.col("change_risk"), F.col("repo_mean"), F.col("change_risk").isNull(), "no commits", detail))


def history_rewritten(reflog: DataFrame) -> DataFrame:
    """One row: ``detected`` or ``unknown``, from reflog lines (value)."""
    suspicious = F.lower("value").rlike("reset:|rebase|amend|force")
    return reflog.agg(F.when(F.count_if(suspicious) > 0, "detected").otherwise("unknown").alias("history_rewrite"))

"""Ingestion of a git history into the tables that the operators read.

Git is asked once per table, on the driver; query code reads the tables only.
"""

from __future__ import annotations

import os
import subprocess
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from siltmark.schemas import COMMITS, FILE_CHANGES, HEAD_FILES, MAX_COMMITS

_UNIT, _RECORD = "\x1f", "\x1e"


def _git(repo: str | os.PathLike, *args: str) -> str:
    done = subprocess.run(["git", "-C", str(repo), "-c", "core.quotepath=off", *args], capture_output=True)
    if done.returncode:
        raise RuntimeError(done.stderr.decode("utf-8", "replace").strip() or f"git {args[0]} failed")
    return done.stdout.decode("utf-8", "replace")


def _frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    if not rows:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame(pd.DataFrame(rows, columns=[c.strip().split()[0] for c in schema.split(",")]), schema)


def has_head(repo: str | os.PathLike) -> bool:
    return subprocess.run(["git", "-C", str(repo), "rev-parse", "-q", "--verify", "HEAD"], capture_output=True).returncode == 0


def commits(spark: SparkSession, repo: str | os.PathLike, max_commits: int = MAX_COMMITS) -> DataFrame:
    """Commits from HEAD, newest first and parents after children; one more than ``max_commits`` shows a cut."""
    rows = []
    if has_head(repo):
        log = _git(repo, "log", "--date-order", f"-n{max_commits + 1}", f"--format=%H{_UNIT}%ct{_UNIT}%ae{_UNIT}%B{_RECORD}")
        for i, record in enumerate(log.split(_RECORD)[:-1]):
            commit, ts, email, message = record.lstrip("\n").split(_UNIT, 3)
            rows.append((commit, i, int(ts), email, message))
    return _frame(spark, rows, COMMITS)


def file_changes(spark: SparkSession, repo: str | os.PathLike, max_commits: int = MAX_COMMITS) -> DataFrame:
    """Changes of each commit against its first parent, with renames; binary files are marked."""
    rows = []
    if has_head(repo):
        common = ["--date-order", f"-n{max_commits}", "--diff-merges=first-parent", "--root", "-M", "-z", f"--format={_RECORD}%H"]
        binary: set[tuple[str, str]] = set()
        for record in _git(repo, "log", "--numstat", *common).split(_RECORD)[1:]:
            commit, _, rest = record.partition("\0")
            fields = rest.lstrip("\n").split("\0")
            i = 0
            while i < len(fields):
                parts = fields[i].lstrip("\n").split("\t")
                if len(parts) == 3:
                    renamed = not parts[2]
                    name = fields[i + 2] if renamed and i + 2 < len(fields) else parts[2]
                    if parts[0] == "-":
                        binary.add((commit.strip(), name))
                    i += 2 * renamed
                i += 1
        for record in _git(repo, "log", "--name-status", *common).split(_RECORD)[1:]:
            commit, _, rest = record.partition("\0")
            commit = commit.strip()
            fields = [f for f in rest.lstrip("\n").split("\0")]
            i = n = 0
            while i + 1 < len(fields):
                status = fields[i].strip()
                if not status:
                    i += 1
                    continue
                two = status[0] in "RC"
                old, new = fields[i + 1], fields[i + 2] if two else fields[i + 1]
                path = new
                rows.append((commit, n, None if status[0] == "A" else old, None if status[0] == "D" else new, status[0], (commit, path) in binary))
                i, n = i + 2 + two, n + 1
    return _frame(spark, rows, FILE_CHANGES)


def head_files(spark: SparkSession, repo: str | os.PathLike) -> DataFrame:
    rows = [(p,) for p in _git(repo, "ls-tree", "-r", "-z", "--name-only", "HEAD").split("\0") if p] if has_head(repo) else []
    return _frame(spark, rows, HEAD_FILES)


def reflog(spark: SparkSession, repo: str | os.PathLike) -> DataFrame:
    """Lines (value) of HEAD's reflog; none if there is no file."""
    path = Path(repo) / ".git/logs/HEAD"
    rows = [(x,) for x in path.read_text(errors="replace").splitlines()] if path.is_file() else []
    return _frame(spark, rows, "value string")

"""Source files of a repository."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark.functions.strings import language
from siltmark.schemas import FORCED_IGNORES, MAX_FILE_BYTES

# Ignore files that a scan honours, in every folder.
IGNORE_FILES = (".gitignore", ".ignore", ".rbignore")
IGNORE_TEMPLATE = """\
# Ignore rules of the scan, one gitignore pattern a line.
# Generated folders (target/, node_modules/, dist/, build/) and *.generated.* files are left out anyway.
"""


def glob_regex(pattern: str) -> str:
    """A gitignore pattern as a regular expression over repository paths."""
    anchored = pattern.startswith("/") or "/" in pattern.rstrip("/")[1:]
    body = pattern.strip("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        elif body[i] == "[" and "]" in body[i + 1 :]:
            end = body.index("]", i + 1)
            out, i = out + "[" + body[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        elif body[i] == "\\" and i + 1 < len(body):
            out, i = out + re.escape(body[i + 1]), i + 2
        else:
            out, i = out + re.escape(body[i]), i + 1
    return ("^" if anchored else "(?:^|.*/)") + out + ("/.*$" if pattern.endswith("/") else "(?:/.*)?$")


def ignored(path: Column, patterns: tuple[str, ...] | list[str]) -> Column:
    """Whether a path or a folder above it matches one of the patterns."""
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(glob_regex(p))
    return out


@dataclass(frozen=True)
class _Rule:
    regex: re.Pattern
    keeps: bool
    folder: str

    def hits(self, path: str, is_dir: bool) -> bool:
        if not path.startswith(self.folder):
            return False
        rest = path[len(self.folder) :]
        return bool(self.regex.match(rest + "/" if is_dir and self.regex.pattern.endswith("/.*$") else rest))


def _rules(folder: Path, prefix: str) -> list[_Rule]:
    out = []
    for name in IGNORE_FILES:
        try:
            lines = (folder / name).read_text(errors="replace").splitlines()
        except OSError:
            continue
        for line in lines:
            line = line.rstrip()
            if not line or line.startswith("#"):
                continue
            keeps = line.startswith("!")
            out.append(_Rule(re.compile(glob_regex(line[keeps:])), keeps, prefix))
    return out


def listing(repo: str | os.PathLike) -> Iterator[tuple[str, str, int, bool]]:
    """(path, file, bytes, is_symlink) of all files that ignore rules and hidden names leave, folders in order of name.

    This is a walk of one working copy, on the driver; file contents are not opened.
    """
    root = Path(repo)
    exclude = root / ".git/info/exclude"
    rules = [_Rule(re.compile(glob_regex(x.strip())), False, "") for x in (exclude.read_text().splitlines() if exclude.is_file() else []) if x.strip() and not x.startswith("#")]

    def walk(folder: Path, prefix: str, rules: list[_Rule]) -> Iterator[tuple[str, str, int, bool]]:
        rules = rules + _rules(folder, prefix)
        for entry in sorted(os.scandir(folder), key=lambda e: e.name):
            if entry.name.startswith("."):
                continue
            path = prefix + entry.name
            is_dir = entry.is_dir(follow_symlinks=False)
            last = next((r for r in reversed(rules) if r.hits(path, is_dir)), None)
            if last and not last.keeps:
                continue
            if is_dir:
                yield from walk(Path(entry.path), path + "/", rules)
            else:
                yield path, entry.path, entry.stat(follow_symlinks=False).st_size, entry.is_symlink()

    yield from walk(root, "", rules)


def listed(spark: SparkSession, repo: str | os.PathLike, ignore: tuple[str, ...] = (), include_generated: bool = False) -> DataFrame:
    """(path, file, size_bytes, is_symlink, language, skip_reason) of the files that a scan sees.

    skip_reason is symlink, size (over 10 MiB), or null for files to be read. Files of
    unknown languages and ignored paths are left out before anything is read.
    """
    rows = list(listing(repo))
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["path", "file", "size_bytes", "is_symlink"]), "path string, file string, size_bytes long, is_symlink boolean") if rows else spark.createDataFrame([], "path string, file string, size_bytes long, is_symlink boolean")
    patterns = (*ignore, *(() if include_generated else FORCED_IGNORES))
    df = df.withColumn("language", language(F.col("path"))).where((F.col("language") != "unknown") | F.col("is_symlink")).where(~ignored(F.col("path"), patterns))
    reason = F.when(F.col("is_symlink"), "symlink").when(F.col("size_bytes") > MAX_FILE_BYTES, "size")
    return df.withColumn("skip_reason", reason)


def read_sources(found: DataFrame) -> DataFrame:
    """Listed files with their text: (path, language, source, size_bytes, skip_reason).

    Files are read where their rows are, a partition of names at a time; text that is no
    UTF-8 becomes null with the reason ``encoding``, and files that can't be read ``io``.
    The working copy has to be visible to the executors.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, reasons = [], []
            for name, reason in zip(pdf["file"], pdf["skip_reason"]):
                text = None
                if not isinstance(reason, str):
                    reason = None
                    try:
                        text = Path(name).read_bytes().decode("utf-8")
                    except UnicodeDecodeError:
                        reason = "encoding"
                    except OSError:
                        reason = "io"
                texts.append(text)
                reasons.append(reason)
            yield pdf[["path", "language", "size_bytes"]].assign(source=texts, skip_reason=reasons)

    out = found.mapInPandas(run, "path string, language string, size_bytes long, source string, skip_reason string")
    return out.select("path", "language", "source", "size_bytes", "skip_reason")


def scan_statistics(read: DataFrame) -> DataFrame:
    """One row: skipped_symlinks, skipped_files, file_count."""
    return read.agg(
        F.count_if(F.col("skip_reason") == "symlink").alias("skipped_symlinks"),
        F.count_if(F.col("skip_reason").isin("size", "encoding", "io")).alias("skipped_files"),
        F.count_if(F.col("skip_reason").isNull()).alias("file_count"),
    )


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """Source files below a folder of any store that Spark reads; names that begin with ``_`` or ``.`` are left out by Spark."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= MAX_FILE_BYTES)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return df.select("path", language(F.col("path")).alias("language"), text.alias("source"), F.col("length").alias("size_bytes")).where("language <> 'unknown'")


def ensure_ignore_file(repo: str | os.PathLike) -> bool:
    """Writes a template of the scan's own ignore file if there is none; opt-in."""
    path = Path(repo) / IGNORE_FILES[-1]
    if path.exists():
        return False
    path.write_text(IGNORE_TEMPLATE)
    return True

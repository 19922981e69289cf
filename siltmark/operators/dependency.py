"""Findings of vulnerable dependencies, their merging, and the dependency dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltmark.functions.scores import cvss_score, cvss_severity, dependency_risk, detail_severity, severity_rank
from siltmark.functions.strings import crate_import, npm_package
from siltmark.operators.dimensions import dimension, with_mean


def findings(dependencies: DataFrame, batch: DataFrame) -> DataFrame:
    """A row for each vulnerability of a batch answer, joined to its dependency by position.

    Returns seq, id, package_name, ecosystem, version, severity, severity_estimated,
    summary. Null answers and answers without a dependency are left out.
    """
    rows = batch.where("vulns is not null").select("pos", F.posexplode("vulns").alias("n", "v"))
    score = cvss_score(F.col("v.database_specific"))
    joined = rows.join(dependencies, "pos")
    return joined.select(
        F.struct("pos", "n").alias("seq"),
        F.col("v.id").alias("id"),
        F.col("name").alias("package_name"),
        "ecosystem",
        "version",
        cvss_severity(score).alias("severity"),
        score.isNull().alias("severity_estimated"),
        F.coalesce("v.summary", F.lit("")).alias("summary"),
    )


def enriched(found: DataFrame, details: DataFrame) -> DataFrame:
    """Findings with the severity and summary of their details (id, summary, aliases, database_specific), if there are any."""
    own = details.select(F.col("id").alias("_id"), F.col("summary").alias("_summary"), detail_severity(F.col("database_specific")).alias("_severity"))
    text = F.when(F.trim("_summary") != "", F.col("_summary"))
    return found.join(own, F.col("id") == F.col("_id"), "left").select(
        "seq", "id", "package_name", "ecosystem", "version",
        F.coalesce("_severity", "severity").alias("severity"),
        F.when(F.col("_severity").isNotNull(), F.lit(False)).otherwise(F.col("severity_estimated")).alias("severity_estimated"),
        F.coalesce(text, "summary").alias("summary"),
    )


def merged_aliases(found: DataFrame, details: DataFrame) -> DataFrame:
    """Findings without the records of other databases for the same vulnerability.

    Ids whose least id or alias agrees are a group; the first RUSTSEC id of it is kept, or
    else its first id. All rows of kept ids stay; the first row of each takes over a real
    severity and a summary from merged ids if its own is estimated or empty. ``details`` has one row an
    id; of several, any is taken.
    """
    alias = details.select(F.col("id").alias("_id"), F.col("aliases"), F.col("summary").alias("d_summary"), detail_severity(F.col("database_specific")).alias("d_severity")).dropDuplicates(["_id"])
    # Of an id with very many rows only one goes on.
    ids = found.groupBy("id").agg(F.min("seq").alias("seq")).join(alias, F.col("id") == F.col("_id"), "left")
    canonical = F.array_min(F.concat(F.array("id"), F.coalesce("aliases", F.array().cast("array<string>"))))
    ids = ids.withColumn("canonical", canonical)
    # Groups are as small as the lists of aliases that name them; both windows deal ids alike, so they are dealt once.
    group = Window.partitionBy("canonical")
    chosen = ids.withColumn("chosen", F.min_by("id", F.struct(~F.col("id").startswith("RUSTSEC-"), F.col("seq"))).over(group))
    other = F.col("id") != F.col("chosen")
    kept = chosen.select(
        F.col("id").alias("k"), "chosen", F.col("seq").alias("k_seq"),
        F.min_by("d_severity", F.when(other & F.col("d_severity").isNotNull(), F.col("seq"))).over(group).alias("g_severity"),
        F.min_by("d_summary", F.when(other & (F.trim("d_summary") != ""), F.col("seq"))).over(group).alias("g_summary"),
    ).where("k = chosen")
    rows = found.join(kept, F.col("id") == F.col("k"))
    head = F.col("seq") == F.col("k_seq")
    better = head & F.col("severity_estimated") & F.col("g_severity").isNotNull()
    return rows.select(
        "seq", "id", "package_name", "ecosystem", "version",
        F.when(better, F.col("g_severity")).otherwise(F.col("severity")).alias("severity"),
        F.when(better, F.lit(False)).otherwise(F.col("severity_estimated")).alias("severity_estimated"),
        F.when(head & (F.col("summary") == "") & F.col("g_summary").isNotNull(), F.col("g_summary")).otherwise(F.col("summary")).alias("summary"),
    )


def _lines(source: Column) -> Column:
    return F.transform(F.split(source, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))


def _unquoted(x: Column) -> Column:
    return F.regexp_replace(x, "^['\"]+|['\"]+$", "")


def rust_imports(source: Column) -> Column:
    def one(x: Column) -> Column:
        used = F.trim(F.substring_index(F.regexp_replace(x, "^use ", ""), "::", 1))
        extern = F.trim(F.substring_index(F.regexp_replace(x, "^extern crate ", ""), ";", 1))
        return F.when(x.startswith("use ") & ~used.isin("", "super", "self", "crate"), used).when(x.startswith("extern crate ") & (extern != ""), extern)

    return F.array_compact(F.transform(_lines(source), one))


def javascript_imports(source: Column) -> Column:
    def one(x: Column) -> Column:
        moved = x.startswith("import ") & x.contains(" from ")
        after = F.trim(F.element_at(F.split(x, " from "), 2))
        module = F.when(moved, _unquoted(F.regexp_replace(after, ";+$", ""))).when(x.rlike(r"require\(.*\)"), _unquoted(F.trim(F.regexp_extract(x, r"^.*?require\(([^)]*)\)", 1))))
        return F.when(~module.startswith("."), npm_package(module))

    return F.array_compact(F.transform(_lines(source), one))


def go_imports(source: Column) -> Column:
    """Modules of single imports and import blocks; a line with a closing bracket ends a block."""
    start = F.expr("named_struct('open', false, 'out', cast(array() as array<string>))")

    def step(acc: Column, x: Column) -> Column:
        begins = x.startswith("import")
        ends = ~begins & acc["open"] & x.contains(")")
        is_open = F.when(begins, acc["open"] | x.contains("(")).when(ends, F.lit(False)).otherwise(acc["open"])
        module = F.regexp_extract(x, '^[^"]*"([^"]+)"', 1)
        taken = (begins | (acc["open"] & ~ends)) & (module != "")
        return F.struct(is_open.alias("open"), F.when(taken, F.concat(acc["out"], F.array(module))).otherwise(acc["out"]).alias("out"))

    return F.array_distinct(F.aggregate(_lines(source), start, step)["out"])


def imports(files: DataFrame) -> DataFrame:
    """(path, import_key) of files (path, source), by their extension."""
    path, source = F.col("path"), F.col("source")
    found = F.when(path.endswith(".rs"), rust_imports(source)).when(path.endswith(".js") | path.endswith(".jsx"), javascript_imports(source)).when(path.endswith(".go"), go_imports(source))
    return files.select("path", F.explode(F.array_distinct(found)).alias("import_key"))


def _import_key() -> Column:
    """The key under which files import the package of a finding."""
    return F.when(F.col("ecosystem") == "crates.io", crate_import(F.col("package_name"))).otherwise(F.col("package_name"))


def file_findings(files: DataFrame, found: DataFrame, used: DataFrame) -> DataFrame:
    """(path, max_rank, cve_count) of all files from findings and imports (path, import_key); 0 without findings.

    Findings are counted per import key before they meet the files that use it, so there is no row for each file and finding of a package.
    """
    per_key = found.groupBy(_import_key().alias("import_key")).agg(F.max(severity_rank(F.col("severity"))).alias("rank"), F.count("*").alias("n"))
    worst = used.distinct().join(per_key, "import_key").groupBy("path").agg(F.max("rank").alias("max_rank"), F.sum("n").alias("cve_count"))
    return files.select("path").join(worst, "path", "left").select("path", F.coalesce("max_rank", F.lit(0)).alias("max_rank"), F.coalesce("cve_count", F.lit(0)).cast("int").alias("cve_count"))


def with_affected_files(found: DataFrame, used: DataFrame) -> DataFrame:
    """Findings with the sorted paths of the files that import their package; a package's list is made once, however many findings it has."""
    keyed = found.withColumn("_key", _import_key())
    wanted = used.join(keyed.select(F.col("_key").alias("import_key")).distinct(), "import_key", "left_semi")
    lists = wanted.groupBy(F.col("import_key").alias("_used")).agg(F.array_sort(F.collect_set("path")).alias("affected_files"))
    return keyed.join(lists, F.col("_key") == F.col("_used"), "left").drop("_key", "_used").withColumn("affected_files", F.coalesce("affected_files", F.array().cast("array<string>")))


def dependency_dimension(parsed: DataFrame, counts: DataFrame, incomplete: bool) -> DataFrame:
    """From ``file_findings`` of parsed files; ``incomplete`` says that advisories could not be asked for, so no file has complete data."""
    rows = counts.join(parsed.select("path", "parse_incomplete"), "path")
    missing = F.lit(incomplete) | F.col("parse_incomplete")
    risk = dependency_risk(F.col("max_rank"), F.col("cve_count"))
    detail = F.to_json(F.struct("max_rank", "cve_count"))
    return with_mean(rows, F.when(~missing, risk)).transform(dimension(4, risk, F.col("repo_mean"), missing, "no advisories", detail))

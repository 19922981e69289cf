"""The registered queries over the supplied tables, each with SQL for DuckDB.

The tables hold no repositories, so roles are mapped: events are commits (the key ``k`` of
``props`` is the file, ``user_id`` the author, an error an incident), documents are source
texts, labels are partial signals, parts and line items are packages and findings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark.functions import labels, scores, strings
from siltmark.operators import complexity, dependency, duplication, history, scoring, testing
from siltmark.operators.ranking import first_rows
from siltmark.plans import report
from siltmark.schemas import DIMENSIONS, FORCED_IGNORES
from siltmark.sources import coverage, files, lockfiles

#: 2024-01-31T00:00:00Z, the moment that queries on events look back from.
AS_OF = 1706659200

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str = "") -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(*names: str, digits: int = 6) -> list[Column]:
    return [F.round(n, digits).alias(n) for n in names]


def event_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as commits of files: (path, commit_id, commit_ts, author, is_incident)."""
    return table(spark, sf_dir, "events").select(
        F.get_json_object("props", "$.k").alias("path"),
        F.col("event_id").alias("commit_id"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("commit_ts"),
        F.col("user_id").cast("string").alias("author"),
        (F.col("event_type") == "error").alias("is_incident"),
    )


_HISTORY = """h AS (
  SELECT json_extract_string(props, '$.k') AS path, event_id, floor(epoch(ts))::BIGINT AS commit_ts,
         user_id::VARCHAR AS author, event_type = 'error' AS is_incident
  FROM events
)"""
_RISK = f"""w AS (
  SELECT *, pow(0.5::DOUBLE, greatest(0::DOUBLE, ({AS_OF} - commit_ts)::DOUBLE) / (86400.0::DOUBLE * 30.44) / 6) AS weight FROM h
), r AS (
  SELECT path, sum(CASE WHEN is_incident THEN weight ELSE 0 END) / sum(weight) AS density,
         count(*) FILTER ({AS_OF} - commit_ts <= 90 * 86400) AS recent, count(DISTINCT author) AS authors, count(*) AS commits
  FROM w GROUP BY path
), risk AS (
  SELECT *, least(100::DOUBLE, greatest(0::DOUBLE, density * 60 + least(100::DOUBLE, recent / 90::DOUBLE * 100) * 0.2::DOUBLE
         + least(100::DOUBLE, authors * 10) * 0.2::DOUBLE)) AS change_risk FROM r
)"""


@query(f"WITH {_HISTORY}, {_RISK} SELECT path, round(density, 6) AS incident_density, recent AS recent_commits, authors, commits, round(change_risk, 6) AS change_risk FROM risk")
def change_risk_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: decayed incident density, recent commits and authors as change risk."""
    out = history.change_risks(event_history(spark, sf_dir), AS_OF)
    return out.select("path", *rounded("incident_density"), "recent_commits", "authors", "commits", *rounded("change_risk"))


@query(f"WITH {_HISTORY} SELECT path, count(DISTINCT event_id)::INTEGER AS commit_count, count(DISTINCT author)::INTEGER AS distinct_authors, greatest(0, floor(({AS_OF} - max(commit_ts)) / 86400))::INTEGER AS last_modified_days_ago, (count(*) FILTER (is_incident))::INTEGER AS incident_commit_count FROM h GROUP BY path")
def file_git_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = event_history(spark, sf_dir)
    none = spark.createDataFrame([], "path string, final string")
    return history.git_metrics(h, h.select(F.col("path")).distinct().toDF("path"), none, AS_OF)


_WORDS = "fix|bug|revert|hotfix|patch|error|crash"


@query(f"SELECT doc_id, regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])({_WORDS})([^\\p{{L}}\\p{{M}}\\p{{N}}_]|$)') AS is_incident FROM documents UNION ALL SELECT -1 - conv_id * 1000 - turn, regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])({_WORDS})([^\\p{{L}}\\p{{M}}\\p{{N}}_]|$)') FROM conversations")
def incident_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    talk = table(spark, sf_dir, "conversations").select((F.lit(-1) - F.col("conv_id") * 1000 - F.col("turn")).alias("doc_id"), "text")
    return docs.unionByName(talk).select("doc_id", strings.is_incident(F.col("text")).alias("is_incident"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'unknown-author' ELSE lower(trim('  ' || c_name || '@X.COM ')) END AS author FROM customer")
def author_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    email = F.when(F.col("c_custkey") % 14 == 0, F.lit("   ")).when(F.col("c_custkey") % 7 != 0, F.concat(F.lit("  "), F.col("c_name"), F.lit("@X.COM ")))
    return table(spark, sf_dir, "customer").select("c_custkey", strings.author(email).alias("author"))


@query("SELECT n_name, lower(n_name) || CASE WHEN n_nationkey % 4 = 0 THEN '.rs' WHEN n_nationkey % 4 = 1 THEN '.JSX' WHEN n_nationkey % 4 = 2 THEN '.go' ELSE '.md' END AS path, CASE n_nationkey % 4 WHEN 0 THEN 'rust' WHEN 1 THEN 'javascript' WHEN 2 THEN 'go' ELSE 'unknown' END AS language FROM nation")
def file_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, (".rs", ".JSX", ".go", ".md"))), F.col("n_nationkey") % 4 + 1)
    rows = table(spark, sf_dir, "nation").select("n_name", F.concat(F.lower("n_name"), ext).alias("path"))
    return rows.withColumn("language", strings.language(F.col("path")))


@query("""
WITH p AS (SELECT o_orderkey, o_custkey, o_totalprice, count(*) OVER c AS n, min(o_totalprice) OVER c AS lo, max(o_totalprice) OVER c AS hi,
  rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) AS r FROM orders WINDOW c AS (PARTITION BY o_custkey))
SELECT o_orderkey, CASE WHEN n < 5 OR lo = hi THEN NULL ELSE round(r::DOUBLE / n * 100, 6) END AS percentile FROM p
""")
def repo_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return complexity.with_percentile(orders, "o_totalprice", by=["o_custkey"]).select("o_orderkey", *rounded("percentile"))


_METRICS = """m AS (
  SELECT p_partkey, p_size AS cc, p_partkey % 13 AS depth, p_size * 1.5::DOUBLE AS len FROM part
), c AS (
  SELECT *, least(100::DOUBLE, greatest(0::DOUBLE, cc * 0.4::DOUBLE + depth * 6::DOUBLE + len * 0.2::DOUBLE)) AS raw,
    (CASE WHEN cc < 10 THEN 15 WHEN cc < 20 THEN 50 WHEN cc < 50 THEN 80 ELSE 100 END) * 0.7::DOUBLE
    + (CASE WHEN depth <= 4 THEN 15 WHEN depth <= 7 THEN 50 WHEN depth <= 10 THEN 80 ELSE 100 END) * 0.3::DOUBLE AS bands FROM m
), v AS (
  SELECT *, round(raw, 9) AS raw9, rank() OVER (ORDER BY round(raw, 9)) / count(*) OVER ()::DOUBLE * 100 AS percentile FROM c
), comp AS (
  SELECT p_partkey, raw9 AS raw, bands, percentile, 0.5 * percentile + 0.5 * bands AS risk FROM v
)"""


def part_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as parsed files with metrics."""
    cc, depth, length = F.col("p_size"), F.col("p_partkey") % 13, F.col("p_size") * 1.5
    rows = table(spark, sf_dir, "part").select("p_partkey", F.round(scores.complexity_raw(cc, depth, length), 9).alias("raw"), scores.complexity_bands(cc, depth).alias("bands"))
    rows = complexity.with_percentile(rows, "raw")
    return rows.withColumn("risk", scores.complexity_risk(F.col("percentile"), F.col("bands")))


@query(f"WITH {_METRICS} SELECT p_partkey, round(raw, 6) AS raw, round(bands, 6) AS bands, round(percentile, 6) AS percentile, round(risk, 6) AS risk FROM comp")
def complexity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_complexity(spark, sf_dir).select("p_partkey", *rounded("raw", "bands", "percentile", "risk"))


@query("""
SELECT l_orderkey, coalesce(round(avg(l_quantity)), 1)::INTEGER AS cyclomatic_complexity, max(l_linenumber) AS max_if_nesting_depth,
  round(sum(l_linenumber)::DOUBLE / sum(l_linenumber + 1), 6) AS nested_if_ratio, round(avg(l_quantity::INTEGER + 1), 6) AS avg_function_length,
  max(l_quantity::INTEGER + 1)::INTEGER AS max_function_length FROM lineitem GROUP BY l_orderkey
""")
def function_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as functions of an order's file."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("path"), F.lit(0).alias("start_line"), F.col("l_quantity").cast("int").alias("end_line"), F.col("l_quantity").alias("complexity"),
        F.col("l_linenumber").alias("if_nested"), (F.col("l_linenumber") + 1).alias("if_total"), F.col("l_linenumber").alias("if_max_depth"),
    )
    out = complexity.aggregated_metrics(rows).withColumnRenamed("path", "l_orderkey")
    return out.select("l_orderkey", "cyclomatic_complexity", "max_if_nesting_depth", *rounded("nested_if_ratio", "avg_function_length"), "max_function_length")


_SHAPE = "regexp_replace(regexp_replace(text, '[\\p{L}_][\\p{L}\\p{N}_]*', 'IDENT', 'g'), '[0-9]+', 'NUM', 'g')"


@query(f"WITH s AS (SELECT doc_id, sha256({_SHAPE}) AS structure, len(string_split(text, chr(10))) AS n FROM documents), g AS (SELECT structure, count(*) AS members FROM s WHERE n >= 2 GROUP BY structure HAVING count(*) >= 2) SELECT doc_id, members FROM s JOIN g USING (structure) WHERE n >= 2")
def structural_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.lit(1).alias("start_line"), F.size(F.split("text", "\n")).alias("end_line"), strings.normalised_structure(F.col("text")).alias("tokens"))
    return duplication.duplicate_blocks(docs, 2).select(F.col("path").alias("doc_id"), "members")


@query("""
WITH r AS (SELECT l_orderkey AS path, l_partkey % 40 AS s, l_partkey % 40 + l_quantity::INTEGER AS e FROM lineitem),
n AS (SELECT path, count(DISTINCT line)::BIGINT AS lines FROM r, LATERAL unnest(range(s, e + 1)) u(line) GROUP BY path)
SELECT path, lines, round(least(100::DOUBLE, lines / 120::DOUBLE * 150), 6) AS risk FROM n
""")
def duplicate_line_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("l_partkey") % 40
    ranges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), start.alias("start_line"), (start + F.col("l_quantity").cast("int")).alias("end_line"))
    out = duplication.duplicated_lines(ranges)
    return out.select("path", F.col("lines").cast("long").alias("lines"), F.round(scores.duplication_risk(F.col("lines"), F.lit(120)), 6).alias("risk"))


@query("SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))::INTEGER AS loc FROM documents")
def loc_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", strings.non_blank_lines(F.col("text")).alias("loc"))


@query("""
WITH c AS (SELECT doc_id, quality * 60.0::DOUBLE + toxic * 20 AS pct FROM labels), m AS (SELECT avg(100 - pct) AS gap FROM c),
s AS (SELECT doc_id, len(text)::INTEGER AS test_loc, greatest(1, n_chars % 5000)::INTEGER AS impl_loc, (n_chars % 40)::INTEGER AS asserts FROM documents WHERE text LIKE '%the%'),
r AS (SELECT d.doc_id, s.test_loc IS NULL AS no_test, c.pct IS NULL AS no_pct, coalesce(100 - c.pct, m.gap, 50) AS gap, s.* EXCLUDE (doc_id)
  FROM documents d LEFT JOIN s USING (doc_id) LEFT JOIN c USING (doc_id) CROSS JOIN m)
SELECT doc_id, CASE WHEN no_test THEN 0 ELSE round(least(100::DOUBLE, gap * 0.4::DOUBLE + (100 - least(100::DOUBLE, test_loc::DOUBLE / impl_loc * 100)) * 0.25::DOUBLE
  + (100 - least(100::DOUBLE, asserts::DOUBLE / greatest(1, test_loc) * 20)) * 0.35::DOUBLE + CASE WHEN asserts = 0 AND test_loc > 0 THEN 15 ELSE 0 END), 6) END AS risk_score,
  CASE WHEN no_test THEN 'not_applicable' WHEN no_pct THEN 'data_missing' ELSE 'full' END AS confidence FROM r
""")
def coverage_gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test dimension with documents as files, labels as coverage; documents that mention "the" are tested."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text", "n_chars")
    stats = docs.where("contains(text, 'the')").select("path", F.array().cast("array<string>").alias("test_files"), F.length("text").alias("test_loc"), F.greatest(F.lit(1), F.col("n_chars") % 5000).cast("int").alias("impl_loc"), (F.col("n_chars") % 40).cast("int").alias("assertions"))
    pct = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("path"), (F.col("quality") * 60.0 + F.col("toxic") * 20).alias("pct"))
    out = testing.test_dimension(docs, stats, pct)
    return out.select(F.col("path").alias("doc_id"), *rounded("risk_score"), F.col("confidence.type").alias("confidence"))


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as file paths, some of them tests by name or by folder."""
    k = F.col("p_partkey")
    name = (k / 4).cast("long").cast("string")
    return table(spark, sf_dir, "part").select(
        F.when(k % 4 == 0, F.concat(F.lit("src/m"), name, F.lit(".rs"))).when(k % 4 == 1, F.concat(F.lit("src/m"), name, F.lit("_test.rs"))).when(k % 4 == 2, F.concat(F.lit("tests/m"), name, F.lit(".rs"))).otherwise(F.concat(F.lit("app/test_m"), name, F.lit(".js"))).alias("path")
    )


_PATHS = """f AS (SELECT CASE p_partkey % 4 WHEN 0 THEN 'src/m' || (p_partkey // 4) || '.rs' WHEN 1 THEN 'src/m' || (p_partkey // 4) || '_test.rs'
  WHEN 2 THEN 'tests/m' || (p_partkey // 4) || '.rs' ELSE 'app/test_m' || (p_partkey // 4) || '.js' END AS path FROM part)"""
_BESIDE = """b AS (SELECT path, regexp_extract(path, '^(.*/)[^/]*$', 1) AS dir, regexp_extract(path, '([^/]*)\\.[^./]*$', 1) AS stem, regexp_extract(path, '\\.([^./]*)$', 1) AS ext FROM f),
cand AS (SELECT path, unnest([dir || stem || '_test.' || ext, dir || stem || '.test.' || ext, dir || 'test_' || stem || '.' || ext]) AS test_path FROM b),
r1 AS (SELECT cand.path, cand.test_path, 1 AS rule FROM cand JOIN f ON f.path = cand.test_path)"""


@query(f"WITH {_PATHS}, {_BESIDE} SELECT path, test_path FROM r1")
def same_key_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testing.same_directory_links(_paths(spark, sf_dir))


_BELOW = """t AS (SELECT path AS test_path, regexp_extract(path, '^(.*)tests/(.+\\.(?:rs|js|jsx))$', 2) AS rel FROM f WHERE path LIKE 'tests/%'),
t2 AS (SELECT test_path, rel, regexp_extract(rel, '^(.*)\\.[^.]*$', 1) AS stem, regexp_extract(rel, '\\.([^.]*)$', 1) AS ext FROM t),
c3 AS (SELECT test_path, unnest(['src/' || stem || '.' || ext, 'lib/' || stem || '.' || ext, 'app/' || stem || '.' || ext, 'src/lib.rs', 'src/main.rs']) AS path FROM t2),
r3 AS (SELECT c3.path, c3.test_path, 3 AS rule FROM c3 JOIN f ON f.path = c3.path)"""


@query(f"WITH {_PATHS}, {_BESIDE}, {_BELOW}, a AS (SELECT * FROM r1 UNION ALL SELECT * FROM r3) SELECT path, test_path, rule FROM (SELECT *, min(rule) OVER (PARTITION BY path) AS first FROM a) WHERE rule = first")
def rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = _paths(spark, sf_dir)
    links = testing.same_directory_links(paths).withColumn("rule", F.lit(1)).unionByName(testing.tests_directory_links(paths).withColumn("rule", F.lit(3)))
    return testing.first_rule(links)


_SEVERITY = "CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '4-NOT SPECIFIED' THEN 'low' ELSE 'none' END"
_RANK = "CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 1 ELSE 0 END"


@query(f"""
WITH k AS (SELECT o_orderkey, {_RANK} AS rank, 'pkg-' || (o_orderkey % 97) AS package FROM orders),
p AS (SELECT replace(package, '-', '_') AS import_key, max(rank) AS rank, count(*) AS n FROM k GROUP BY 1),
u AS (SELECT DISTINCT l_suppkey AS path, 'pkg_' || (l_partkey % 97) AS import_key FROM lineitem),
h AS (SELECT path, max(rank) AS max_rank, sum(n)::INTEGER AS cve_count FROM u JOIN p USING (import_key) GROUP BY path)
SELECT s_suppkey AS path, coalesce(max_rank, 0)::INTEGER AS max_rank, coalesce(cve_count, 0)::INTEGER AS cve_count,
  round(least(100::DOUBLE, coalesce(max_rank, 0) * 15::DOUBLE + CASE WHEN cve_count IS NULL THEN 0 WHEN cve_count = 1 THEN 15 WHEN cve_count <= 4 THEN 20 ELSE 25 END), 6) AS risk
FROM supplier LEFT JOIN h ON h.path = s_suppkey
""")
def dependency_findings_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as findings of packages, suppliers as files that import them."""
    priority = F.col("o_orderpriority")
    severity = F.when(priority == "1-URGENT", "critical").when(priority == "2-HIGH", "high").when(priority == "3-MEDIUM", "medium").when(priority == "4-NOT SPECIFIED", "low").otherwise("none")
    found = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("pkg-"), (F.col("o_orderkey") % 97).cast("string")).alias("package_name"), F.lit("crates.io").alias("ecosystem"), severity.alias("severity"))
    used = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("path"), F.concat(F.lit("pkg_"), (F.col("l_partkey") % 97).cast("string")).alias("import_key"))
    files = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("path"))
    out = dependency.file_findings(files, found, used)
    return out.select("path", "max_rank", "cve_count", F.round(scores.dependency_risk(F.col("max_rank"), F.col("cve_count")), 6).alias("risk"))


@query("""
WITH f AS (SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN 'RUSTSEC-' ELSE 'GHSA-' END || (o_orderkey % 500) AS id,
  CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 's' || o_orderkey END AS summary FROM orders),
d AS (SELECT *, least(id, 'CVE-' || (CAST(regexp_extract(id, '[0-9]+') AS INTEGER) % 100)) AS canonical FROM f),
m AS (SELECT canonical, id, min(seq) AS seq FROM d GROUP BY ALL),
k AS (SELECT canonical, arg_min(id, (CASE WHEN starts_with(id, 'RUSTSEC-') THEN 0 ELSE 1 END) * 1000000000000 + seq) AS chosen FROM m GROUP BY canonical)
SELECT seq, id, CASE WHEN seq = min(seq) OVER (PARTITION BY id) AND summary = '' AND EXISTS (SELECT 1 FROM m JOIN k USING (canonical) WHERE k.chosen = d.id AND m.id <> d.id)
  THEN (SELECT 'about ' || arg_min(m.id, m.seq) FROM m JOIN k USING (canonical) WHERE k.chosen = d.id AND m.id <> d.id) ELSE summary END AS summary
FROM d WHERE id IN (SELECT chosen FROM k)
""")
def alias_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as findings under ids of two databases, a hundred vulnerabilities in all."""
    k = F.col("o_orderkey")
    ident = F.concat(F.when(k % 3 == 0, "RUSTSEC-").otherwise("GHSA-"), (k % 500).cast("string"))
    found = table(spark, sf_dir, "orders").select(k.alias("seq"), ident.alias("id"), F.lit("p").alias("package_name"), F.lit("crates.io").alias("ecosystem"), F.lit("1").alias("version"), F.lit("medium").alias("severity"), F.lit(True).alias("severity_estimated"), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("s"), k.cast("string"))).alias("summary"))
    number = F.regexp_extract("id", "[0-9]+", 0).cast("int") % 100
    details = found.select("id").distinct().select("id", F.concat(F.lit("about "), F.col("id")).alias("summary"), F.array(F.concat(F.lit("CVE-"), number.cast("string"))).alias("aliases"), F.lit(None).cast("string").alias("database_specific"))
    return dependency.merged_aliases(found, details).select("seq", "id", "summary")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity % 7 = 0 THEN 'medium' WHEN l_quantity / 5 >= 9 THEN 'critical' WHEN l_quantity / 5 >= 7 THEN 'high' WHEN l_quantity / 5 >= 4 THEN 'medium' ELSE 'low' END AS severity, l_quantity % 7 = 0 AS estimated FROM lineitem")
def severity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.when(F.col("l_quantity") % 7 != 0, F.col("l_quantity") / 5)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scores.cvss_severity(score).alias("severity"), score.isNull().alias("estimated"))


@query("""
WITH m AS (SELECT p_partkey AS k, p_partkey % 5 AS av, p_partkey // 5 % 2 AS ac, p_partkey // 10 % 3 AS pr, p_partkey // 30 % 2 AS ui, p_partkey // 60 % 2 AS s, p_partkey // 120 % 3 AS c, p_partkey // 360 % 3 AS i, p_partkey // 1080 % 4 AS a FROM part),
w AS (SELECT *, [0.85, 0.62, 0.55, 0.20, 0.5][av + 1]::DOUBLE * [0.77, 0.44][ac + 1]::DOUBLE * [0.85, 0.62, 0.27][pr + 1]::DOUBLE * [0.85, 0.62][ui + 1]::DOUBLE * 8.22::DOUBLE AS ex,
  1 - (1 - [0.56, 0.22, 0.0][c + 1]::DOUBLE) * (1 - [0.56, 0.22, 0.0][i + 1]::DOUBLE) * (1 - [0.56, 0.22, 0.0, 0.0][a + 1]::DOUBLE) AS iss FROM m),
b AS (SELECT *, CASE WHEN s = 1 THEN 7.52::DOUBLE * (iss - 0.029::DOUBLE) - 3.25::DOUBLE * pow(iss - 0.02::DOUBLE, 15) ELSE 6.42::DOUBLE * iss END AS im FROM w)
SELECT k AS p_partkey, round((CASE WHEN im <= 0 THEN 0 WHEN s = 1 THEN least(10::DOUBLE, 1.25::DOUBLE * (im + ex) - 0.7::DOUBLE) ELSE least(10::DOUBLE, im + ex) END) * 10) / 10 AS score FROM b
""")
def cvss_vector_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors made of part numbers, with an unknown and a missing value among them."""
    k = F.col("p_partkey")

    def pick(values: str, every: int) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (F.floor(k / every) % len(values) + 1).cast("int"))

    a = pick("HLN-", 1080)
    vector = F.concat(
        F.lit("CVSS:3.1/AV:"), pick("NALP?", 1), F.lit("/AC:"), pick("LH", 5), F.lit("/PR:"), pick("NLH", 10), F.lit("/UI:"), pick("NR", 30),
        F.lit("/S:"), pick("UC", 60), F.lit("/C:"), pick("HLN", 120), F.lit("/I:"), pick("HLN", 360), F.when(a == "-", "").otherwise(F.concat(F.lit("/A:"), a)),
    )
    return table(spark, sf_dir, "part").select("p_partkey", scores.cvss_v3(vector).alias("score"))


_DIMS = """d AS (SELECT o_orderkey AS path, i AS dim_idx, ((o_orderkey * (i + 3) * 7919) % 10100) / 101::DOUBLE AS risk, (o_orderkey + i) % 4 = 0 AS gone FROM orders, (VALUES (0), (1), (2), (3), (4)) v(i)),
a AS (SELECT path, count(*) AS n, sum([0.30, 0.15, 0.25, 0.20, 0.10][dim_idx + 1]::DOUBLE * risk) AS weighted, sum([0.30, 0.15, 0.25, 0.20, 0.10][dim_idx + 1]::DOUBLE) AS w, max(risk) AS most, sum(risk) AS total FROM d WHERE NOT gone GROUP BY path),
x AS (SELECT *, (total - most) / nullif(n - 1, 0) AS others FROM a),
y AS (SELECT *, CASE WHEN n > 1 AND most > 50 AND most > others * 1.25::DOUBLE THEN (most - others) * 0.15::DOUBLE ELSE 0 END AS extra FROM x),
base AS (SELECT path, extra, least(100::DOUBLE, greatest(0::DOUBLE, weighted / w + extra)) AS score FROM y)"""


def order_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files with five made-up dimension results."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.explode(F.array(*map(F.lit, range(5)))).alias("dim_idx"))
    risk = (F.col("path") * (F.col("dim_idx") + 3) * 7919) % 10100 / F.lit(101.0)
    kind = F.when((F.col("path") + F.col("dim_idx")) % 4 == 0, "not_applicable").otherwise("full")
    return rows.select("path", "dim_idx", risk.alias("risk_score"), F.struct(kind.alias("type"), F.lit(None).cast("string").alias("detail")).alias("confidence"))


@query(f"WITH {_DIMS} SELECT path, round(score, 6) AS base_risk_score, round(extra, 6) AS extra_penalty FROM base")
def base_risk_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.compositions(order_dimensions(spark, sf_dir)).select("path", *rounded("base_risk_score", "extra_penalty"))


_HEAT = f"{_DIMS}, heat AS (SELECT path, path % 400 AS loc, round(score, 6) AS final_heat_score FROM base), top AS (SELECT *, row_number() OVER (ORDER BY final_heat_score DESC, path) AS rank FROM heat QUALIFY rank <= greatest(1, ceil((SELECT count(*) FROM heat) * 0.05::DOUBLE)))"


def order_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    composed = scoring.heats(scoring.compositions(order_dimensions(spark, sf_dir)))
    return composed.select("path", (F.col("path") % 400).alias("loc"), *rounded("final_heat_score"))


@query(f"WITH {_HEAT} SELECT round(least(100::DOUBLE, sum(final_heat_score * loc) / sum(loc) + 0.2::DOUBLE * (SELECT avg(final_heat_score) FROM top)), 6) AS repo_total_heat_score FROM heat")
def repo_total_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.repository_heat(order_heat(spark, sf_dir)).select(*rounded("repo_total_heat_score"))


@query(f"WITH {_HEAT} SELECT path, final_heat_score, rank::INTEGER AS rank FROM top")
def top_five_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.top_files(order_heat(spark, sf_dir)).select("path", "final_heat_score", "rank")


@query("SELECT 'n' || c_custkey AS path, 'n' || (c_custkey // 6 * 6 + 5) AS final FROM customer WHERE c_custkey % 6 < 5 AND c_custkey // 6 * 6 + 5 <= (SELECT max(c_custkey) FROM customer)")
def rename_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as names of files: five renames after each other lead to every sixth; the last, unfinished chain isn't renamed."""
    k = F.col("c_custkey")
    last = F.floor(k / 6) * 6 + 5
    most = table(spark, sf_dir, "customer").agg(F.max("c_custkey").alias("most"))
    rows = table(spark, sf_dir, "customer").join(F.broadcast(most), last <= F.col("most")).where(k % 6 < 5)
    ident = F.concat(F.lit("c"), k.cast("string"))
    commits = rows.select(ident.alias("commit_id"), (F.col("most") - k).cast("int").alias("walk_pos"), F.lit(0).cast("long").alias("commit_ts"), F.lit("").alias("author_email"), F.lit("").alias("message"))
    name = lambda n: F.concat(F.lit("n"), n.cast("string"))
    changes = rows.select(ident.alias("commit_id"), F.lit(0).alias("delta_pos"), name(k).alias("old_path"), name(k + 1).alias("new_path"), F.lit("R").alias("status"), F.lit(False).alias("is_binary"))
    return history.rename_map(commits, changes, max_commits=None)


@query("""
WITH s AS (SELECT o_custkey, avg(o_totalprice / 5000) AS mean, arg_max(o_totalprice / 5000, o_orderkey) AS last FROM orders GROUP BY o_custkey)
SELECT o_custkey AS path, round(least(1.09::DOUBLE, greatest(0.91::DOUBLE, 1 - 0.3::DOUBLE * least(0.3::DOUBLE, greatest(-0.3::DOUBLE, (mean - last) / greatest(mean, 1))))), 6) AS trend_coefficient FROM s
""")
def trend_coefficient(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshots = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("commit_date"), (F.col("o_totalprice") / 5000).alias("base_risk_score"))
    return scoring.trend_coefficients(snapshots).select("path", *rounded("trend_coefficient"))


@query("SELECT c_custkey, round(greatest(0.5::DOUBLE, (CASE WHEN c_custkey % 2 = 0 THEN 0.7 ELSE 1 END)::DOUBLE * (CASE WHEN c_custkey % 3 = 0 THEN 0.85 ELSE 1 END)::DOUBLE * (CASE WHEN c_custkey % 5 = 0 THEN 0.9 ELSE 1 END)::DOUBLE), 6) AS coefficient FROM customer")
def consistency_coefficient(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(scores.consistency(k % 3 == 0, k % 2 == 0, k % 5 == 0), 6).alias("coefficient"))


@query("""
WITH g AS (SELECT DISTINCT 'm' || (l_partkey % 300) AS name, (l_suppkey % 9) || '.0' AS version FROM lineitem)
SELECT name, version, 'Go' AS ecosystem, count(*) AS n FROM g GROUP BY ALL UNION ALL SELECT 'c' || (p_partkey % 100), '1.' || (p_size % 5), 'crates.io', count(*) FROM part GROUP BY 1, 2
""")
def union_distinct_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A go.sum and a Cargo.lock made of line items and parts, parsed, united and counted."""
    go = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("m"), (F.col("l_partkey") % 300).cast("string"), F.lit(" v"), (F.col("l_suppkey") % 9).cast("string"), F.when(F.col("l_linenumber") % 2 == 0, ".0/go.mod h1:x").otherwise(".0 h1:y")).alias("content"))
    cargo = table(spark, sf_dir, "part").select(F.concat(F.lit('[[package]]\nname = "c'), (F.col("p_partkey") % 100).cast("string"), F.lit('"\nversion = "1.'), (F.col("p_size") % 5).cast("string"), F.lit('"\n')).alias("content"))
    both = lockfiles.go_sum(go).drop("n").unionByName(lockfiles.cargo_lock(cargo).drop("n"))
    return both.groupBy("name", "version", "ecosystem").agg(F.count("*").alias("n"))


@query(f"WITH {_HEAT} SELECT CASE WHEN final_heat_score < 30 THEN 'low' WHEN final_heat_score < 60 THEN 'medium' WHEN final_heat_score < 80 THEN 'high' ELSE 'critical' END AS tier, count(*) AS files, sum(loc)::BIGINT AS loc FROM heat GROUP BY 1")
def tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_heat(spark, sf_dir).groupBy(strings.risk_tier(F.col("final_heat_score")).alias("tier")).agg(F.count("*").alias("files"), F.sum("loc").alias("loc"))


_MEANS = ", ".join(f"(SELECT round(sum(CASE WHEN gone THEN 0 ELSE risk END) / (SELECT count(*) FROM orders), 6) FROM d WHERE dim_idx = {i}) AS avg_{d}" for i, d in enumerate(DIMENSIONS))


@query(f"""WITH {_HEAT}, h AS (SELECT count(*) AS n, sum(loc)::BIGINT AS total_loc, avg((path % 10) / 10::DOUBLE) AS conf, count(*) FILTER ((path % 10) / 10::DOUBLE < 0.7::DOUBLE) AS low, count(*) FILTER (path % 3 > 0) AS hit, least(100::DOUBLE, sum(final_heat_score * loc) / sum(loc) + 0.2::DOUBLE * (SELECT avg(final_heat_score) FROM top)) AS total FROM heat)
SELECT n AS file_count, total_loc, {_MEANS}, round(conf, 6) AS avg_confidence, low AS low_confidence_files, hit AS affected_files, (SELECT count(*) FROM top) AS top_risk_files,
  round((SELECT count(*) FROM top) * 100::DOUBLE / n, 6) AS top_risk_percentage, round(total, 6) AS repo_total_heat_score FROM h""")
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one row of totals that a report begins with; dimensions that don't apply count as 0."""
    rows = order_dimensions(spark, sf_dir)
    gone = F.col("confidence.type") == "not_applicable"
    names = F.array(*map(F.lit, DIMENSIONS))
    dims = rows.select("path", "dim_idx", names[F.col("dim_idx")].alias("dim"), F.when(gone, 0.0).otherwise(F.col("risk_score")).alias("risk_score"))
    heat = order_heat(spark, sf_dir)
    files = heat.select("path", "loc", (F.col("path") % 10 / F.lit(10.0)).alias("consistency_coefficient"), (F.col("path") % 3).alias("cve_count"))
    repository = scoring.repository_heat(heat)
    out = report.summary(report.Scores(files, dims, files.limit(0), scoring.top_files(heat), repository))
    return out.select("file_count", "total_loc", *rounded(*[f"avg_{d}" for d in DIMENSIONS], "avg_confidence"), "low_confidence_files", "affected_files", "top_risk_files", *rounded("top_risk_percentage", "repo_total_heat_score"))


@query("SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'pkg' || n_nationkey WHEN 1 THEN '@s/n' || n_nationkey WHEN 2 THEN 'r' || n_nationkey WHEN 3 THEN 'use' || n_nationkey ELSE 'github.com/x/y' || n_nationkey END AS import_key FROM nation")
def import_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports of the three languages; relative and crate-local ones give no key."""
    k = F.col("n_nationkey").cast("string")
    source = (
        F.when(F.col("n_nationkey") % 5 == 0, F.concat(F.lit("import a from 'pkg"), k, F.lit("/sub';\nimport b from './local';")))
        .when(F.col("n_nationkey") % 5 == 1, F.concat(F.lit("import a from \"@s/n"), k, F.lit("/deep/er\"\n")))
        .when(F.col("n_nationkey") % 5 == 2, F.concat(F.lit("const q = require('r"), k, F.lit("/x');\nrequire(\"../y\")")))
        .when(F.col("n_nationkey") % 5 == 3, F.concat(F.lit("use crate::a;\nuse use"), k, F.lit("::b::C;\nuse super::x;")))
        .otherwise(F.concat(F.lit('package m\nimport (\n  q "github.com/x/y'), k, F.lit('"\n)\n')))
    )
    ext = F.element_at(F.array(*map(F.lit, ("js", "jsx", "js", "rs", "go"))), F.col("n_nationkey") % 5 + 1)
    files = table(spark, sf_dir, "nation").select(F.concat(k, F.lit("."), ext).alias("path"), source.alias("source"))
    return dependency.imports(files).select(F.substring_index("path", ".", 1).cast("int").alias("n_nationkey"), "import_key")


@query("SELECT 'src/f' || s_suppkey || '.rs' AS path, round((s_suppkey % 11) / 11::DOUBLE * 100, 6) AS pct FROM supplier WHERE s_suppkey % 13 > 0")
def lcov_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of its own for each supplier; files without lines drop out."""
    k = F.col("s_suppkey")
    text = F.concat(F.lit("TN:\nSF:./src/f"), k.cast("string"), F.lit(".rs\nDA:1,1\nLF:"), F.when(k % 13 == 0, "0").otherwise("11"), F.lit("\nLH:"), (k % 11).cast("string"), F.lit("\nend_of_record\n"))
    return coverage.lcov(table(spark, sf_dir, "supplier").select(text.alias("content"))).select("path", *rounded("pct"))


@query("SELECT 'src/g' || s_suppkey || '.js' AS path, round((s_suppkey % 4 > 0)::INTEGER * 50.0::DOUBLE + (s_suppkey % 3 > 0)::INTEGER * 50.0::DOUBLE, 6) AS pct FROM supplier")
def cobertura_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    text = F.concat(F.lit('<coverage>\n<class filename="src/g'), k.cast("string"), F.lit('.js">\n<line number="1" hits="'), (k % 4).cast("string"), F.lit('"/>\n<line number="2" hits="'), (k % 3).cast("string"), F.lit('"/>\n</class>\n</coverage>'))
    return coverage.cobertura(table(spark, sf_dir, "supplier").select(text.alias("content"))).select("path", *rounded("pct"))


@query("SELECT 'g' || (l_suppkey % 50) || '.go' AS path, round(avg((l_linenumber % 3 > 0)::INTEGER) * 100, 6) AS pct FROM lineitem GROUP BY 1")
def go_cover_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("mode: set\nexample.com/m/g"), (F.col("l_suppkey") % 50).cast("string"), F.lit(".go:1.1,2.2 3 "), (F.col("l_linenumber") % 3).cast("string"))
    return coverage.go_cover(table(spark, sf_dir, "lineitem").select(text.alias("content")), "example.com/m").select("path", *rounded("pct"))


@query("SELECT CASE WHEN count(*) FILTER (regexp_matches(lower(text), 'reset:|rebase|amend|force')) > 0 THEN 'detected' ELSE 'unknown' END AS history_rewrite FROM conversations")
def reflog_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.history_rewritten(table(spark, sf_dir, "conversations").select(F.col("text").alias("value")))


@query("SELECT page_id, len(regexp_replace(html, '[^<]', '', 'g'))::INTEGER AS tags, replace(replace(replace(html, '&', '&amp;'), '\"', '&quot;'), '<', '&lt;') AS escaped, regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g') AS dom_id, CASE WHEN len(html) > 400 THEN left(html, 400) || '...' ELSE html END AS note FROM pages")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text helpers on pages: counting, escaping, ids and shortening."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_count("html", F.lit("<")).alias("tags"), strings.xml_escaped(F.col("html")).alias("escaped"), strings.dom_id(F.col("url")).alias("dom_id"), strings.shortened(F.col("html")).alias("note"))


@query("SELECT doc_id, len(regexp_extract_all(' ' || regexp_replace(lower(text), '[^a-z0-9_]', ' ', 'g'), '[^a-z0-9_](assert|expect|the)'))::INTEGER AS marks FROM documents")
def left_bounded_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words counted by their left boundary alone, as assertions are."""
    named = F.replace(F.lower("text"), F.lit("the"), F.lit("assert"))
    return table(spark, sf_dir, "documents").select("doc_id", strings.asserts_in(named).alias("marks"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '复杂度' WHEN 1 THEN '重复代码' WHEN 2 THEN '测试' WHEN 3 THEN '变更风险' WHEN 4 THEN '依赖' ELSE '未知' END AS dimension,
  CASE o_orderkey % 3 WHEN 0 THEN '数据完整' WHEN 1 THEN '数据缺失' ELSE '不适用' END AS confidence, CASE o_orderkey % 3 WHEN 1 THEN 'why' ELSE '' END AS reason,
  CASE o_orderkey % 3 WHEN 0 THEN 'color-green' WHEN 1 THEN 'color-orange' ELSE 'color-muted' END AS confidence_class,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'High' WHEN '3-MEDIUM' THEN 'Medium' WHEN '4-NOT SPECIFIED' THEN 'Low' ELSE 'None' END AS severity,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'pill-critical' WHEN '2-HIGH' THEN 'pill-high' WHEN '3-MEDIUM' THEN 'pill-medium' WHEN '4-NOT SPECIFIED' THEN 'pill-low' ELSE 'pill-muted' END AS pill,
  CASE WHEN o_orderkey % 101 < 60 THEN 'stage-yellow' ELSE 'stage-red' END AS stage,
  CASE WHEN o_orderkey % 101 < 30 THEN 'score-low' WHEN o_orderkey % 101 < 60 THEN 'score-medium' WHEN o_orderkey % 101 < 80 THEN 'score-high' ELSE 'score-critical' END AS tier FROM orders
""")
def report_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a report shows for dimension, state, severity and score."""
    k, priority = F.col("o_orderkey"), F.col("o_orderpriority")
    kind = F.element_at(F.array(*map(F.lit, ("full", "data_missing", "not_applicable"))), (k % 3 + 1).cast("int"))
    state = F.struct(kind.alias("type"), F.lit("why").alias("detail"))
    severity = F.when(priority == "1-URGENT", "critical").when(priority == "2-HIGH", "high").when(priority == "3-MEDIUM", "medium").when(priority == "4-NOT SPECIFIED", "low").otherwise("none")
    score = k % 101
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", labels.dimension_at((k % 6).cast("int")).alias("dimension"), labels.confidence_label(state).alias("confidence"), labels.confidence_reason(state).alias("reason"),
        labels.confidence_class(state).alias("confidence_class"), labels.labelled(severity, labels.SEVERITY_TEXTS).alias("severity"), labels.labelled(severity, labels.SEVERITY_PILLS).alias("pill"),
        labels.final_stage_class(score).alias("stage"), labels.tier_class(score).alias("tier"),
    )


_FILES_SEEN = "SELECT p_partkey AS k, (CASE p_partkey % 4 WHEN 0 THEN 'target/' WHEN 1 THEN 'src/' WHEN 2 THEN 'a/node_modules/' ELSE 'b/' END) || 'f' || p_partkey || (CASE p_partkey % 3 WHEN 0 THEN '.generated.js' WHEN 1 THEN '.rs' ELSE '.go' END) AS path FROM part"


@query(f"SELECT path, path LIKE 'target/%' OR path LIKE '%/node_modules/%' OR path LIKE '%.generated.%' AS forced, path LIKE 'src/%.rs' AS asked FROM ({_FILES_SEEN})")
def ignore_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ignore patterns over file paths: the forced ones and one of a user's."""
    k = F.col("p_partkey")
    folder = F.element_at(F.array(*map(F.lit, ("target/", "src/", "a/node_modules/", "b/"))), (k % 4 + 1).cast("int"))
    ending = F.element_at(F.array(*map(F.lit, (".generated.js", ".rs", ".go"))), (k % 3 + 1).cast("int"))
    paths = table(spark, sf_dir, "part").select(F.concat(folder, F.lit("f"), k.cast("string"), ending).alias("path"))
    return paths.select("path", files.ignored(F.col("path"), FORCED_IGNORES).alias("forced"), files.ignored(F.col("path"), ("/src/*.rs",)).alias("asked"))


@query("""
WITH c AS (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) - 1 AS walk_pos, floor(epoch(ts))::BIGINT AS commit_ts, user_id, event_type FROM events),
t AS (SELECT DISTINCT 'f' || (CASE WHEN n = 7 THEN 8 ELSE n END) AS path, event_id FROM (SELECT event_id, unnest([event_id % 40, event_id % 9]) AS n FROM c WHERE walk_pos < 500))
SELECT path, count(*)::INTEGER AS commits, count(DISTINCT user_id)::INTEGER AS authors, (count(*) FILTER (event_type = 'error'))::INTEGER AS incidents FROM t JOIN c USING (event_id) GROUP BY path
""")
def capped_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest 500 events as commits of two files each, one of them renamed; binary files drop out."""
    events = first_rows(table(spark, sf_dir, "events"), [F.col("ts").desc(), F.col("event_id").desc()], 501).withColumn("walk_pos", F.col("rank") - 1)
    ident = F.col("event_id").cast("string")
    message = F.when(F.col("event_type") == "error", "fix it").otherwise("add fixture")
    commits = events.select(ident.alias("commit_id"), "walk_pos", F.unix_seconds(F.col("ts").cast("timestamp")).alias("commit_ts"), F.col("user_id").cast("string").alias("author_email"), message.alias("message"))
    touched = events.select(ident.alias("commit_id"), F.posexplode(F.array(F.col("event_id") % 40, F.col("event_id") % 9, F.lit(99))).alias("delta_pos", "n"))
    name = F.concat(F.lit("f"), F.col("n").cast("string"))
    changes = touched.select("commit_id", "delta_pos", name.alias("old_path"), name.alias("new_path"), F.lit("M").alias("status"), (F.col("n") == 99).alias("is_binary"))
    renames = spark.createDataFrame([("f7", "f8")], "path string, final string")
    rows = history.file_commits(commits, changes, renames, 500)
    return rows.groupBy("path").agg(F.count("*").cast("int").alias("commits"), F.countDistinct("author").cast("int").alias("authors"), F.count_if("is_incident").cast("int").alias("incidents"))


@query(f"""
WITH {_HISTORY}, {_RISK}, f AS (SELECT DISTINCT l_suppkey * 7 % 130 AS k FROM lineitem), m AS (SELECT avg(change_risk) AS mean FROM risk WHERE path::INTEGER IN (SELECT k FROM f))
SELECT f.k::VARCHAR AS path, round(coalesce(change_risk, mean), 6) AS risk_score, CASE WHEN change_risk IS NULL THEN 'data_missing' ELSE 'full' END AS confidence FROM f LEFT JOIN risk ON risk.path = f.k::VARCHAR CROSS JOIN m
""")
def mean_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change-risk dimension over files of which some have no history."""
    paths = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") * 7 % 130).cast("string").alias("path")).distinct()
    out = history.change_dimension(paths, event_history(spark, sf_dir), AS_OF)
    return out.select("path", *rounded("risk_score"), F.col("confidence.type").alias("confidence"))

"""Registered queries on the stages of a scan: dimensions with their states, advisories, histories, reports and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark.functions import hashes, labels, strings
from siltmark.operators import complexity, dependency, history, ignores, testing
from siltmark.operators.ordered import asof
from siltmark.plans.queries import query, rounded, table
from siltmark.schemas import MISSING_PARSE, MISSING_PARTIAL
from siltmark.sources import coverage

NAMES = ("report_levels", "complexity_states", "dependency_states", "advisory_answers", "tests_below", "renamed_timelines", "sniffed_reports", "module_names", "text_formats", "last_incident", "fnv_hashes", "layered_ignores")

_TIER = "CASE WHEN o_orderkey % 101 < 30 THEN '{}' WHEN o_orderkey % 101 < 60 THEN '{}' WHEN o_orderkey % 101 < 80 THEN '{}' ELSE '{}' END"
_SURE = "CASE WHEN o_orderkey % 11 >= 8 THEN '{}' WHEN o_orderkey % 11 >= 5 THEN '{}' ELSE '{}' END"


@query(f"""
SELECT o_orderkey, {_TIER.format("低风险", "中风险", "高风险", "严重风险")} AS level, {_TIER.format("color-green", "color-yellow", "color-orange", "color-red")} AS color,
  {_TIER.format("tier-low", "tier-mid", "tier-high", "tier-critical")} AS tier, {_TIER.format("fill-green", "fill-yellow", "fill-orange", "fill-red")} AS fill,
  {_TIER.format("pill-low", "pill-medium", "pill-high", "pill-critical")} AS pill,
  {_SURE.format("color-green", "color-yellow", "color-orange")} AS confidence_color, {_SURE.format("pill-low", "pill-medium", "pill-high")} AS confidence_pill,
  CASE WHEN o_orderkey % 2 = 0 THEN '低风险' ELSE {_TIER.format("低风险", "中风险", "高风险", "严重风险")} END AS dimension_level FROM orders
""")
def report_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a report shows for a score, a confidence and a file's dimension, which every other file lacks."""
    score, sure = (F.col("o_orderkey") % 101).cast("double"), F.col("o_orderkey") % 11 / F.lit(10.0)
    dims = F.when(F.col("o_orderkey") % 2 == 1, F.array(F.struct(score.alias("risk_score")))).otherwise(F.array().cast("array<struct<risk_score:double>>"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", labels.by_score(score, labels.RISK_LEVELS).alias("level"), labels.by_score(score, labels.SCORE_COLORS).alias("color"), labels.by_score(score, labels.RISK_TIERS).alias("tier"),
        labels.by_score(score, labels.HEAT_FILLS).alias("fill"), labels.tier_class(score, "pill").alias("pill"), labels.by_confidence(sure, labels.CONFIDENCE_COLORS).alias("confidence_color"),
        labels.by_confidence(sure, labels.CONFIDENCE_PILLS).alias("confidence_pill"), labels.by_score(labels.dimension_risk(dims, 0), labels.RISK_LEVELS).alias("dimension_level"),
    )


@query(f"""
WITH m AS (SELECT p_partkey AS path, p_partkey % 9 > 0 AS parsed, p_partkey % 5 = 0 AS part, p_size AS cc, p_partkey % 13 AS depth, p_size * 1.5::DOUBLE AS len FROM part),
c AS (SELECT *, least(100::DOUBLE, greatest(0::DOUBLE, cc * 0.4::DOUBLE + depth * 15.0::DOUBLE * 0.4::DOUBLE + len * 0.2::DOUBLE)) AS raw,
  (CASE WHEN cc < 10 THEN 15 WHEN cc < 20 THEN 50 WHEN cc < 50 THEN 80 ELSE 100 END) * 0.7::DOUBLE
  + (CASE WHEN depth <= 4 THEN 15 WHEN depth <= 7 THEN 50 WHEN depth <= 10 THEN 80 ELSE 100 END) * 0.3::DOUBLE AS bands FROM m),
v AS (SELECT path, rank() OVER (ORDER BY raw) / count(*) OVER ()::DOUBLE * 100 AS percentile, bands FROM c WHERE parsed),
r AS (SELECT path, percentile, 0.5::DOUBLE * percentile + 0.5::DOUBLE * bands AS risk FROM v), a AS (SELECT avg(risk) AS mean FROM r)
SELECT m.path, round(coalesce(risk, mean), 6) AS risk_score, CASE WHEN NOT parsed OR part THEN 'data_missing' ELSE 'full' END AS confidence,
  CASE WHEN NOT parsed THEN '{MISSING_PARSE}' WHEN part THEN '{MISSING_PARTIAL}' END AS reason, cc::VARCHAR AS cyclomatic, round(percentile, 6) AS percentile FROM m LEFT JOIN r USING (path) CROSS JOIN a
""")
def complexity_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The complexity dimension over parts as files, some of them unreadable to the parser, in full or in part."""
    k = F.col("p_partkey")
    metrics = table(spark, sf_dir, "part").select(
        k.alias("path"), (k % 9 > 0).alias("parsed"), (k % 5 == 0).alias("parse_incomplete"), F.col("p_size").alias("cyclomatic_complexity"), (k % 13).alias("max_if_nesting_depth"),
        F.lit(0.0).alias("nested_if_ratio"), (F.col("p_size") * 1.5).alias("avg_function_length"), F.col("p_size").alias("max_function_length"),
    )
    out = complexity.complexity_dimension(metrics)
    detail = lambda key: F.get_json_object("detail", f"$.{key}")
    return out.select("path", *rounded("risk_score"), F.col("confidence.type").alias("confidence"), F.col("confidence.detail").alias("reason"), detail("cyclomatic_complexity").alias("cyclomatic"), F.round(detail("percentile").cast("double"), 6).alias("percentile"))


@query("""
WITH k AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 1 ELSE 0 END AS rank, o_orderkey % 397 AS package FROM orders WHERE o_orderkey % 397 < 60),
p AS (SELECT package, max(rank) AS rank, count(*) AS n FROM k GROUP BY 1), u AS (SELECT DISTINCT l_partkey AS path, l_suppkey % 397 AS package FROM lineitem),
h AS (SELECT path, max(rank) AS most, sum(n) AS n FROM u JOIN p USING (package) GROUP BY path),
f AS (SELECT p_partkey AS path, p_partkey % 7 = 0 AS missing, coalesce(most, 0) AS most, coalesce(n, 0) AS n FROM part LEFT JOIN h ON path = p_partkey),
r AS (SELECT *, least(100::DOUBLE, most * 25 * 0.6::DOUBLE + (CASE WHEN n = 0 THEN 0 WHEN n = 1 THEN 60 WHEN n <= 4 THEN 80 ELSE 100 END) * 0.25::DOUBLE) AS risk FROM f),
a AS (SELECT avg(risk) AS mean FROM r WHERE NOT missing)
SELECT path, round(CASE WHEN missing THEN mean ELSE risk END, 6) AS risk_score, CASE WHEN missing THEN 'data_missing' ELSE 'full' END AS confidence, n::VARCHAR AS cve_count FROM r CROSS JOIN a
""")
def dependency_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dependency dimension as a scan forms it: parts as files that import suppliers' packages, orders as findings; every seventh file has no complete data."""
    priority = F.col("o_orderpriority")
    severity = F.when(priority == "1-URGENT", "critical").when(priority == "2-HIGH", "high").when(priority == "3-MEDIUM", "medium").when(priority == "4-NOT SPECIFIED", "low").otherwise("none")
    package = F.concat(F.lit("p-"), (F.col("o_orderkey") % 397).cast("string"))
    found = table(spark, sf_dir, "orders").where("o_orderkey % 397 < 60").select(F.col("o_orderkey").alias("seq"), package.alias("package_name"), F.lit("crates.io").alias("ecosystem"), severity.alias("severity"))
    used = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("path"), F.concat(F.lit("p_"), (F.col("l_suppkey") % 397).cast("string")).alias("import_key"))
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), (F.col("p_partkey") % 7 == 0).alias("parse_incomplete"))
    out = dependency.dependency_dimension(files, dependency.file_findings(files, found, used), False)
    return out.select("path", *rounded("risk_score"), F.col("confidence.type").alias("confidence"), F.get_json_object("detail", "$.cve_count").alias("cve_count"))


@query("""
WITH d AS (SELECT p_partkey AS pos, 'p' || p_partkey AS package_name, '1.' || (p_partkey % 5) AS version FROM part WHERE p_partkey % 10 > 0),
b AS (SELECT p_partkey AS pos, n, CASE n WHEN 0 THEN 'V' || (p_partkey % 50) ELSE 'W' || p_partkey END AS id, CASE WHEN p_partkey % 3 > 0 THEN 's' || n END AS summary,
  CASE WHEN n = 0 AND p_partkey % 6 = 1 THEN (p_partkey % 11)::DOUBLE END AS score FROM part, LATERAL unnest(range(0, p_partkey % 3)) x(n) WHERE p_partkey % 4 > 0),
e AS (SELECT 'V' || i AS id, CASE i % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE NULL END AS severity, CASE WHEN i % 2 = 0 THEN 'about ' || i ELSE ' ' END AS about FROM range(0, 40) x(i))
SELECT package_name, version, id, coalesce(severity, CASE WHEN score IS NULL THEN 'medium' WHEN score >= 9 THEN 'critical' WHEN score >= 7 THEN 'high' WHEN score >= 4 THEN 'medium' ELSE 'low' END) AS severity,
  severity IS NULL AND score IS NULL AS estimated, CASE WHEN trim(about) <> '' THEN about ELSE coalesce(summary, '') END AS summary FROM b JOIN d USING (pos) LEFT JOIN e USING (id)
""")
def advisory_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as dependencies; answers meet them by position, with null answers and answers without a dependency, then details by id."""
    k = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey")
    deps = parts.where("p_partkey % 10 > 0").select(k.alias("pos"), F.concat(F.lit("p"), k.cast("string")).alias("name"), F.concat(F.lit("1."), (k % 5).cast("string")).alias("version"), F.lit("npm").alias("ecosystem"))

    def vuln(n: int):
        ident = F.concat(F.lit("V"), (k % 50).cast("string")) if n == 0 else F.concat(F.lit("W"), k.cast("string"))
        score = F.when((k % 6 == 1) & F.lit(n == 0), F.concat(F.lit('{"score": '), (k % 11).cast("string"), F.lit("}")))
        return F.struct(ident.alias("id"), F.when(k % 3 > 0, F.lit(f"s{n}")).alias("summary"), score.alias("database_specific"))

    batch = parts.select(k.alias("pos"), F.when(k % 4 > 0, F.slice(F.array(vuln(0), vuln(1)), F.lit(1), (k % 3).cast("int"))).alias("vulns"))
    i = F.col("i")
    named = F.element_at(F.array(*map(F.lit, ('{"severity": "LOW"}', '{"severity": "Medium"}', '{"severity": "high"}', '{"severity": "INFO"}'))), (i % 4 + 1).cast("int"))
    ids = parts.select((k % 50).alias("i")).where("i < 40").distinct()
    details = ids.select(F.concat(F.lit("V"), i.cast("string")).alias("id"), F.when(i % 2 == 0, F.concat(F.lit("about "), i.cast("string"))).otherwise(" ").alias("summary"), F.array().cast("array<string>").alias("aliases"), named.alias("database_specific"))
    out = dependency.enriched(dependency.findings(deps, batch), details)
    return out.select("package_name", "version", "id", "severity", F.col("severity_estimated").alias("estimated"), "summary")


@query("""
WITH t AS (SELECT p_partkey // 4 AS m, CASE p_partkey % 4 WHEN 0 THEN 'tests/m' || (p_partkey // 4) || '_test.rs' WHEN 1 THEN 'tests/test_m' || (p_partkey // 4) || '.rs' WHEN 2 THEN 'tests/n_m' || (p_partkey // 4) || '.js' ELSE 'tests/m' || (p_partkey // 4) || '.test.js' END AS test_path FROM part),
f AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN 'src/m' || (p_partkey // 4) || '.rs' WHEN 2 THEN 'lib/n/m' || (p_partkey // 4) || '.js' ELSE 'app/m' || (p_partkey // 4) || '.js' END AS path, p_partkey // 4 AS m FROM part)
SELECT path, test_path FROM f JOIN t USING (m) WHERE (path LIKE 'src/%' AND test_path LIKE '%.rs') OR (path LIKE 'lib/n/%' AND test_path LIKE 'tests/n\\_%' ESCAPE '\\') OR (path LIKE 'app/%' AND test_path LIKE '%.test.js')
""")
def tests_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files below tests/ with the marks of tests in their names, and with a folder written as part of the name."""
    k = F.col("p_partkey")
    m = F.floor(k / 4).cast("string")
    parts = table(spark, sf_dir, "part").select("p_partkey")
    lit = F.lit
    tests = F.when(k % 4 == 0, F.concat(lit("tests/m"), m, lit("_test.rs"))).when(k % 4 == 1, F.concat(lit("tests/test_m"), m, lit(".rs"))).when(k % 4 == 2, F.concat(lit("tests/n_m"), m, lit(".js"))).otherwise(F.concat(lit("tests/m"), m, lit(".test.js")))
    code = F.when(k % 4 == 0, F.concat(lit("src/m"), m, lit(".rs"))).when(k % 4 == 2, F.concat(lit("lib/n/m"), m, lit(".js"))).otherwise(F.concat(lit("app/m"), m, lit(".js")))
    paths = parts.select(tests.alias("path")).unionByName(parts.select(code.alias("path")).distinct())
    return testing.tests_directory_links(paths)


@query("""
WITH e AS (SELECT event_id, 'f' || (event_id % 30) AS path, user_id::VARCHAR AS author, event_type = 'error' AS inc FROM events WHERE event_id % 5 > 0)
SELECT CASE WHEN path = 'f1' THEN 'f2' ELSE path END AS path, count(DISTINCT event_id) AS commits, count(DISTINCT author) AS authors, count(DISTINCT event_id) FILTER (inc) AS incidents FROM e WHERE path IN ('f0', 'f1', 'f2', 'f3', 'f29') GROUP BY 1
""")
def renamed_timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timelines of five files of HEAD from events as commits; every fifth commit is empty, and the newest one renames f1 to f2."""
    events = table(spark, sf_dir, "events")
    ident = F.col("event_id").cast("string")
    last = events.agg(F.max("event_id").alias("last")).first()["last"]
    message = F.when(F.col("event_type") == "error", "fix it").otherwise("add fixture")
    commits = events.select(ident.alias("commit_id"), (F.lit(last + 1) - F.col("event_id")).cast("int").alias("walk_pos"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("commit_ts"), F.col("user_id").cast("string").alias("author_email"), message.alias("message"))
    name = F.concat(F.lit("f"), (F.col("event_id") % 30).cast("string"))
    changes = events.where("event_id % 5 > 0").select(ident.alias("commit_id"), F.lit(0).alias("delta_pos"), name.alias("old_path"), name.alias("new_path"), F.lit("M").alias("status"), F.lit(False).alias("is_binary"))
    renames = history.rename_map(commits.limit(1).select(F.lit("r").alias("commit_id"), F.lit(0).alias("walk_pos")), commits.limit(1).select(F.lit("r").alias("commit_id"), F.lit(0).alias("delta_pos"), F.lit("f1").alias("old_path"), F.lit("f2").alias("new_path"), F.lit("R").alias("status")))
    head = spark.createDataFrame([(f"f{i}",) for i in (0, 2, 3, 29)], "path string")
    rows = history.timelines(history.file_commits(commits, changes, renames, last + 2), head, renames)
    return rows.groupBy("path").agg(F.countDistinct("commit_id").alias("commits"), F.countDistinct("author").alias("authors"), F.count_if("is_incident").alias("incidents"))


@query("SELECT (CASE WHEN s_suppkey % 2 = 0 THEN 'x' ELSE 'y' END) || s_suppkey AS path, round((s_suppkey % 4) / 4::DOUBLE * 100, 6) AS pct FROM supplier")
def sniffed_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of two formats, told apart by their first character that isn't blank."""
    k = F.col("s_suppkey")
    name = k.cast("string")
    hit = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.concat(F.lit('<line number="1" hits="'), (i <= k % 4).cast("int").cast("string"), F.lit('"/>'))), "\n")
    xml = F.concat(F.lit(' \n\t<coverage>\n<class filename="x'), name, F.lit('">\n'), hit, F.lit("\n</class>\n"))
    lcov = F.concat(F.lit("\nSF:y"), name, F.lit("\nLF:4\nLH:"), (k % 4).cast("string"), F.lit("\nend_of_record\n"))
    return coverage.any_report(table(spark, sf_dir, "supplier").select(F.when(k % 2 == 0, xml).otherwise(lcov).alias("content"))).select("path", *rounded("pct"))


@query("SELECT 'example.com/m' || n_nationkey AS module FROM nation WHERE n_nationkey % 3 > 0")
def module_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Module paths of go.mod texts, some of which have none."""
    name = F.concat(F.lit("// a\n  module   example.com/m"), F.col("n_nationkey").cast("string"), F.lit(" // b\ngo 1.22\n"))
    return coverage.go_module(table(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") % 3 > 0, name).otherwise("go 1.22\nrequire module v1\n").alias("content")))


@query("""
SELECT o_orderkey, format('{:,}', o_orderkey * 1009) AS thousands, printf('%.1f', o_orderkey / 8.0::DOUBLE + 0.03::DOUBLE) AS fixed,
  CASE WHEN o_orderkey % 11 >= 8 THEN 'high' WHEN o_orderkey % 11 >= 5 THEN 'medium' ELSE 'low' END AS sure, CASE o_orderkey % 3 WHEN 0 THEN 'data_missing: why' WHEN 1 THEN 'full' ELSE 'not_applicable' END AS state,
  'a' || o_orderkey || '、b' AS listed, CASE WHEN o_orderkey % 4 > 0 THEN 'sum' || o_orderkey ELSE '' END AS checksum, o_orderkey % 10 > 5 OR (o_orderkey % 10 = 5 AND o_orderkey % 7 > 3) AS newer FROM orders
""")
def text_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, states, lists, checksums and versions as a report or an update prints or reads them."""
    k = F.col("o_orderkey")
    state = F.struct(F.element_at(F.array(*map(F.lit, ("data_missing", "full", "not_applicable"))), (k % 3 + 1).cast("int")).alias("type"), F.lit("why").alias("detail"))
    sums = F.concat(F.lit("sum0  other\nsum"), k.cast("string"), F.when(k % 4 == 1, "  *").otherwise("  "), F.when(k % 4 > 0, "tool.tar.gz\n").otherwise("tool.tar\n"))
    version = F.concat((k % 10).cast("string"), F.lit("."), (k % 7).cast("string"), F.lit(".0"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", strings.thousands(k * 1009).alias("thousands"), strings.fixed(k / F.lit(8.0) + F.lit(0.03)).alias("fixed"), strings.confidence_tier(k % 11 / F.lit(10.0)).alias("sure"), strings.confidence_text(state).alias("state"),
        strings.listed(F.array(F.concat(F.lit("a"), k.cast("string")), F.lit("b"))).alias("listed"), F.coalesce(strings.checksum_of(sums, F.lit("tool.tar.gz")), F.lit("")).alias("checksum"), strings.is_newer(version, F.lit("5.3.9")).alias("newer"),
    )


@query("""
SELECT event_id, max(CASE WHEN event_type = 'error' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP)::VARCHAR AS incident FROM events
""")
def last_incident(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every event the time of the last error of its user before it."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    out = asof(events, events.where("event_type = 'error'"), "user_id", "ts", F.col("ts"), "incident")
    return out.select("event_id", F.col("incident").cast("string").alias("incident"))


@query("""
SELECT c_custkey, list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, len(c_name) + 1), lambda i: ascii(substr(c_name, i, 1))::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616)::VARCHAR AS fnv FROM customer
""")
def fnv_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FNV-1a of customers' names, as unsigned decimals."""
    signed = hashes.fnv1a64(F.col("c_name")).cast("decimal(20,0)")
    unsigned = F.when(signed < 0, signed + F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(signed)
    return table(spark, sf_dir, "customer").select("c_custkey", unsigned.cast("decimal(20,0)").cast("string").alias("fnv"))


@query("""
WITH p AS (SELECT p_partkey AS k, 'd' || (p_partkey % 5) || '/e' || (p_partkey % 7) || '/f' || p_partkey || (CASE WHEN p_partkey % 2 = 0 THEN '.rs' ELSE '.log' END) AS path FROM part),
n AS (SELECT n_nationkey AS n FROM nation)
SELECT path, k % 7 = 3 OR (k % 2 = 1 AND k NOT IN (SELECT n FROM n)) OR (k % 2 = 0 AND k IN (SELECT n * 10 FROM n WHERE n > 0 AND n % 5 = 0)) AS ignored FROM p
""")
def layered_ignores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files; the root's rules leave out logs and one folder, and nations' rules in five folders keep a log each and leave out a source file each."""
    k, n = F.col("p_partkey"), F.col("n_nationkey").cast("string")
    paths = table(spark, sf_dir, "part").select(F.concat(F.lit("d"), (k % 5).cast("string"), F.lit("/e"), (k % 7).cast("string"), F.lit("/f"), k.cast("string"), F.when(k % 2 == 0, ".rs").otherwise(".log")).alias("path"))
    own = table(spark, sf_dir, "nation").select(F.concat(F.lit("d"), (F.col("n_nationkey") % 5).cast("string"), F.lit("/")).alias("folder"), F.col("n_nationkey").alias("layer"), F.concat(F.lit("# kept\n!f"), n, F.lit(".log\n\nf"), n, F.lit("0.rs\n!e3/f*\n")).alias("content"))
    root = spark.createDataFrame([("", 0, "*.log\r\ne3/\n")], "folder string, layer int, content string")
    return ignores.ignored_paths(paths, ignores.rules_of(root.unionByName(own)))

"""Registered queries on parsed sources: texts whose counts follow from numbers of the supplied tables, so that SQL can state them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark.functions import scores
from siltmark.operators import duplication
from siltmark.parse import tables as parsing
from siltmark.plans.queries import query, table
from siltmark.plans.session import written
from siltmark.sources import lockfiles

LANGUAGES = ("rust", "javascript", "go")
NAMES = ("parsed_sources", "assertion_counts", "npm_lockfiles", "npm_nested_lockfiles", "advisory_severity", "duplication_of_sources")


def _by_language(rust: Column, javascript: Column, go: Column, number: Column) -> Column:
    return F.when(number == 0, rust).when(number == 1, javascript).otherwise(go)


def _language(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LANGUAGES)), (number + 1).cast("int"))


def _times(text: str, n: Column) -> Column:
    return F.repeat(F.lit(text), n.cast("int"))


def branching_source(k: Column, language: Column) -> Column:
    """One function with ifs in a row, nested ifs, loops, an else-if and conjunctions, as many as digits of ``k`` say."""
    flat, deep, loops, ands = k % 4, F.floor(k / 4) % 4, F.floor(k / 16) % 3, F.floor(k / 48) % 3

    def of(head: str, condition: str, loop: str, end: str) -> Column:
        def test(n: int, more: Column | str = "") -> tuple:
            a, b = condition.split("?")
            return F.lit(f"    {a}x > {n}"), F.lit(more) if isinstance(more, str) else more, F.lit(f"{b} {{\n")

        a, b = condition.split("?")
        return F.concat(
            F.lit(head),
            _times(f"    {a}x > 1{b} {{\n        g();\n    }}\n", flat),
            _times(f"    {a}x > 2{b} {{\n", deep),
            _times("    }\n", deep),
            _times(f"    {loop} {{\n        /* if && */ g();\n    }}\n", loops),
            *test(3, _times(" && x > 4", ands)),
            F.lit(f"        g();\n    }} else {a}x > 5{b} {{\n        g();\n    }}\n{end}"),
        )

    return _by_language(
        of("// if x\nfn f(x: i32) {\n", "if ?", "for i in 0..x", "}\n"),
        of("// if x\nfunction f(x) {\n", "if (?)", "while (x)", "}\n"),
        of("package m\n\n// if x\nfunc f(x int) {\n", "if ?", "for x > 6", "}\n"),
        language,
    )


@query("""
WITH n AS (SELECT p_partkey AS k, p_partkey % 3 AS lang, p_partkey // 3 AS m FROM part),
c AS (SELECT *, m % 4 AS flat, m // 4 % 4 AS deep, m // 16 % 3 AS loops, m // 48 % 3 AS ands FROM n)
SELECT k AS p_partkey, ['rust', 'javascript', 'go'][lang + 1] AS language, false AS parse_incomplete, (7 + (lang = 2)::INTEGER + 3 * flat + 2 * deep + 3 * loops)::INTEGER AS loc, 1::BIGINT AS functions,
  (3 + flat + deep + loops + ands)::INTEGER AS complexity, (2 + flat + deep)::INTEGER AS if_total, (greatest(0, deep - 1) + 1)::INTEGER AS if_nested, 1::INTEGER AS if_chained, greatest(1, deep)::INTEGER AS if_max_depth FROM c
""")
def parsed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of three languages, parsed: lines with tokens, functions, decisions and ifs; an else-if is a nested if too."""
    k = F.col("p_partkey")
    number, source = k % 3, branching_source(F.floor(k / 3), k % 3)
    files = table(spark, sf_dir, "part").select(k.cast("string").alias("path"), _language(number).alias("language"), source.alias("source"))
    parsed = parsing.parsed_files(files)
    first = F.col("functions")[0]
    return parsed.select(
        F.col("path").cast("long").alias("p_partkey"), "language", "parse_incomplete", "loc", F.size("functions").cast("long").alias("functions"),
        *[first[c].alias(c) for c in ("complexity", "if_total", "if_nested", "if_chained", "if_max_depth")],
    )


@query("""
SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 2 THEN s_suppkey % 5 + s_suppkey % 4 ELSE s_suppkey % 5 END::INTEGER AS assertions,
  CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 5 + 5 END::INTEGER AS inline_lines FROM supplier
""")
def assertion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assertions in test functions of three languages, and lines of Rust's test modules; others and those in comments don't count.

    A module's lines go from its head to its closing brace.
    """
    k = F.col("s_suppkey")
    n, more = k % 5, k % 4
    rust = F.concat(F.lit("fn a() { assert!(no); }\n#[cfg(test)]\nmod tests {\n    #[test]\n    fn t() {\n"), _times("        assert!(x);\n", n), F.lit("    }\n}\n// assert!(no)\n"))
    javascript = F.concat(F.lit("function a() { expect(0); }\nit('y', () => {\n"), _times("  expect(1);\n", n), F.lit("  // expect(2)\n});\n"))
    go = F.concat(F.lit("package m\nfunc TestA(t *testing.T) {\n"), _times("    assert.Equal(t, 1, 2)\n", n), _times('    t.Errorf("x")\n', more), F.lit('}\nfunc helper() { t.Fatal("n") }\n'))
    files = table(spark, sf_dir, "supplier").select("s_suppkey", _language(k % 3).alias("language"), _by_language(rust, javascript, go, k % 3).alias("source"))
    parsing.ship_package(spark)
    files = parsing.dealt(files, "s_suppkey")
    inline = parsing.inline_tests(F.when(F.col("language") == "rust", F.col("source")).otherwise(""))
    return files.select("s_suppkey", parsing.assertion_count("source", "language").alias("assertions"), inline["test_loc"].alias("inline_lines"))


@query("""
SELECT 'a' || s_suppkey AS name, '1.' || (s_suppkey % 5) AS version, 'npm' AS ecosystem FROM supplier
UNION ALL SELECT '@s/b' || s_suppkey, '2', 'npm' FROM supplier WHERE s_suppkey % 3 > 0
UNION ALL SELECT 'c' || s_suppkey, '3.0', 'npm' FROM supplier WHERE s_suppkey % 3 = 0
""")
def npm_lockfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """npm lockfiles of versions 3, 2 and 1 (by a missing version), one for each supplier."""
    k = F.col("s_suppkey").cast("string")
    entry = F.concat(F.lit('a%s":{"version":"1.'), (F.col("s_suppkey") % 5).cast("string"), F.lit('"'))
    entry = F.replace(entry, F.lit("%s"), k)
    flat = F.concat(F.lit('{"lockfileVersion":'), (F.col("s_suppkey") % 3 + 1).cast("string"), F.lit(',"packages":{"":{"version":"0"},"node_modules/'), entry, F.lit('},"node_modules/x":{"link":true},"node_modules/x/node_modules/@s/b'), k, F.lit('":{"version":"2"}}}'))
    nested = F.concat(F.lit('{"dependencies":{"'), entry, F.lit(',"dependencies":{"n":{"bundled":true},"c'), k, F.lit('":{"version":"3.0"}}}}}'))
    return lockfiles.package_lock(table(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 3 > 0, flat).otherwise(nested).alias("content"))).drop("n")


@query("""
SELECT 'a' || s_suppkey AS name, '1' AS version FROM supplier UNION ALL SELECT 'b' || s_suppkey, '2' FROM supplier
UNION ALL SELECT 'c' || s_suppkey, '3' FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'd' || s_suppkey || '_' || i, '4' FROM supplier, LATERAL unnest(range(0, s_suppkey % 4)) x(i)
""")
def npm_nested_lockfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """npm lockfiles that nest four levels deep, one for each supplier; versions that aren't texts don't count."""
    k = F.col("s_suppkey")
    fourth = F.transform(F.sequence(F.lit(0), (k % 4).cast("int")), lambda i: F.concat(F.lit('"d'), k.cast("string"), F.lit("_"), i.cast("string"), F.lit('":{"version":'), F.when(i == k % 4, "4").otherwise('"4"'), F.lit("}")))
    third = F.concat(F.lit('"c'), k.cast("string"), F.lit('":{"version":'), F.when(k % 2 == 0, '"3"').otherwise("null"), F.lit(',"dependencies":{'), F.array_join(fourth, ","), F.lit("}}"))
    text = F.concat(F.lit('{"lockfileVersion":1,"dependencies":{"a'), k.cast("string"), F.lit('":{"version":"1","dependencies":{"b'), k.cast("string"), F.lit('":{"version":"2","dependencies":{'), third, F.lit("}}}}}}"))
    files = table(spark, sf_dir, "supplier").select(F.concat(F.lit("r"), k.cast("string"), F.lit("/package-lock.json")).alias("path"), text.alias("content"))
    return lockfiles.dependencies(files).select("name", "version")


_BAND = "CASE WHEN s >= 9 THEN 'critical' WHEN s >= 7 THEN 'high' WHEN s >= 4 THEN 'medium' ELSE 'low' END"


@query(f"""
WITH x AS (SELECT o_orderkey, o_orderkey % 8 AS kind, (o_orderkey // 8 % 101) / 10::DOUBLE AS v FROM orders),
y AS (SELECT *, CASE kind WHEN 0 THEN v WHEN 1 THEN v WHEN 2 THEN v WHEN 3 THEN 9.8 WHEN 4 THEN v END AS s FROM x)
SELECT o_orderkey, CASE WHEN s IS NOT NULL THEN {_BAND} WHEN kind = 5 THEN 'high' END AS severity, round(s, 6) AS score FROM y
""")
def advisory_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advisory details with a score, a number, one in brackets, a vector, all of them, a name, another name and nothing."""
    k = F.col("o_orderkey")
    v = (F.floor(k / 8) % 101 / 10).cast("decimal(4,1)").cast("string")
    vector = "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"
    details = [
        F.concat(F.lit('{"score":'), v, F.lit("}")),
        F.concat(F.lit('{"cvss":'), v, F.lit("}")),
        F.concat(F.lit('{"cvss":"CVSS (3.1) base ('), v, F.lit(')"}')),
        F.lit(f'{{"cvss":"{vector}"}}'),
        F.concat(F.lit('{"severity":"HIGH","score":'), v, F.lit(f',"cvss":"{vector}"}}')),
        F.lit('{"severity":"HIGH"}'),
        F.lit('{"severity":"urgent"}'),
        F.lit("{}"),
    ]
    text = F.element_at(F.array(*details), (k % 8 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("t")).select("o_orderkey", scores.detail_severity(F.col("t")).alias("severity"), F.round(scores.cvss_score(F.col("t")), 6).alias("score"))


@query("""
WITH n AS (SELECT p_partkey AS k, p_partkey % 9 AS m, p_partkey % 10 = 0 AS other FROM part),
g AS (SELECT m, count(*) AS members FROM n WHERE NOT other AND m + 2 >= 7 GROUP BY m),
d AS (SELECT n.*, CASE WHEN coalesce(members, 0) >= 2 THEN m + 2 ELSE 0 END AS lines FROM n LEFT JOIN g USING (m)),
r AS (SELECT *, least(100::DOUBLE, lines::DOUBLE / (m + 5) * 150) AS risk FROM d)
SELECT k AS p_partkey, CASE WHEN other THEN 0 ELSE round(risk, 6) END AS risk_score, CASE WHEN other THEN 'not_applicable' ELSE 'full' END AS confidence FROM r
""")
def duplication_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The duplication dimension of parsed sources: functions of 7 lines and more that share a structure under other names."""
    k = F.col("p_partkey")
    name = k.cast("string")
    lines = F.array_join(F.transform(F.sequence(F.lit(0), F.greatest((k % 9).cast("int") - 1, F.lit(0))), lambda i: F.concat(F.lit("    g"), name, F.lit("(1);\n"))), "")
    source = F.concat(F.lit("fn f"), name, F.lit("() {\n"), F.when(k % 9 > 0, lines).otherwise(""), F.lit("}\nfn s() {\n    h();\n}\n"))
    files = table(spark, sf_dir, "part").select(name.alias("path"), F.when(k % 10 == 0, "unknown").otherwise("rust").alias("language"), source.alias("source"))
    parsed = written(parsing.parsed_files(files), "parsed")
    out = duplication.duplication_dimension(parsed, parsing.functions(parsed))
    return out.select(F.col("path").cast("long").alias("p_partkey"), F.round("risk_score", 6).alias("risk_score"), F.col("confidence.type").alias("confidence"))

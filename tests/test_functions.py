"""String and score functions on exact values."""

import pytest
from pyspark.sql import functions as F

from siltmark.functions import hashes, labels, scores, strings


def values(spark, rows, schema, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_i int, {schema}")
    return [r.x for r in df.select("_i", column.alias("x")).orderBy("_i").collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_language(spark):
    got = values(spark, [("a.rs",), ("b.JSX",), ("c.js",), ("d.Go",), ("e.py",), (None,)], "p string", strings.language(F.col("p")))
    assert got == ["rust", "javascript", "javascript", "go", "unknown", "unknown"]


@pytest.mark.parametrize("message,hit", [("fix login bug", 1), ("revert change", 1), ("hotfix applied", 1), ("security patch", 1), ("Fix crash", 1), ("add fixture", 0), ("prefix update", 0), ("éfix", 0), (None, 0)])
def test_incidents(spark, message, hit):
    assert one(spark, strings.is_incident(F.lit(message).cast("string"))) is bool(hit)


def test_author(spark):
    assert values(spark, [(" A@B.c ",), ("  ",), (None,)], "e string", strings.author(F.col("e"))) == ["a@b.c", "unknown-author", "unknown-author"]


def test_paths(spark):
    assert values(spark, [("./././src/a.rs",), ("//x/y",), (" ./b ",), (".x/y",)], "p string", strings.report_path(F.col("p"))) == ["src/a.rs", "x/y", "b", ".x/y"]
    assert values(spark, [("src/a.b.rs",), ("a.js",), ("src/Makefile",), ("s.d/x",)], "p string", strings.same_directory_tests(F.col("p"))) == [
        ["src/a.b_test.rs", "src/a.b.test.rs", "src/test_a.b.rs"], ["a_test.js", "a.test.js", "test_a.js"], [], []]
    got = values(spark, [("core/tests/test_basic.rs",), ("tests/http_v1_test.rs",), ("tests/sub/x_y.js",), ("src/a.rs",), ("tests/a.go",)], "p string", strings.tested_candidates(F.col("p")))
    assert got[0] == ["core/src/basic.rs", "core/lib/basic.rs", "core/app/basic.rs", "core/src/lib.rs", "core/src/main.rs"]
    assert "src/http/v1.rs" in got[1] and "src/http_v1.rs" in got[1] and got[2] == ["src/sub/x_y.js", "lib/sub/x_y.js", "app/sub/x_y.js"]
    assert got[3] is None and got[4] is None


def test_text_helpers(spark):
    assert values(spark, [("a\nb\n",), ("a\nb",), ("",), ("\n",)], "s string", strings.line_count(F.col("s"))) == [2, 2, 0, 1]
    assert values(spark, [("a\n \n\tb\n",)], "s string", strings.non_blank_lines(F.col("s"))) == [2]
    assert values(spark, [("@a/b/c",), ("lodash/fp",), ("x",)], "s string", strings.npm_package(F.col("s"))) == ["@a/b", "lodash", "x"]
    assert one(spark, strings.crate_import(F.lit("a-b-c"))) == "a_b_c"
    assert one(spark, strings.asserts_in(F.lit("assert!(x) expected my_assert reassert .expect(y)"))) == 3
    assert values(spark, [("foo",), ('"str"',), ("42",), ("true",), (">",), ("  ",), ('r#"x"#',), ("_a",), ("1.5",)], "s string", strings.token_class(F.col("s"))) == ["IDENT", "STR", "NUM", "BOOL", ">", "<empty>", "STR", "IDENT", "NUM"]
    assert one(spark, strings.xml_escaped(F.lit('a&"<'))) == "a&amp;&quot;&lt;" and one(spark, strings.dom_id(F.lit("a/b.c-d"))) == "a_b_c-d"
    assert one(spark, strings.thousands(F.lit(1234567))) == "1,234,567" and one(spark, strings.shortened(F.lit("abcd"), 3)) == "abc..."
    sums = F.lit("aa  x.tar\nbb *y.zip\n")
    assert one(spark, strings.checksum_of(sums, F.lit("y.zip"))) == "bb" and not one(spark, strings.checksum_of(sums, F.lit("z")))
    assert values(spark, [("v1.2.10", "1.2.9"), ("1.2.3", "1.2.3"), ("1.x", "1.0.0"), ("2.0.0", "10.0.0")], "a string, b string", strings.is_newer(F.col("a"), F.col("b"))) == [True, False, False, False]


def test_labels(spark):
    assert values(spark, [(0.0,), (30.0,), (60.0,), (80.0,)], "s double", strings.risk_tier(F.col("s"))) == ["low", "medium", "high", "critical"]
    assert values(spark, [(0.8,), (0.5,), (0.4,)], "s double", strings.confidence_tier(F.col("s"))) == ["high", "medium", "low"]
    assert values(spark, [("none",), ("low",), ("critical",)], "s string", strings.vulnerability_pill(F.col("s"))) == ["critical", "low", "critical"]
    assert one(spark, strings.confidence_text(F.struct(F.lit("data_missing").alias("type"), F.lit("why").alias("detail")))) == "data_missing: why"


def test_clamped_keeps_null(spark):
    assert values(spark, [(None,), (-5.0,), (50.0,), (500.0,)], "x double", scores.clamped(F.col("x"))) == [None, 0.0, 50.0, 100.0]


def test_test_risk(spark):
    got = values(spark, [(10.0, 60, 100, 10), (50.0, 10, 50, 0)], "g double, t int, i int, a int", scores.test_risk(F.col("g"), F.col("t"), F.col("i"), F.col("a")))
    assert got[0] == pytest.approx(47.8333, abs=1e-3)
    assert got[1] == pytest.approx(90.0)


def test_dependency_and_trend(spark):
    assert values(spark, [(0, 0), (4, 5), (3, 1)], "r int, n int", scores.dependency_risk(F.col("r"), F.col("n"))) == [0.0, 85.0, 60.0]
    assert values(spark, [(None, None), (50.0, 50.0), (10.0, 90.0), (90.0, 10.0)], "m double, l double", scores.trend(F.col("m"), F.col("l"))) == pytest.approx([1.0, 1.0, 1.09, 0.91])
    assert values(spark, [(50.0, 1.05), (150.0, 1.0), (-10.0, 1.0)], "b double, t double", scores.final_heat(F.col("b"), F.col("t"))) == [52.5, 100.0, 0.0]
    assert values(spark, [(True, True, True), (False, False, False), (False, True, False)], "a boolean, b boolean, c boolean", scores.consistency(F.col("a"), F.col("b"), F.col("c"))) == pytest.approx([0.5355, 1.0, 0.7])


def test_cvss(spark):
    vector = "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"
    cases = [
        ('{"score": 7.5}', 7.5), ('{"cvss": 5}', 5.0), (f'{{"cvss": "{vector}"}}', 9.8), (f'{{"cvss": "{vector} (4.2)"}}', 4.2),
        ('{"cvss": "other"}', None), ('{"score": "9"}', None), ("{}", None), (None, None), ("not json", None), ('{"cvss": "CVSS:3.0/AV:N/AV:P/A:H"}', None),
    ]
    got = values(spark, [(c,) for c, _ in cases], "d string", scores.cvss_score(F.col("d")))
    for value, (case, want) in zip(got[:-1], cases):
        assert value == (None if want is None else pytest.approx(want)), case
    levels = [("LOW", "low"), ("medium", "medium"), ("HIGH", "high"), ("Critical", "critical"), ("INFO", None)]
    assert values(spark, [(f'{{"severity": "{n}"}}',) for n, _ in levels], "d string", scores.detail_severity(F.col("d"))) == [x for _, x in levels]
    assert values(spark, [(9.0,), (7.0,), (4.0,), (1.0,), (None,)], "s double", scores.cvss_severity(F.col("s"))) == ["critical", "high", "medium", "low", "medium"]


def test_report_labels(spark):
    dims = F.array(*[F.struct(F.lit(d).alias("dim"), F.struct(F.lit(k).alias("type"), F.lit(None).cast("string").alias("detail")).alias("confidence")) for d, k in (("complexity", "full"), ("test", "not_applicable"), ("dependency", "not_applicable"))])
    assert one(spark, labels.excluded_labels(dims)) == "测试、依赖"
    assert one(spark, labels.dimension_at(F.lit(9))) == "未知" and one(spark, labels.flag_class(F.lit(True))) == "color-orange"
    assert one(spark, labels.rewrite_class(F.lit("detected"))) == "color-orange" and one(spark, labels.rewrite_class(F.lit(None).cast("string"))) == "color-muted"
    assert one(spark, labels.mean_or_zero(F.array(F.lit(1.0), F.lit(3.0)))) == 2.0 and one(spark, labels.mean_or_zero(F.array().cast("array<double>"))) == 0.0
    assert one(spark, labels.affects(F.array(F.lit("a")), F.lit("a"))) and one(spark, labels.cut(F.lit("äöü"), 2)) == "äö"
    assert one(spark, labels.labelled(F.lit("none"), labels.SEVERITY_CLASSES)) == ""


def test_fnv1a_vectors(spark):
    """Published vectors of the 64-bit hash, and texts outside ASCII against a plain version."""

    def plain(text):
        h = 0xCBF29CE484222325
        for b in text.encode():
            h = (h ^ b) * 0x100000001B3 % 2**64
        return h

    texts = ["", "a", "foobar", "naïve 日本語", "x" * 500, None]
    got = values(spark, [(t,) for t in texts], "s string", hashes.fnv1a64(F.col("s")))
    assert [None if g is None else g % 2**64 for g in got] == [0xCBF29CE484222325, 0xAF63DC4C8601EC8C, 0x85944171F73967E8, plain(texts[3]), plain(texts[4]), None]

"""Operators of the risk model on exact small examples."""

import random

import pytest
from pyspark.sql import functions as F

from siltmark.operators import complexity, dependency, duplication, history, scoring, testing
from siltmark.operators.ranking import first_rows, running_total
from siltmark.parse.tables import functions, parsed_files

NOW = 1_800_000_000
DAY = 86_400


def results(spark, risks, paths=("f",)):
    rows = [(p, i, float(r or 0), ("not_applicable" if r is None else "full", None)) for p in paths for i, r in enumerate(risks)]
    return spark.createDataFrame(rows, "path string, dim_idx int, risk_score double, confidence struct<type:string,detail:string>")


@pytest.mark.parametrize(
    "risks,base,extra",
    [((30, 40, 50, 60, 70), 50.25, None), ((30, None, 40, 30, 20), 27 / 0.85, 0), ((80, 75, 70, 65, 60), None, 0), ((95, 5, 5, 5, 5), None, 13.5), ((None,) * 5, 0, 0), ((None, None, 90, None, None), 90, 0)],
)
def test_composition(spark, risks, base, extra):
    r = scoring.compositions(results(spark, risks)).first()
    if base is not None:
        assert r.base_risk_score == pytest.approx(base)
    if extra is not None:
        assert r.extra_penalty == pytest.approx(extra)
    assert not r.normalized_weights or sum(w.weight for w in r.normalized_weights) == pytest.approx(1)
    assert len(r.active_dimensions) + len(r.excluded_dimensions) == 5


def test_one_high_dimension_is_not_full_heat(spark):
    assert scoring.compositions(results(spark, (100, 5, 5, 5, 5))).first().base_risk_score < 100


def heat(spark, rows):
    return spark.createDataFrame(rows, "path string, loc int, final_heat_score double")


def test_repository_heat(spark):
    r = scoring.repository_heat(heat(spark, [("a", 100, 50.0), ("b", 200, 70.0)])).first()
    assert r.repo_total_heat_score == pytest.approx(77.33, abs=0.01)
    assert scoring.repository_heat(heat(spark, [])).first().repo_total_heat_score == 0
    assert scoring.repository_heat(heat(spark, [("a", 0, 50.0)])).first().repo_total_heat_score == 0


def test_top_files(spark):
    rows = [(f"f{i:02}", 1, float(i % 5)) for i in range(41)]
    top = scoring.top_files(heat(spark, rows)).orderBy("rank").collect()
    assert [r.path for r in top] == ["f04", "f09", "f14"] and scoring.top_files(heat(spark, [])).count() == 0


@pytest.mark.parametrize("pool,value,want", [([1, 2, 3, 4], 4, None), ([5] * 6, 5, None), ([1, 2, 3, 4, 5], 1, 20), ([1, 2, 3, 4, 5], 5, 100), ([1, 1, 1, 2, 2], 2, 80)])
def test_percentile(spark, pool, value, want):
    df = complexity.with_percentile(spark.createDataFrame([(float(x),) for x in pool] + [(None,)], "v double"), "v")
    got = {r.v: r.percentile for r in df.collect()}
    assert got[value] == (None if want is None else pytest.approx(want)) and got[None] is None


def commits(spark, rows):
    return spark.createDataFrame(rows, "commit_id string, walk_pos int, commit_ts long, author_email string, message string")


def changes(spark, rows):
    return spark.createDataFrame(rows, "commit_id string, delta_pos int, old_path string, new_path string, status string, is_binary boolean")


def test_history(spark):
    c = commits(spark, [("c3", 0, NOW - DAY, "A@x", "fix bug"), ("c2", 1, NOW - 5 * DAY, "b@x", "move"), ("c1", 2, NOW - 9 * DAY, "a@x ", "init"), ("c0", 3, NOW, "z", "cut off")])
    ch = changes(spark, [("c3", 0, "new.rs", "new.rs", "M", False), ("c2", 0, "old.rs", "new.rs", "R", False), ("c1", 0, None, "old.rs", "A", False), ("c1", 1, None, "b.bin", "A", True), ("c0", 0, None, "old.rs", "A", False)])
    head = spark.createDataFrame([("new.rs",), ("b.bin",)], "path string")
    renames = history.rename_map(c, ch, 3)
    rows = history.file_commits(c, ch, renames, 3)
    got = {r.path: r for r in history.git_metrics(rows, head, renames, NOW).collect()}
    assert got["new.rs"][1:] == (3, 2, 1, 1) and got["b.bin"][1:] == (0, 0, 0, 0)
    assert {r.path for r in history.timelines(rows, head, renames).collect()} == {"new.rs"}
    assert c.agg(history.is_truncated(c, 3)).first()[0] and not c.agg(history.is_truncated(c, 4)).first()[0]
    assert history.change_dimension(head, history.timelines(rows, head, renames), NOW).where("path = 'b.bin'").first().confidence.type == "data_missing"


def test_rename_chains(spark):
    rows = [("c5", 0, "d", "e"), ("c4", 1, "c", "d"), ("c3", 2, "a", "z"), ("c2", 3, "b", "c"), ("c1", 4, "a", "b")]
    c = commits(spark, [(x[0], x[1], 0, "", "") for x in rows])
    got = {r.path: r.final for r in history.rename_map(c, changes(spark, [(x[0], 0, x[2], x[3], "R", False) for x in rows])).collect()}
    fate = {}
    for _, _, old, new in rows:  # newest first, as plain code would fold them
        fate[old] = fate.get(new, new)
    assert got == fate


def timeline(spark, path, days, incidents):
    return [(path, NOW - d * DAY, f"a{d % 2}", d in incidents) for d in days]


def risks(spark, rows):
    df = spark.createDataFrame(rows, "path string, commit_ts long, author string, is_incident boolean")
    return {r.path: r.change_risk for r in history.change_risks(df, NOW).collect()}


def test_decay(spark):
    got = risks(spark, timeline(spark, "new", range(1, 6), {1, 2, 3, 4, 5}) + timeline(spark, "old", [700, 710, 720, 730, 1], {700, 710, 720, 730}) + [("future", NOW + DAY, "a", True)])
    assert got["old"] < 0.6 * got["new"] and got["old"] < 30 and got["future"] == pytest.approx(60 + 100 / 90 * 0.2 + 2)


def test_reflog(spark):
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    assert history.history_rewritten(lines("commit: init")).first()[0] == "unknown"
    assert history.history_rewritten(lines("commit: init", "rebase finished")).first()[0] == "detected"
    assert history.history_rewritten(lines()).first()[0] == "unknown"


def test_duplication(spark):
    body = "fn {n}({a}: u32) -> u32 {{\n let {b} = {a} + 1;\n let c = 2;\n if {b} > 1 {{\n  return {b};\n }}\n {b} + c\n}}\n"
    short = "fn {n}() {{\n x();\n}}\n"
    files = [("a.rs", body.format(n="f", a="x", b="y")), ("b.rs", body.format(n="g", a="p", b="q")), ("c.rs", short.format(n="s")), ("d.rs", short.format(n="t")), ("e.rs", "fn z() {\n match a {\n  1 => b(),\n  _ => c(),\n }\n d();\n e();\n}\n")]
    parsed = parsed_files(spark.createDataFrame([(p, "rust", s) for p, s in files], "path string, language string, source string"))
    got = {r.path: r.risk_score for r in duplication.duplication_dimension(parsed, functions(parsed)).collect()}
    assert got == {"a.rs": 100, "b.rs": 100, "c.rs": 0, "d.rs": 0, "e.rs": 0}


def test_line_union(spark):
    ranges = spark.createDataFrame([("a", 0, 4), ("a", 2, 3), ("a", 4, 9), ("a", 20, 20), ("b", 5, 5)], "path string, start_line int, end_line int")
    assert {r.path: r.lines for r in duplication.duplicated_lines(ranges).collect()} == {"a": 11, "b": 1}


def test_links(spark):
    test = "#[test]\nfn t() { assert!(true); }\n"
    inline = "fn a() {}\n#[cfg(test)]\nmod tests {\n #[test]\n fn t() {\n  assert_eq!(1, 1);\n }\n}\n"
    files = [("src/parser.rs", "fn p() {}", 5), ("src/parser_test.rs", test, 2), ("src/inline.rs", inline, 8), ("core/src/lib.rs", "fn l() {}", 0), ("core/src/basic.rs", "x", 1), ("core/tests/test_basic.rs", test, 2), ("src/http/v1.rs", "y", 3), ("tests/http_v1_test.rs", test, 2), ("src/none.rs", 'let s = "#[cfg(test)]";', 1), ("m.go", "package m", 1), ("m_test.go", "package m\nfunc TestX(t *T) { t.Fatal(1) }", 2)]
    df = spark.createDataFrame([(p, "go" if p.endswith("go") else "rust", s, n) for p, s, n in files], "path string, language string, source string, loc int")
    links = {r.path: r for r in testing.test_links(df).collect()}
    assert (links["src/parser.rs"].rule, links["src/parser.rs"].test_loc, links["src/parser.rs"].assertions) == (1, 2, 1)
    assert (links["src/inline.rs"].rule, links["src/inline.rs"].impl_loc, links["src/inline.rs"].test_loc) == (2, 2, 6)
    assert links["core/src/lib.rs"].rule == 3 and links["core/src/lib.rs"].impl_loc == 1 and links["core/src/basic.rs"].test_path == "core/tests/test_basic.rs"
    assert links["src/http/v1.rs"].rule == 3 and links["m.go"].assertions == 1 and "src/none.rs" not in links


def test_test_dimension(spark):
    stats = spark.createDataFrame([("a", ["t"], 60, 100, 10), ("b", ["t"], 10, 50, 0)], "path string, test_files array<string>, test_loc int, impl_loc int, assertions int")
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    got = {r.path: r for r in testing.test_dimension(files, stats, spark.createDataFrame([("a", 90.0)], "path string, pct double")).collect()}
    assert got["a"].risk_score == pytest.approx(47.833, abs=1e-3) and got["a"].confidence.type == "full"
    assert got["b"].confidence.type == "data_missing" and got["c"].confidence.type == "not_applicable" and got["c"].risk_score == 0
    alone = {r.path: r for r in testing.test_dimension(files, stats, spark.createDataFrame([], "path string, pct double")).collect()}
    assert alone["b"].risk_score == pytest.approx(90.0) and '"empty_shell":true' in alone["b"].detail


BATCH = "pos int, vulns array<struct<id:string,summary:string,database_specific:string>>"
DETAILS = "id string, summary string, aliases array<string>, database_specific string"


def found(spark, batch, details):
    deps = spark.createDataFrame([(0, "x-y", "1", "crates.io"), (1, "lodash", "2", "npm")], "pos int, name string, version string, ecosystem string")
    d = spark.createDataFrame(details, DETAILS)
    rows = dependency.enriched(dependency.findings(deps, spark.createDataFrame(batch, BATCH)), d)
    return dependency.merged_aliases(rows, d)


def test_findings(spark):
    batch = [(0, [("A", None, '{"score": 9.1}')]), (1, None), (2, [("Z", "s", None)])]
    r = found(spark, batch, []).collect()
    assert [(x.id, x.package_name, x.severity, x.severity_estimated, x.summary) for x in r] == [("A", "x-y", "critical", False, "")]
    r = found(spark, [(0, [("A", "s", None)])], [("A", " ", [], '{"severity": "HIGH"}')]).first()
    assert (r.severity, r.severity_estimated, r.summary) == ("high", False, "s")


def test_alias_merge(spark):
    batch = [(0, [("GHSA-1", "", None), ("RUSTSEC-1", "", None)]), (1, [("GHSA-2", "two", None), ("GHSA-1", "", None)])]
    details = [("GHSA-1", "from ghsa", ["RUSTSEC-1", "CVE-1"], '{"severity": "LOW"}'), ("RUSTSEC-1", None, ["CVE-1"], None)]
    r = sorted(found(spark, batch, details).collect(), key=lambda x: x.id)
    assert [(x.id, x.severity, x.severity_estimated, x.summary) for x in r] == [("GHSA-2", "medium", True, "two"), ("RUSTSEC-1", "low", False, "from ghsa")]


def test_imports(spark):
    files = [
        ("a.rs", "use serde::Value;\nuse foo;\nuse crate::x;\n use tokio::{a};\nextern crate libc;\npub use z::y;"),
        ("b.js", "import React from 'react';\nimport x from \"@a/b/c\";\nimport './side';\nconst l = require('lodash/fp');\nrequire('./local');\nimport { q } from './rel';"),
        ("c.go", 'package m\nimport "fmt"\nimport (\n\t"github.com/a/b"\n\tq "github.com/c/d"\n)\nvar s = "no"'),
        ("d.RS", "use nope::x;"),
    ]
    got = {}
    for r in dependency.imports(spark.createDataFrame(files, "path string, source string")).collect():
        got.setdefault(r.path, set()).add(r.import_key)
    assert got == {"a.rs": {"serde", "foo;", "tokio", "libc"}, "b.js": {"react", "@a/b", "lodash"}, "c.go": {"fmt", "github.com/a/b", "github.com/c/d"}}


def test_affected_files_and_dimension(spark):
    rows = found(spark, [(0, [("A", "", '{"score": 9.1}'), ("B", "", '{"score": 2}')])], [])
    used = spark.createDataFrame([("a.rs", "x_y"), ("a.rs", "x_y"), ("b.rs", "other")], "path string, import_key string")
    parsed = spark.createDataFrame([("a.rs", False), ("b.rs", False), ("c.rs", True)], "path string, parse_incomplete boolean")
    hits = dependency.file_findings(parsed, rows, used)
    got = {r.path: r for r in dependency.dependency_dimension(parsed, hits, False).collect()}
    assert got["a.rs"].risk_score == pytest.approx(80) and got["b.rs"].risk_score == 0 and got["c.rs"].risk_score == pytest.approx(40) and got["c.rs"].confidence.type == "data_missing"
    assert {r.confidence.type for r in dependency.dependency_dimension(parsed, hits, True).collect()} == {"not_applicable"}
    assert {tuple(r.affected_files) for r in dependency.with_affected_files(rows, used).collect()} == {("a.rs",)}


def test_complexity_dimension(spark):
    schema = "path string, parsed boolean, parse_incomplete boolean, cyclomatic_complexity int, max_if_nesting_depth int, nested_if_ratio double, avg_function_length double, max_function_length int"
    rows = [(f"f{i}", True, i == 2, i * 12 + 1, i, 0.0, 5.0, 9) for i in range(5)] + [("broken", False, True, 1, 0, 0.0, 0.0, 0)]
    got = {r.path: r for r in complexity.complexity_dimension(spark.createDataFrame(rows, schema)).collect()}
    assert got["f0"].risk_score == pytest.approx(0.5 * 20 + 0.5 * 15) and got["f4"].risk_score == pytest.approx(0.5 * 100 + 0.5 * (80 * 0.7 + 15 * 0.3))
    assert got["f2"].confidence.type == "data_missing" and got["broken"].risk_score == pytest.approx(sum(got[f"f{i}"].risk_score for i in range(5)) / 5)
    none = complexity.complexity_dimension(spark.createDataFrame(rows[-1:], schema)).first()
    assert none.confidence.type == "not_applicable" and none.risk_score == 0


@pytest.mark.parametrize("limited", [100, 3])
def test_first_rows(spark, limited):
    rows = [(i, i * 7 % 11) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(3)
    got = [(r["rank"], r.k) for r in first_rows(df, [F.col("v").desc(), F.col("k")], 9, limited).orderBy("rank").collect()]
    assert got == [(i + 1, k) for i, (k, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0]))[:9])]


def test_running_total(spark):
    rows = [(i * 37 % 101, i % 7) for i in range(101)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(5)
    got = {r.k: r.before for r in running_total(df, [F.col("k")], "v", "before").collect()}
    total, want = 0, {}
    for k, v in sorted(rows):
        want[k] = total
        total += v
    assert got == want


def test_shuffle_files_go_with_their_write(spark):
    from siltmark.plans.session import _shuffles_go

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    with _shuffles_go(spark):
        assert spark.conf.get(name) == "true"
    assert spark.conf.get(name) == before


def test_carried_over_ranges(spark):
    """One key with nearly all rows, over several ranges, some of them without a value."""
    from siltmark.operators.ordered import carried

    rng = random.Random(1)
    rows = [("hot", i, i if rng.random() < 0.001 or i == 5 else None) for i in range(20_000)] + [(f"k{i % 50}", i, i if i % 3 else None) for i in range(500)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.createDataFrame(rows, "k string, n int, v int")
    try:
        got = {b: {(r.k, r.n): r.last for r in carried(df, ["k"], ["n"], {"last": F.col("v")}, before=b).collect()} for b in (False, True)}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    held = {}
    for k, n, v in sorted(rows):
        assert got[True][k, n] == held.get(k)
        held[k] = held.get(k) if v is None else v
        assert got[False][k, n] == held.get(k)
    assert len(got[True]) == len(rows)


def test_asof_takes_earlier_rows_alone(spark):
    from siltmark.operators.ordered import asof

    left = spark.createDataFrame([("a", 1, "x"), ("a", 5, "y"), ("b", 5, "z"), ("a", 5, "y")], "k string, t int, v string")
    right = spark.createDataFrame([("a", 1, 10), ("a", 4, 40), ("a", 5, 50), ("c", 1, 1), ("b", 2, None)], "k string, t int, w int")
    got = sorted(((r.k, r.t, r.v, r.w) for r in asof(left, right, "k", "t", F.col("w"), "w").collect()), key=str)
    assert got == [("a", 1, "x", None), ("a", 5, "y", 40), ("a", 5, "y", 40), ("b", 5, "z", None)]


def replayed(steps):
    """Fates of old paths, taking renames in from the newest on."""
    fate = {}
    for old, new in steps:
        fate[old] = fate.get(new, new)
    return fate


@pytest.mark.parametrize("names,n", [(6, 400), (40, 400), (2, 20_000)])
def test_renames_as_replayed(spark, names, n):
    rng = random.Random(names)
    steps = []
    while len(steps) < n:
        old, new = f"p{rng.randrange(names)}", f"p{rng.randrange(names)}"
        if old != new:
            steps.append((old, new))
    c = spark.createDataFrame([(f"c{i}", i, 0, "", "") for i in range(n)], "commit_id string, walk_pos int, commit_ts long, author_email string, message string")
    ch = spark.createDataFrame([(f"c{i}", 0, o, w, "R", False) for i, (o, w) in enumerate(steps)], "commit_id string, delta_pos int, old_path string, new_path string, status string, is_binary boolean")
    assert {r.path: r.final for r in history.rename_map(c, ch, n).collect()} == replayed(steps)


@pytest.mark.parametrize("kind", ["spread", "tied", "one value", "skewed", "nulls"])
@pytest.mark.parametrize("n", [1, 37, 1500, 2990, 5000])
def test_largest_without_a_sort(spark, kind, n):
    from siltmark.operators.ranking import largest

    rng = random.Random(len(kind))
    value = {"spread": rng.random, "tied": lambda: rng.randrange(4) / 3, "one value": lambda: 7.0, "skewed": lambda: 10.0 ** rng.randrange(-300, 300), "nulls": lambda: rng.choice([None, None, 1.5, rng.random()])}[kind]
    rows = [(f"p{i}", value()) for i in range(3000)]
    got = [tuple(r) for r in largest(spark.createDataFrame(rows, "path string, v double"), "v", "path", n, 20).collect()]
    assert sorted(got, key=str) == sorted(sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))[:n], key=str)


def test_large_top_has_ranks(spark):
    rows = [(f"p{i:03}", float(i % 10)) for i in range(400)]
    files = spark.createDataFrame(rows, "path string, final_heat_score double")
    want = sorted(rows, key=lambda r: (-r[1], r[0]))[:100]
    top = scoring.top_files(files, 0.25, limited=10)
    assert sorted((r["rank"], r.path) for r in top.collect()) == [(i + 1, r[0]) for i, r in enumerate(want)]
    assert {r.path for r in scoring.top_files(files, 0.25, ranked=False, limited=10).collect()} == {r[0] for r in want}


def test_debug_log_counts_what_a_block_runs(spark, caplog):
    import logging

    from siltmark.sinks.log import observed

    caplog.set_level(logging.DEBUG)
    with observed(spark.range(10), "ten", logging.DEBUG, odd=F.count_if(F.col("id") % 2 == 1)) as rows:
        assert rows.where("id > 100").count() == 0
    assert "ten: rows 10, odd 5" in caplog.text


def test_renames_beyond_the_default_walk(spark, tmp_path):
    """The query follows every rename, however many commits there are; a walk is cut only where its caller says so."""
    from siltmark.plans.queries import rename_resolution

    spark.range(6006).selectExpr("id + 1 AS c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    got = {r.path: r.final for r in rename_resolution(spark, str(tmp_path)).collect()}
    assert got == {f"n{k}": f"n{k // 6 * 6 + 5}" for k in range(1, 6007) if k % 6 < 5 and k // 6 * 6 + 5 <= 6006}


def test_tests_of_one_crate_do_not_meet_in_one_task(spark):
    """What all tests of a crate want is not shuffled by its name, and is found nevertheless."""
    rows = [(f"tests/t{i}.rs",) for i in range(500)] + [("src/lib.rs",), ("src/t7.rs",), ("a/src/main.rs",), ("a/tests/x.rs",)]
    out = testing.tests_directory_links(spark.createDataFrame(rows, "path string"))
    got = sorted((r.path, r.test_path) for r in out.collect())
    assert got == sorted([("src/lib.rs", f"tests/t{i}.rs") for i in range(500)] + [("src/t7.rs", "tests/t7.rs"), ("a/src/main.rs", "a/tests/x.rs")])
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
    none = testing.tests_directory_links(spark.createDataFrame([], "path string"))
    assert none.columns == ["path", "test_path"] and none.count() == 0

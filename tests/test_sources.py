"""Readers on small inputs, and a scan of a repository made on the spot."""

import json
import re
import subprocess

import pytest
from pyspark.sql import functions as F

from siltmark.plans import report as plan
from siltmark.sinks import reports
from siltmark.sources import coverage, files, git, lockfiles, osv


def texts(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "content string")


def names(df):
    return sorted((r.name, r.version, r.ecosystem) for r in df.collect())


def test_lockfiles(spark):
    cargo = 'version = 3\n[[package]]\nname = "a"\nversion = "1.0"\n\n[[package]]\nname = "b"\nversion = "2"\ndependencies = [\n "a",\n]\n'
    assert names(lockfiles.cargo_lock(texts(spark, cargo))) == [("a", "1.0", "crates.io"), ("b", "2", "crates.io")]
    v2 = json.dumps({"lockfileVersion": 2, "packages": {"": {"version": "9"}, "node_modules/lodash": {"version": "4"}, "node_modules/x/node_modules/@types/node": {"version": "1"}, "node_modules/nover": {}}})
    assert names(lockfiles.package_lock(texts(spark, v2))) == [("@types/node", "1", "npm"), ("lodash", "4", "npm")]
    v1 = json.dumps({"dependencies": {"a": {"version": "1", "dependencies": {"b": {"version": "2"}}}}})
    assert names(lockfiles.package_lock(texts(spark, v1))) == [("a", "1", "npm"), ("b", "2", "npm")]
    go = "m v1.2.3 h1:x\nm v1.2.3/go.mod h1:y\nn v0.1.0 h1:z\n// c\n\nbad\n"
    assert names(lockfiles.go_sum(texts(spark, go))) == [("m", "1.2.3", "Go"), ("n", "0.1.0", "Go")]
    both = lockfiles.union([lockfiles.cargo_lock(texts(spark, cargo)), lockfiles.go_sum(texts(spark, go))])
    assert [r.pos for r in both.orderBy("pos").collect()] == [0, 1, 2, 3]


def pct(df):
    return {r.path: round(r.pct, 2) for r in df.collect()}


def test_coverage(spark):
    lcov = "SF:./src/foo.rs\nLF:100\nLH:90\nend_of_record\nSF:/src/bar.rs\nLF:50\nLH:0\nend_of_record\nSF:none.rs\nLF:0\nLH:0\nend_of_record\nend_of_record\nSF:carry.rs\nLF:4\nend_of_record\nSF:src/foo.rs\nLH:1\nend_of_record"
    assert pct(coverage.lcov(texts(spark, lcov))) == {"src/foo.rs": 25.0, "src/bar.rs": 0.0, "carry.rs": 0.0}
    xml = '<coverage>\n<class filename="a.js" name="x">\n<line number="1" hits="1"/>\n<line number="2" hits="0"/>\n<line number="3" hits="2"/>\n</class>\n<class name="b" filename="b.js">\n<line number="1" hits="1"/>\n</class>\n</coverage>'
    assert pct(coverage.cobertura(texts(spark, xml))) == {"a.js": 66.67}
    assert pct(coverage.any_report(texts(spark, xml, lcov)))["a.js"] == 66.67
    go = "mode: set\nex.com/m/foo.go:1.1,2.2 3 1\nex.com/m/foo.go:3.1,4.2 2 0\nbar.go:1.1,2.2 1 5\nbroken\n"
    assert pct(coverage.go_cover(texts(spark, go), "ex.com/m")) == {"foo.go": 50.0, "bar.go": 100.0}
    assert [r.module for r in coverage.go_module(texts(spark, "module example.com/gotest\n\ngo 1.21", "x")).collect()] == ["example.com/gotest"]
    assert coverage.first_report(spark.createDataFrame([(2, "b"), (1, "a")], "priority int, content string")).first()[0] == "a"


@pytest.mark.parametrize(
    "pattern,hits,misses",
    [("target", ["target/a.rs", "x/target/b.rs"], ["targets/a.rs"]), ("*.generated.*", ["a/b.generated.js"], ["a/generated.js"]), ("/src/*.rs", ["src/a.rs"], ["x/src/a.rs", "src/b/a.rs"]), ("docs/**", ["docs/a/b.js"], ["x/docs"]), ("a/**/b.js", ["a/b.js", "a/x/y/b.js"], ["b.js"]), ("build/", ["build/a.js"], ["build"])],
)
def test_ignore_patterns(spark, pattern, hits, misses):
    regex = re.compile(files.glob_regex(pattern))
    assert all(regex.match(p) for p in hits) and not any(regex.match(p) for p in misses)
    assert spark.range(1).select(files.ignored(F.lit(hits[0]), [pattern]).alias("x")).first().x


def git_do(repo, *args):
    subprocess.run(["git", "-C", str(repo), "-c", "user.name=n", "-c", "user.email=A@b.c", *args], check=True, capture_output=True)


RUST = "use serde::Value;\npub fn big(a: i32, b: i32) -> i32 {\n    if a > b && b > 0 {\n        let x = a;\n        return x;\n    } else if a < b {\n        return 2;\n    }\n    3\n}\n"


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    git_do(root, "init", "-q")
    for name, text in {
        "src/lib.rs": RUST, "src/old.rs": RUST.replace("big", "huge"), "tests/lib_test.rs": "#[test]\nfn t() { assert!(true); }\n", "_app.js": "function f() { return 1; }\n",
        "target/x.rs": "fn gone() {}\n", "skip.rs": "fn s() {}\n", ".gitignore": "skip.rs\n", ".hidden/h.rs": "fn h() {}\n", "notes.txt": "x\n",
        "Cargo.lock": '[[package]]\nname = "serde"\nversion = "1.0"\n', "lcov.info": "SF:src/lib.rs\nLF:10\nLH:9\nend_of_record\n",
    }.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (root / "bad.js").write_bytes(b"\xff\xfe")
    (root / "link.rs").symlink_to("src/lib.rs")
    git_do(root, "add", "-A")
    git_do(root, "commit", "-qm", "init")
    git_do(root, "mv", "src/old.rs", "src/new.rs")
    git_do(root, "commit", "-qm", "move")
    (root / "src/new.rs").write_text(RUST.replace("big", "huge") + "// more\n")
    git_do(root, "commit", "-qam", "fix crash")
    return root


def test_listing(spark, repo):
    found = {r.path: r.skip_reason for r in files.read_sources(files.listed(spark, repo)).collect()}
    assert found == {"src/lib.rs": None, "src/new.rs": None, "tests/lib_test.rs": None, "_app.js": None, "bad.js": "encoding", "link.rs": "symlink"}
    more = {r.path for r in files.listed(spark, repo, ("src",), True).collect()}
    assert "target/x.rs" in more and "src/lib.rs" not in more
    stats = files.scan_statistics(files.read_sources(files.listed(spark, repo))).first()
    assert (stats.skipped_symlinks, stats.skipped_files, stats.file_count) == (1, 1, 4)


def test_git(spark, repo):
    log = git.commits(spark, repo).orderBy("walk_pos").collect()
    assert [r.message.strip() for r in log] == ["fix crash", "move", "init"]
    moved = git.file_changes(spark, repo).where("status = 'R'").collect()
    assert [(r.old_path, r.new_path) for r in moved] == [("src/old.rs", "src/new.rs")]
    assert git.file_changes(spark, repo).where("new_path = 'bad.js'").count() == 1
    assert git.head_files(spark, repo).where("path = 'src/new.rs'").count() == 1 and git.reflog(spark, repo).count() >= 3


def test_empty_repository(spark, tmp_path):
    git_do(tmp_path, "init", "-q")
    assert git.commits(spark, tmp_path).count() == git.file_changes(spark, tmp_path).count() == git.head_files(spark, tmp_path).count() == 0


def fetcher(answers):
    def fetch(url, body):
        value = answers[url.rsplit("/", 1)[-1]]
        if isinstance(value, Exception):
            raise value
        return json.dumps(value).encode()

    return fetch


def test_scan(spark, repo, tmp_path):
    fetch = fetcher({"querybatch": {"results": [{"vulns": [{"id": "GHSA-1"}]}]}, "GHSA-1": {"summary": "bad", "aliases": [], "database_specific": {"severity": "HIGH"}}})
    options = plan.Options(str(repo))
    inputs = plan.ingest(spark, options, fetch)
    scores = plan.score(inputs, options)
    rows = {r.path: r for r in scores.files.collect()}
    assert set(rows) == {"src/lib.rs", "src/new.rs", "tests/lib_test.rs", "_app.js"}
    assert rows["src/new.rs"].commit_count == 3 and rows["src/new.rs"].incident_commit_count == 1 and rows["src/new.rs"].cve_count == 1
    assert all(0 <= r.final_heat_score <= 100 and r.max_cve_severity in ("none", "high") for r in rows.values())
    kinds = {(r.path, r.dim): r for r in scores.dimensions.collect()}
    assert len(kinds) == 20 and kinds["src/lib.rs", "duplication"].risk_score == 100 and kinds["src/lib.rs", "test"].confidence.type == "full"
    row = plan.report(spark, inputs, scores, options)
    data = json.loads(reports.json_text(row))
    assert [d["dim"] for d in data["files"][0]["dimensions"]] == ["complexity", "duplication", "test", "change_risk", "dependency"]
    assert data["dependency_findings"][0]["affected_files"] == ["src/lib.rs", "src/new.rs"] and data["analysis_metadata"]["osv_status"] == "ok"
    assert len(data["top_risk_files"]) == 1 and isinstance(data["files"][0]["dimensions"][0]["detail"], dict)
    page = reports.html_text(row)
    assert "src/new.rs" in page and page.count("<script") == 1
    total = plan.summary(scores).first()
    assert total.file_count == 4 and total.total_loc == sum(r.loc for r in rows.values()) and "Files       4" in reports.terminal_text(total)
    assert (reports.exit_code(50.0, 50.0), reports.exit_code(50.1, 50.0), reports.exit_code(99.0, None)) == (0, 1, 0)
    assert files.ensure_ignore_file(tmp_path) and not files.ensure_ignore_file(tmp_path)


def test_service_failures(spark):
    deps = spark.createDataFrame([(0, "a", "1", "npm")], "pos int, name string, version string, ecosystem string")
    assert osv.query(spark, deps.limit(0), fetch=fetcher({}))[2] == "no_dependencies"
    assert osv.query(spark, deps, fetch=fetcher({"querybatch": OSError("down")}))[2] == "query_failed"
    batch, details, status = osv.query(spark, deps, fetch=fetcher({"querybatch": {"results": [{"vulns": [{"id": "X"}]}, None]}, "X": OSError("500")}))
    assert status == "ok" and batch.count() == 2 and details.count() == 0


def test_command_needs_a_repository(tmp_path):
    from siltmark.__main__ import main

    assert main([str(tmp_path)]) == 2


def test_npm_of_any_depth(spark):
    text = '{"x":{"version":"0","dependencies":{}}}'
    for i in range(120):
        text = f'{{"p{i}":{{"version":"{i}","dependencies":{text}}}}}'
    limits = {k: spark.conf.get(k) for k in lockfiles._UNBOUNDED}
    rows = lockfiles.package_lock(texts(spark, f'{{"dependencies":{text}}}', "{}", '{"dependencies":[{"version":"1"}]}', '{"dependencies":{"a":"1","b":{"version":1},"c":{"version":"2","dependencies":[]}}}'))
    assert {(r.name, r.version) for r in rows.collect()} == {("x", "0"), ("c", "2")} | {(f"p{i}", str(i)) for i in range(120)}
    assert limits == {k: spark.conf.get(k) for k in limits}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lock_texts")]


def test_a_registered_lockfile_format(spark):
    def mock(files):
        rows = files.select(F.posexplode(F.split("content", "\n")).alias("i", "line"))
        return rows.select(F.array("i").alias("n"), F.split("line", "=")[0].alias("name"), F.split("line", "=")[1].alias("version"), F.lit("mock").alias("ecosystem"))

    files = spark.createDataFrame([("deep/er/mock.lock", "b=2\na=1"), ("Cargo.lock", '[[package]]\nname = "z"\nversion = "9"\n'), ("README", "b=3"), ("x/go.sum", "m v1.0 h1:x\n")], "path string, content string")
    lockfiles.register("mock.lock", mock)
    try:
        rows = sorted(lockfiles.dependencies(files).collect())
    finally:
        del lockfiles.FORMATS["mock.lock"]
    assert [tuple(r) for r in rows] == [(0, "z", "9", "crates.io"), (1, "m", "1.0", "Go"), (2, "b", "2", "mock"), (3, "a", "1", "mock")]

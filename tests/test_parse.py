"""Lexing, structure and test scanning on small sources."""

import pytest

from siltmark.parse import scanner
from siltmark.parse.lexer import Lexicon, tokenize
from siltmark.parse.profiles import CONVENTIONS, PROFILES, register
from siltmark.parse.structure import Profile, parse
from siltmark.parse.tables import functions, parsed_files


def first(language, source):
    return parse(source, PROFILES[language]).functions[0]


DEPTHS = [
    ("rust", "fn f(x: i32) {\n if x == 1 { a(); } else if x == 2 { b(); } else if x == 3 { c(); } else { d(); }\n}", 1),
    ("go", "package m\nfunc f(x int) {\n if x == 1 {\n a()\n } else if x == 2 {\n b()\n } else {\n c()\n }\n}", 1),
    ("rust", "fn f(x: i32) -> i32 {\n let y = if x == 1 { 1 } else if x == 2 { 2 } else { 3 };\n y\n}", 2),
    ("rust", "fn f() { if a { if b { if c { x(); } } } }", 3),
    ("go", "package m\nfunc f() {\n if a {\n if b {\n if c { x() }\n }\n }\n}", 3),
    ("rust", "fn f() { if a { x(); } else if b { if c { y(); } } else { z(); } }", 2),
    ("rust", "fn f() { if a { x(); } else { if b { y(); } } }", 1),
    ("rust", "fn f() { if a { x(); } else { w(); if b { y(); } } }", 2),
    ("go", "package m\nfunc f() {\n if a {\n  g(func() {\n   if c {\n    if d { x() }\n   }\n  })\n if b { y() }\n }\n}", 2),
    ("go", "package m\nfunc f() {\n if x := g(); x != nil {\n a()\n } else if y := h(); y {\n b()\n }\n}", 1),
    ("javascript", "function f() { if (a) { x(); } else if (b) y(); else z(); }", 1),
    ("javascript", "function f() { if (a) if (b) x(); }", 2),
]


@pytest.mark.parametrize("language,source,depth", DEPTHS)
def test_nesting(language, source, depth):
    assert first(language, source).if_max_depth == depth


@pytest.mark.parametrize(
    "language,source,complexity",
    [
        ("rust", "fn f(a: bool, b: bool, n: i32) {\n if a && b { x(); }\n match n {\n 1 => y(),\n 2 => { z(); }\n _ => {}\n }\n}", 6),
        ("go", "package m\nfunc f(x int) int {\n switch x {\n case 1:\n  return 1\n case 2:\n  return 2\n default:\n  return 0\n }\n}", 4),
        ("go", "package m\ntype I interface {\n F(x int) int\n}\nfunc g() {}", 1),
        ("go", "package m\nfunc g(c chan int) {\n select {\n case <-c:\n  if x { y() }\n default:\n }\n}", 2),
        ("rust", "impl A for B { fn f<'a>(x: &'a str) { for i in 0..3 { while t { loop {} } } } }", 4),
        ("rust", 'fn f() { println!("{}", if a && b { 1 } else { 2 }); }', 1),
        ("rust", "fn f() { let c = || x; g(&&y); v.iter().filter(|p| p.a || p.b); }", 2),
        ("rust", "fn f(n: i32) { match n { x if x > 1 && y => 1, _ => 2 } }", 4),
        ("javascript", "function f(a) { for (const i of a) { do { k(); } while (c); } try { t(); } catch { u(); } return a ?? b ? 1 : 2; }", 4),
        ("javascript", "function f() { const r = /[/}]if (x) {/.test(s) && `a ${ b ? '}' : `${c}` } if`; }", 2),
        ("javascript", "const f = (a) => a && b;", 2),
        ("mock", "function f() { if (a) { x(); } for (;;) { y(); } }", 3),
    ],
)
def test_complexity(language, source, complexity):
    assert first(language, source).complexity == complexity


def test_functions_and_ends():
    p = parse("// c\n\n/* x\n y */\npub async fn f(\n) {\n  let s = \"a\nb\";\n}\nfn g();\nstruct S { f: fn(i32) -> i32 }\n", PROFILES["rust"])
    assert [(f.start_line, f.end_line) for f in p.functions] == [(4, 8)] and p.loc == 7 and not p.parse_incomplete
    js = parse("function* g() {}\nclass A { m() { if (x) {} } }\nconst f = async x => {\n  y();\n};\nexport default function () {}\n", PROFILES["javascript"])
    assert [(f.start_line, f.end_line) for f in js.functions] == [(2, 4), (5, 5)]
    go = parse("package m\nfunc (r T) M() {}\nvar f func(int) int\nfunc g(h func(int) int) func() { return func() {} }\n", PROFILES["go"])
    assert len(go.functions) == 3


def test_broken_sources_still_give_metrics():
    for source in ("fn f( {", 'fn f() { "abc', "/* open", "fn f() { ) }"):
        assert parse(source, PROFILES["rust"]).parse_incomplete
    assert not parse("", PROFILES["go"]).parse_incomplete


def test_renaming_keeps_structure_and_literals_matter():
    body = "fn {n}({a}: u32) -> u32 {{\n let {b} = {a} + 1;\n if {b} > {v} {{ return {b}; }}\n {b}\n}}"
    same = {first("rust", body.format(n=n, a=a, b=b, v="10")).tokens for n, a, b in (("f", "x", "y"), ("g", "p", "q"))}
    assert len(same) == 1 and first("rust", body.format(n="f", a="x", b="y", v='"10"')).tokens not in same


def test_lexer():
    tokens, broken = tokenize("r#\"a\"b\"# b'x' 'a 'x' 1.5e3 0xFF a..b", Lexicon(rust_quotes=True))
    assert [t.text for t in tokens] == ['r#"a"b"#', "b'x'", "'a", "'x'", "1.5e3", "0xFF", "a", "..", "b"] and not broken


def test_comments_are_blanked():
    assert scanner.without_comments('a // x\nb /* y\n */ c "d{" e') == b"a" + b" " * 6 + b"b" + b" " * 10 + b'c "    e'
    assert scanner.without_comments("fn f<'a>() { 'x' }") == b"fn f<'" + b" " * 8 + b"x' }"
    assert len(scanner.without_comments("é // ü\n'")) == len("é // ü\n'".encode())


def test_rust_test_modules():
    source = "fn a() {}\n#[cfg(test)]\nmod tests {\n #[test]\n fn t() {\n  assert_eq!(1, 1);\n }\n}\n"
    assert scanner.rust_test_modules(source) == (6, 1)
    assert scanner.rust_test_modules(source + source) == (12, 2)
    assert scanner.rust_test_modules('let s = "#[cfg(test)] {}";') is None and scanner.rust_test_modules("#[cfg(test)] mod t {") is None


def test_assertions():
    assert scanner.count_assertions("#[test]\nfn a() { assert!(x); y.expect(q); expected(); }\nfn test_b() { assert_eq!(1,1) }\nfn c() { assert!(z) }", "rust") == 4
    assert scanner.count_assertions("#[tokio::test]\nfn a() { assert!(x) }", "rust") == 0
    assert scanner.count_assertions("describe('x', () => { it('y', () => { expect(1).toBe(1); assert(x); }); }); latest(expect(2));", "javascript") == 4
    go = 'package m\nfunc TestA(t *testing.T) {\n require.NoError(t, err)\n assert.Equal(t, 1, 2)\n if x { t.Errorf("x") }\n t.Run("s", func(t *testing.T) { t.Fatal("y") })\n _ = fmt.Errorf("no")\n}\nfunc helper() { t.Fatal("n") }\n'
    assert scanner.count_assertions(go, "go") == 4 and scanner.count_assertions("x", "unknown") == 0


def test_a_new_language_is_a_profile():
    register(Profile("toy", Lexicon(), frozenset({"def"}), frozenset({"def"}), frozenset({"when"}), frozenset()))
    try:
        assert parse("def f() { when { } }", PROFILES["toy"]).functions[0].complexity == 2
    finally:
        del PROFILES["toy"]
    assert CONVENTIONS["go"].coverage_reports == ("coverage.out",)


def test_tables(spark):
    rows = [("a.rs", "rust", "fn f() { if x {} }\n"), ("b.txt", "unknown", "x\n\ny"), ("c.go", "go", None)]
    parsed = {r.path: r for r in parsed_files(spark.createDataFrame(rows, "path string, language string, source string")).collect()}
    assert parsed["a.rs"].parsed and parsed["a.rs"].loc == 1 and len(parsed["a.rs"].functions) == 1
    assert not parsed["b.txt"].parsed and parsed["b.txt"].loc == 2 and parsed["b.txt"].parse_incomplete
    assert parsed["c.go"].loc == 0
    df = parsed_files(spark.createDataFrame(rows, "path string, language string, source string"))
    assert functions(df).first().complexity == 2


def test_parsing_is_dealt_over_tasks(spark):
    """One small file of many sources is parsed by many tasks."""
    from siltmark.parse import tables

    files = spark.range(100).selectExpr("cast(id AS string) AS path", "'rust' AS language", "'fn f() {}' AS source").coalesce(1)
    parsed = tables.parsed_files(files)
    assert parsed.rdd.getNumPartitions() >= tables.TASKS_A_CORE * spark.sparkContext.defaultParallelism
    assert parsed.count() == 100


def test_duplication_parses_once(spark, sf_dir):
    """Sources are parsed before the duplication dimension, not again for each of its branches."""
    from siltmark.plans.parser_queries import duplication_of_sources

    assert "MapInPandas" not in duplication_of_sources(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()

"""Layered ignore rules against a plain evaluator, entry by entry."""

import random
import re

import pytest

from siltmark.operators import ignores


def plain_regex(pattern):
    anchored = "/" in pattern.rstrip("/")
    body, out, i = pattern.strip("/"), "", 0
    while i < len(body):
        rest = body[i:]
        for token, regex in (("**/", "(?:.*/)?"), ("**", ".*"), ("*", "[^/]*"), ("?", "[^/]")):
            if rest.startswith(token):
                out, i = out + regex, i + len(token)
                break
        else:
            if rest[0] == "[" and "]" in rest[2:]:
                end = rest.index("]", 2)
                out, i = out + "[" + re.sub("^!", "^", rest[1:end]) + "]", i + end + 1
            elif rest[0] == "\\" and len(rest) > 1:
                out, i = out + re.escape(rest[1]), i + 2
            else:
                out, i = out + re.escape(rest[0]), i + 1
    return re.compile(("" if anchored else "(?:.*/)?") + out)


def plain(path, files):
    """Whether a path is ignored by files (folder, layer, content)."""
    names = path.split("/")
    for d in range(1, len(names) + 1):
        entry, is_folder, gone = "/".join(names[:d]), d < len(names), False
        for folder, _, content in sorted(files, key=lambda f: (f[0].count("/"), f[1])):
            if not entry.startswith(folder) or entry == folder.rstrip("/"):
                continue
            for line in content.split("\n"):
                line = line.rstrip()
                if not line or line[0] == "#":
                    continue
                keeps = line[0] == "!"
                pattern = line[1:] if keeps else re.sub(r"^\\(?=[#!])", "", line)
                if pattern.endswith("/") and not is_folder or not pattern.strip("/"):
                    continue
                if plain_regex(pattern).fullmatch(entry[len(folder) :]):
                    gone = not keeps
        if gone:
            return True
    return False


RULES = ["*.log", "!keep.log", "build/", "!build", "/a", "a/b", "**/c", "c/**", "a/**/x.rs", "[ab].rs", "[!a]?.go", "\\#x", "\\!y", "#", "", "d*/", "!d1/", "x.*", "/", "\\*", "b"]


def test_against_plain_evaluator(spark):
    rng = random.Random(2)
    names = ["a", "b", "c", "d1", "d2", "build", "x.rs", "a.rs", "ab.go", "keep.log", "z.log", "#x", "!y", "*", "x.*", "[", "a+b(c).js"]
    paths = sorted({"/".join(rng.choice(names) for _ in range(rng.randint(1, 5))) for _ in range(400)})
    folders = ["", "", "a/", "a/b/", "d1/", "c/d2/"]
    for trial in range(4):
        files = [(f, i % 2, "\n".join(rng.sample(RULES, 6)) + "\n") for i, f in enumerate(folders)]
        rules = ignores.rules_of(spark.createDataFrame([*files, ("b/", 0, None)], "folder string, layer int, content string"))
        got = {r.path: r.ignored for r in ignores.ignored_paths(spark.createDataFrame([(p,) for p in [*paths, paths[0], None]], "path string"), rules).collect()}
        want = {p: plain(p, files) for p in paths}
        assert got == want and len(set(want.values())) == 2, {p for p in want if got[p] != want[p]}


@pytest.mark.parametrize(
    "content,kept,gone",
    [
        ("target/\n", ["target", "a/target.rs"], ["target/x.rs", "a/target/x.rs"]),
        ("*.rs\n!keep.rs\n", ["keep.rs", "d/keep.rs", "x.go"], ["x.rs", "d/x.rs"]),
        ("d/\n!d/keep.rs\n", ["keep.rs"], ["d/keep.rs"]),
        ("d/*\n!d/keep.rs\n", ["d/keep.rs"], ["d/x.rs"]),
        ("/x.rs\n", ["d/x.rs"], ["x.rs"]),
    ],
)
def test_usual_rules(spark, content, kept, gone):
    rules = ignores.rules_of(spark.createDataFrame([("", 0, content)], "folder string, layer int, content string"))
    got = {r.path: r.ignored for r in ignores.ignored_paths(spark.createDataFrame([(p,) for p in [*kept, *gone]], "path string"), rules).collect()}
    assert got == {p: False for p in kept} | {p: True for p in gone}
    assert ignores.ignored_paths(spark.createDataFrame([], "path string"), rules).count() == 0

"""String functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: words that mark a commit as an incident.
INCIDENT = r"\b(fix|bug|revert|hotfix|patch|error|crash)\b"


def language(path: Column) -> Column:
    low = F.lower(path)
    return (
        F.when(low.endswith(".rs"), "rust")
        .when(low.endswith(".js") | low.endswith(".jsx"), "javascript")
        .when(low.endswith(".go"), "go")
        .otherwise("unknown")
    )


def is_incident(message: Column) -> Column:
    return F.coalesce(F.lower(message).rlike(INCIDENT), F.lit(False))


def author(email: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.trim(email)), F.lit("")), F.lit("unknown-author"))


def report_path(path: Column) -> Column:
    """A coverage report's path as a repository path: without leading ``./`` and ``/``."""
    return F.regexp_replace(F.trim(path), r"^(\./)*/*", "")


def _directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)


def same_directory_tests(path: Column) -> Column:
    """Names that a test file beside ``path`` may have; none without an extension."""
    stem = F.regexp_extract(path, r"([^/]*)\.[^./]*$", 1)
    ext = F.regexp_extract(path, r"\.([^./]*)$", 1)
    at = _directory(path)
    names = F.array(F.concat(at, stem, F.lit("_test."), ext), F.concat(at, stem, F.lit(".test."), ext), F.concat(at, F.lit("test_"), stem, F.lit("."), ext))
    return F.when(F.element_at(F.split(path, "/"), -1).contains("."), names).otherwise(F.array().cast("array<string>"))


TESTS_DIR = r"^(.*)tests/(.+\.(?:rs|js|jsx))$"
SOURCE_ROOTS = ("src", "lib", "app")


def without_test_marks(stem: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(stem, r"(_test|\.test)$", ""), "^test_", "")


def tested_candidates(path: Column, pattern: str = TESTS_DIR, roots: tuple[str, ...] = SOURCE_ROOTS) -> Column:
    """Implementation files that a file under ``tests/`` may test; null for other files.

    Under each root: the same name without test marks, and ``a/b`` for ``a_b``. A file
    directly under ``tests/`` also tests the crate as a whole.
    """
    prefix = F.regexp_replace(F.regexp_extract(path, pattern, 1), "/+$", "")
    rel = F.regexp_extract(path, pattern, 2)
    stem = without_test_marks(F.regexp_extract(rel, r"^(.*)\.[^.]*$", 1))
    ext = F.regexp_extract(rel, r"\.([^.]*)$", 1)
    base = F.when(prefix == "", F.lit("")).otherwise(F.concat(prefix, F.lit("/")))
    split = stem.rlike(r"^[^/]+_[^/_]+$") & ~stem.contains("/")
    found = []
    for root in roots:
        found.append(F.concat(base, F.lit(f"{root}/"), stem, F.lit("."), ext))
        nested = F.concat(base, F.lit(f"{root}/"), F.regexp_replace(stem, "_([^_]*)$", "/$1"), F.lit("."), ext)
        found.append(F.when(split, nested))
    for whole in ("lib.rs", "main.rs"):
        found.append(F.when(~rel.contains("/"), F.concat(base, F.lit(f"src/{whole}"))))
    return F.when(path.rlike(pattern), F.array_compact(F.array(*found)))


def line_count(source: Column) -> Column:
    """Physical lines; a last line end starts no line."""
    return F.size(F.regexp_extract_all(source, F.lit(r"[^\n]*\n|[^\n]+\z"), F.lit(0)))


def non_blank_lines(source: Column) -> Column:
    return F.size(F.filter(F.split(source, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s", " ")) != ""))


def npm_package(module: Column) -> Column:
    """``@scope/name`` of a scoped module, else its first segment."""
    return F.when(module.startswith("@"), F.substring_index(module, "/", 2)).otherwise(F.substring_index(module, "/", 1))


def crate_import(name: Column) -> Column:
    return F.translate(name, "-", "_")


def asserts_in(text: Column) -> Column:
    """Calls of assert or expect by their left word boundary, in text without strings and comments."""
    return F.regexp_count(F.lower(text), F.lit("(?<![a-z0-9_])(assert|expect)"))


def token_class(text: Column) -> Column:
    """The class of a leaf of source text for structural comparison."""
    t = F.trim(text)
    number = t.rlike(r"^[0-9]") | F.try_to_number(t, F.lit("S999999999.999999999")).isNotNull()
    return (
        F.when(t == "", "<empty>")
        .when(t.rlike("^[\"'`]") | t.rlike("^r[\"#]"), "STR")
        .when(number, "NUM")
        .when(t.isin("true", "false", "null", "nil", "None"), "BOOL")
        .when(t.rlike(r"^[\p{L}_$@]"), "IDENT")
        .otherwise(t)
    )


def normalised_structure(text: Column) -> Column:
    """Text with words as IDENT and numbers as NUM."""
    words = F.regexp_replace(text, r"[\p{L}_][\p{L}\p{N}_]*", "IDENT")
    return F.regexp_replace(words, "[0-9]+", "NUM")


def xml_escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit("<"), F.lit("&lt;"))


def dom_id(path: Column) -> Column:
    return F.regexp_replace(path, "[^A-Za-z0-9_-]", "_")


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def fixed(x: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f", x)


def shortened(text: Column, most: int = 400) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def checksum_of(sums: Column, name: Column) -> Column:
    """The checksum of ``name`` in the text of a checksum list, whose names may begin with ``*``."""
    lines = F.filter(F.split(sums, "\n"), lambda x: F.regexp_replace(F.regexp_extract(x, r"^\s*\S+\s+(\S+)", 1), r"^\*", "") == name)
    return F.regexp_extract(F.try_element_at(lines, F.lit(1)), r"^\s*(\S+)", 1)


def is_newer(candidate: Column, current: Column) -> Column:
    """Whether version x.y.z ``candidate`` (a leading v is allowed) is above ``current``; false if either is malformed."""

    def parts(v: Column) -> Column:
        v = F.regexp_replace(F.trim(v), "^v", "")
        return F.when(v.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+$"), F.transform(F.split(v, r"\."), lambda p: p.cast("long")))

    return F.coalesce(parts(candidate) > parts(current), F.lit(False))


# Labels of report values.
def risk_tier(score: Column) -> Column:
    return F.when(score < 30, "low").when(score < 60, "medium").when(score < 80, "high").otherwise("critical")


def confidence_tier(coefficient: Column) -> Column:
    return F.when(coefficient >= 0.8, "high").when(coefficient >= 0.5, "medium").otherwise("low")


def vulnerability_pill(severity: Column) -> Column:
    """The pill of a finding; findings without severity get the critical pill, like the critical ones."""
    return F.when(severity.isin("low", "medium", "high"), severity).otherwise("critical")


def confidence_text(confidence: Column) -> Column:
    return F.when(confidence["type"] == "data_missing", F.concat(F.lit("data_missing: "), confidence["detail"])).otherwise(confidence["type"])


def listed(names: Column, separator: str = "、") -> Column:
    return F.array_join(names, separator)

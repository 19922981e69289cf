"""Language profiles. A new language is one more entry; no analyser changes."""

from __future__ import annotations

from dataclasses import dataclass

from siltmark.parse.lexer import Lexicon
from siltmark.parse.structure import Profile

_RUST = Profile(
    name="rust",
    lexicon=Lexicon(rust_quotes=True, nested_comments=True),
    keywords=frozenset("as async await break const continue crate dyn else enum extern fn for if impl in let loop match mod move mut pub ref return self static struct super trait type unsafe use where while yield".split()),
    function_words=frozenset({"fn"}),
    branch_words=frozenset({"for", "while", "loop"}),
    arm_words=frozenset({"match"}),
    arm_token="=>",
    wrapping_words=frozenset({"let", "return"}),
    assignments_wrap=True,
    macros=True,
    modifiers=frozenset({"pub", "async", "unsafe", "const", "extern", "default"}),
)
_JAVASCRIPT = Profile(
    name="javascript",
    lexicon=Lexicon(templates=True, regexes=True),
    keywords=frozenset("async await break case catch class const continue debugger default delete do else export extends finally for from function get if import in instanceof let new of return set static super switch this throw try typeof var void while with yield".split()),
    function_words=frozenset({"function"}),
    branch_words=frozenset({"for", "while", "do", "catch"}),
    arm_words=frozenset({"switch"}),
    arm_starts=frozenset({"case", "default"}),
    wrapping_words=frozenset({"return"}),
    assignments_wrap=True,
    arrow_functions=True,
    do_while=True,
    conditions_in_brackets=True,
    modifiers=frozenset({"async"}),
)
_GO = Profile(
    name="go",
    lexicon=Lexicon(raw_backtick=True),
    keywords=frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()),
    function_words=frozenset({"func"}),
    branch_words=frozenset({"for"}),
    arm_words=frozenset({"switch"}),
    arm_starts=frozenset({"case", "default"}),
    wrapping_words=frozenset({"return"}),
    closures_stop_context=False,
)
_MOCK = Profile(
    name="mock",
    lexicon=Lexicon(templates=True, regexes=True),
    keywords=_JAVASCRIPT.keywords,
    function_words=frozenset({"function"}),
    branch_words=frozenset({"for"}),
    arm_words=frozenset(),
    conditions_in_brackets=True,
)

PROFILES: dict[str, Profile] = {p.name: p for p in (_RUST, _JAVASCRIPT, _GO, _MOCK)}


@dataclass(frozen=True)
class Conventions:
    """What a language adds beyond its syntax: lockfiles, test names and coverage reports."""

    lockfiles: tuple[str, ...] = ()
    test_patterns: tuple[str, ...] = ()
    coverage_reports: tuple[str, ...] = ()


CONVENTIONS: dict[str, Conventions] = {"go": Conventions(("go.sum",), ("{name}_test.go",), ("coverage.out",))}


def register(profile: Profile, conventions: Conventions | None = None) -> None:
    """Adds or replaces a language."""
    PROFILES[profile.name] = profile
    if conventions:
        CONVENTIONS[profile.name] = conventions

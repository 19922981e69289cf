"""Test bodies and assertions of source files, scanned by bytes."""

from __future__ import annotations

import re

from siltmark.parse.lexer import tokenize
from siltmark.parse.profiles import PROFILES
from siltmark.parse.structure import Group, bracket_tree

_ASSERT = re.compile(rb"(?<![a-z0-9_])(?:assert|expect)")
_RAW_OPEN = re.compile(rb"(?<![A-Za-z0-9_])[bc]?r(#+)\Z")
_OPENERS = re.compile(rb"//|/\*|[\"'`]")


def without_comments(source: str) -> bytes:
    """Source with comments and the inside of strings as blanks, byte for byte.

    Line ends inside them go too, as does the one that ends a line comment; a string keeps
    its opening quote and loses its closing one. A single quote opens a string only if
    another follows on its line.
    """
    raw = source.encode("utf-8", "replace")
    out = bytearray(raw)
    at = 0

    def blank(a: int, b: int) -> None:
        out[a:b] = b" " * (b - a)

    while m := _OPENERS.search(raw, at):
        start, mark = m.start(), m.group()
        if mark == b"//":
            end = raw.find(b"\n", start + 2)
            end = len(raw) if end < 0 else end + 1
            blank(start, end)
            # The byte after the slashes stays if the comment is empty up to the end of the text.
            at = end
        elif mark == b"/*":
            end = raw.find(b"*/", start + 2)
            end = len(raw) if end < 0 else end + 2
            blank(start, end)
            at = end
        else:
            if mark == b"'":
                line = raw.find(b"\n", start)
                if raw.find(b"'", start + 1, len(raw) if line < 0 else line) < 0:
                    at = start + 1
                    continue
            hashes = _RAW_OPEN.search(raw, max(0, start - 64), start) if mark == b'"' else None
            if hashes:
                close = b'"' + hashes[1]
                end = raw.find(close, start + 1)
                end = len(raw) if end < 0 else end + len(close)
            else:
                end = start + 1
                while end < len(raw) and raw[end : end + 1] != mark:
                    end += 2 if raw[end : end + 1] == b"\\" else 1
                end = min(len(raw), end + 1)
            blank(start + 1, end)
            at = end
    return bytes(out)


def count_asserts(text: str) -> int:
    """Occurrences of assert and expect with a word boundary on their left, outside strings and comments."""
    return len(_ASSERT.findall(without_comments(text).decode("utf-8", "replace").lower().encode()))


def _matching(code: bytes, at: int, opening: bytes, closing: bytes) -> int:
    """Where the bracket that opens at ``at`` closes; -1 if it doesn't."""
    depth = 0
    for m in re.compile(b"[" + re.escape(opening) + re.escape(closing) + b"]").finditer(code, at):
        depth += 1 if m.group() == opening else -1
        if not depth:
            return m.start()
    return -1


def rust_test_modules(source: str) -> tuple[int, int] | None:
    """(lines, assertions) of the blocks behind ``#[cfg(test)]``; None if there is none."""
    code = without_comments(source)
    raw = source.encode("utf-8", "replace")
    lines = asserts = at = 0
    while (attribute := code.find(b"#[cfg(test)]", at)) >= 0:
        brace = code.find(b"{", attribute)
        close = _matching(code, brace, b"{", b"}") if brace >= 0 else -1
        if close < 0:
            break
        lines += code.count(b"\n", brace, close) + 1
        asserts += count_asserts(raw[brace:close].decode("utf-8", "replace"))
        at = close + 1
    return (lines, asserts) if lines else None


_RUST_MARK = re.compile(rb"#\[test|(?<![A-Za-z0-9_])fn(?![A-Za-z0-9_])")
_NAME = re.compile(rb" *([A-Za-z0-9_]*)")


def _rust_bodies(code: bytes) -> list[tuple[int, int]]:
    """Bodies of functions behind a ``#[test`` attribute or with a name that begins with ``test_``."""
    out, at, marked = [], 0, False
    while m := _RUST_MARK.search(code, at):
        if m.group() != b"fn":
            marked = True
            at = code.find(b"\n", m.start())
            if at < 0:
                break
            continue
        name = _NAME.match(code, m.end())
        if marked or name[1].startswith(b"test_"):
            brace = code.find(b"{", m.start())
            close = _matching(code, brace, b"{", b"}") if brace >= 0 else -1
            if close >= 0:
                out.append((brace, close))
        marked, at = False, max(name.end(), m.end())
    return out


def _javascript_bodies(code: bytes) -> list[tuple[int, int]]:
    """Brackets of test, it and describe calls, each looked for on its own."""
    out = []
    for marker in (b"test(", b"it(", b"describe("):
        at = 0
        call = re.compile(rb"(?<![A-Za-z0-9_])" + re.escape(marker))
        while m := call.search(code, at):
            close = _matching(code, m.end() - 1, b"(", b")")
            if close < 0:
                at = m.start() + 1
            else:
                out.append((m.end() - 1, close))
                at = close + 1
    return out


# What counts as an assertion in Go.
_GO_ASSERTERS = {"require", "assert"}
_GO_FAILURES = {"Error", "Errorf", "Fatal", "Fatalf", "Fail", "FailNow"}
_GO_BUILDERS = {"fmt", "errors", "xerrors", "wrapping"}


def _go_calls(items: list[Group]) -> int:
    n = 0
    for i, g in enumerate(items):
        if g.items is None:
            continue
        if g.text == "(" and i > 2 and items[i - 2].text == "." and items[i - 1].token.kind == "word":
            method, receiver = items[i - 1].text, items[i - 3]
            alone = i < 4 or items[i - 4].text != "."
            name = receiver.text if receiver.items is None and alone else ""
            n += name in _GO_ASSERTERS or (method in _GO_FAILURES and name not in _GO_BUILDERS)
        n += _go_calls(g.items)
    return n


def go_assertions(source: str) -> int:
    """Assertion calls in functions whose name begins with Test, closures included."""
    tree, _ = bracket_tree(tokenize(source, PROFILES["go"].lexicon)[0])
    n = 0
    for i, g in enumerate(tree):
        if g.text == "func" and i + 1 < len(tree) and tree[i + 1].token.kind == "word" and tree[i + 1].text.startswith("Test"):
            body = next((x for x in tree[i + 2 :] if x.items is not None and x.text == "{"), None)
            n += _go_calls(body.items) if body else 0
    return n


def count_assertions(source: str, language: str) -> int:
    """Assertions within the test functions of a file."""
    if language == "go":
        return go_assertions(source)
    code = without_comments(source)
    bodies = _rust_bodies(code) if language == "rust" else _javascript_bodies(code) if language in ("javascript", "mock") else []
    raw = source.encode("utf-8", "replace")
    return sum(count_asserts(raw[a:b].decode("utf-8", "replace")) for a, b in bodies)

"""Tokens of Rust, JavaScript and Go source text.

A token is (kind, text, first row, last row) with rows from 0; kinds are word, num, str and
op. Comments give no tokens. Unterminated strings and comments mark the text as broken.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    row: int
    end_row: int


@dataclass(frozen=True)
class Lexicon:
    """What a language's lexer has to know."""

    rust_quotes: bool = False
    templates: bool = False
    raw_backtick: bool = False
    regexes: bool = False
    nested_comments: bool = False


_OPS = ["<<=", ">>=", "...", "..=", "===", "!==", "**=", "&&=", "||=", "??=", ">>>", "&^=", "=>", "->", "::", "&&", "||", "==", "!=", "<=", ">=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<", "..", ":=", "<-", "++", "--", "**", "??", "?."]
_OP = re.compile("|".join(map(re.escape, sorted(_OPS, key=len, reverse=True))) + r"|[^\s\w]")
_WORD = re.compile(r"[^\W\d][\w$]*|\$[\w$]*|#[A-Za-z_]\w*(?=\s*[(=;])")
_NUM = re.compile(r"0[xXbBoO][0-9A-Fa-f_]+\w*|(?:\d[\d_]*)(?:\.(?!\.)\d[\d_]*)?(?:[eE][+-]?\d+)?\w*")
_BLANK = re.compile(r"\s+")
#: Characters that are an operator each, and those that can only begin one.
_SINGLE, _ONLY_OP = frozenset("(){}[];,"), frozenset(".:+-*%=<>&|!?^~@")
_RUST_RAW = re.compile(r'(?:b|c)?r(#*)"')
_RUST_CHAR = re.compile(r"b?'(?:\\(?:u\{[0-9A-Fa-f_]+\}|x[0-9A-Fa-f]{2}|.)|[^\\'\n])'")
#: After these a slash begins a regular expression.
_BEFORE_REGEX = set("(,=:[!&|?{};+-*%~^<>") | {"=>", "&&", "||", "??", "==", "===", "!=", "!==", "return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "do", "else"}


def tokenize(source: str, lexicon: Lexicon) -> tuple[list[Token], bool]:
    """Tokens of ``source`` and whether a string or comment never ends."""
    out: list[Token] = []
    i, n, row, broken = 0, len(source), 0, False

    def add(kind: str, end: int) -> None:
        nonlocal i, row
        text = source[i:end]
        lines = text.count("\n")
        out.append(Token(kind, text, row, row + lines))
        row, i = row + lines, end

    def quoted(at: int, quote: str, lines: bool) -> int:
        """The end of a string whose content begins at ``at``."""
        nonlocal broken
        while at < n:
            c = source[at]
            if c == "\\":
                at += 2
            elif c == quote:
                return at + 1
            elif c == "\n" and not lines:
                break
            else:
                at += 1
        broken = True
        return min(at, n)

    def template(at: int) -> int:
        nonlocal broken
        while at < n:
            c = source[at]
            if c == "\\":
                at += 2
            elif c == "`":
                return at + 1
            elif source.startswith("${", at):
                depth, at = 1, at + 2
                while at < n and depth:
                    c = source[at]
                    if c == "`":
                        at = template(at + 1)
                        continue
                    depth += (c == "{") - (c == "}")
                    at += 1
            else:
                at += 1
        broken = True
        return n

    word_at, op_at, blank_at = _WORD.match, _OP.match, _BLANK.match
    while i < n:
        c = source[i]
        # Most of a text are blanks, words and operators that nothing else begins like.
        if c.isspace():
            end = blank_at(source, i).end()
            row += source.count("\n", i, end)
            i = end
        elif c in _SINGLE:
            out.append(Token("op", c, row, row))
            i += 1
        elif (c.isalpha() or c == "_") and not (lexicon.rust_quotes and c in "bcr"):
            text = word_at(source, i).group()
            out.append(Token("word", text, row, row))
            i += len(text)
        elif c in _ONLY_OP:
            text = op_at(source, i).group()
            out.append(Token("op", text, row, row))
            i += len(text)
        elif source.startswith("//", i) or (i == 0 and source.startswith("#!") and not source.startswith("#![")):
            end = source.find("\n", i)
            i = n if end < 0 else end
        elif source.startswith("/*", i):
            depth, at = 1, i + 2
            while at < n and depth:
                if source.startswith("*/", at):
                    depth, at = depth - 1, at + 2
                elif lexicon.nested_comments and source.startswith("/*", at):
                    depth, at = depth + 1, at + 2
                else:
                    at += 1
            broken |= depth > 0
            row += source.count("\n", i, at)
            i = at
        elif lexicon.rust_quotes and (m := _RUST_RAW.match(source, i)):
            end = source.find('"' + m[1], m.end())
            broken |= end < 0
            add("str", n if end < 0 else end + 1 + len(m[1]))
        elif lexicon.rust_quotes and (m := _RUST_CHAR.match(source, i)):
            add("str", m.end())
        elif lexicon.rust_quotes and c in "bc" and source.startswith('"', i + 1):
            add("str", quoted(i + 2, '"', True))
        elif lexicon.rust_quotes and c == "'":
            m = re.compile(r"'\w*").match(source, i)
            add("word", max(m.end(), i + 1))
        elif c == '"':
            add("str", quoted(i + 1, '"', lexicon.rust_quotes))
        elif c == "'":
            add("str", quoted(i + 1, "'", False))
        elif c == "`" and lexicon.templates:
            add("str", template(i + 1))
        elif c == "`" and lexicon.raw_backtick:
            end = source.find("`", i + 1)
            broken |= end < 0
            add("str", n if end < 0 else end + 1)
        elif c == "/" and lexicon.regexes and (not out or out[-1].text in _BEFORE_REGEX):
            at, inside = i + 1, False
            while at < n and source[at] != "\n" and (inside or source[at] != "/"):
                inside = source[at] == "[" or (inside and source[at] != "]")
                at += 1 + (source[at] == "\\")
            end = re.compile(r"\w*").match(source, min(at + 1, n)).end()
            add("str", end)
        elif c.isdigit():
            add("num", _NUM.match(source, i).end())
        elif m := _WORD.match(source, i):
            add("word", m.end())
        else:
            add("op", _OP.match(source, i).end() if _OP.match(source, i) else i + 1)
    return out, broken

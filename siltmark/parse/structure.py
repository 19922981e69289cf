"""Functions, decisions and nested ifs of a source text, from its tokens.

Brackets make a tree; statements are recognised in it by their keywords. This stands in for
a full grammar: it covers functions, branches, else-if chains and expression contexts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from siltmark.parse.lexer import Lexicon, Token, tokenize

_CLOSE = {"(": ")", "[": "]", "{": "}"}


class Group:
    """A bracket with its content; a token where ``items`` is None."""

    __slots__ = ("token", "items", "end", "text")

    def __init__(self, token: Token, items: list["Group"] | None = None):
        self.token, self.items, self.text = token, items, token.text
        self.end: Token | None = None

    @property
    def end_row(self) -> int:
        last = self.end or (self.items[-1].end if self.items and self.items[-1].items is not None else None)
        return last.end_row if last else self.token.end_row


@dataclass
class Function:
    start_line: int
    end_line: int = 0
    complexity: int = 1
    if_total: int = 0
    if_nested: int = 0
    if_chained: int = 0
    if_max_depth: int = 0
    tokens: str = ""


@dataclass(frozen=True)
class Profile:
    """How a language writes what the metrics need; a new language is a new profile."""

    name: str
    lexicon: Lexicon
    keywords: frozenset[str]
    function_words: frozenset[str]
    branch_words: frozenset[str]
    #: Words whose block counts its arms: by this token, or by these words, at its top level.
    arm_words: frozenset[str]
    arm_token: str | None = None
    arm_starts: frozenset[str] = frozenset()
    #: Words after which, up to the end of the statement, an if is part of an expression.
    wrapping_words: frozenset[str] = frozenset()
    assignments_wrap: bool = False
    arrow_functions: bool = False
    do_while: bool = False
    macros: bool = False
    conditions_in_brackets: bool = False
    modifiers: frozenset[str] = frozenset()
    closures_stop_context: bool = True


@dataclass
class _State:
    """Where the walk is: the functions around, and the innermost one's ifs."""

    functions: list[Function]
    inner: Function | None = None
    depth: int = 0
    nested: bool = False
    wrapped: bool = False

    def of(self, **changes) -> "_State":
        new = _State.__new__(_State)
        new.__dict__.update(self.__dict__, **changes)
        return new


def bracket_tree(tokens: list[Token]) -> tuple[list[Group], bool]:
    """The bracket tree and whether brackets fail to match."""
    root: list[Group] = []
    stack: list[tuple[Group | None, list[Group]]] = [(None, root)]
    broken = False
    for t in tokens:
        if t.kind == "op" and t.text in _CLOSE:
            g = Group(t, [])
            stack[-1][1].append(g)
            stack.append((g, g.items))
        elif t.kind == "op" and t.text in ")]}":
            if len(stack) > 1 and _CLOSE[stack[-1][0].text] == t.text:
                stack.pop()[0].end = t
            else:
                broken = True
        else:
            stack[-1][1].append(Group(t))
    return root, broken or len(stack) > 1


def _is_operand_end(g: Group | None, keywords: frozenset[str]) -> bool:
    if g is None:
        return False
    if g.items is not None:
        return True
    if g.token.kind == "word":
        return g.text not in keywords or g.text in ("self", "this", "true", "false", "null", "nil")
    return g.token.kind in ("num", "str") or g.text in ("?", "++", "--")


class _Walk:
    def __init__(self, profile: Profile):
        self.p = profile
        self.found: list[Function] = []

    def decide(self, state: _State, n: int = 1) -> None:
        for f in state.functions:
            f.complexity += n

    def block(self, items: list[Group], state: _State) -> None:
        """Walks a list of items, statement by statement where a keyword starts one."""
        p, i, n = self.p, 0, len(items)
        outer = state
        while i < n:
            g = items[i]
            before = items[i - 1] if i else None
            if g.items is not None:
                inside = state
                if g.text == "(" and _is_operand_end(before, p.keywords):
                    inside = state.of(wrapped=True)
                if not (p.macros and before and before.text == "!" and i > 1 and items[i - 2].token.kind == "word"):
                    self.block(g.items, inside)
                i += 1
                continue
            word = g.text if g.token.kind == "word" and not (before and before.text in (".", "?.", "::")) else ""
            if word and i + 1 < n and items[i + 1].text == ":" and p.name == "javascript" and word not in ("default",):
                word = ""
            if word in p.function_words and (end := self.function(items, i, state)):
                i = end
                continue
            if g.text == "=>" and p.arrow_functions:
                i = self.arrow(items, i, state)
                continue
            if word == "if" and (not p.conditions_in_brackets or (i + 1 < n and items[i + 1].text == "(")):
                i = self.condition(items, i, state, chained=False)
                continue
            if word in p.arm_words:
                if end := self.arms(items, i, state):
                    i = end
                    continue
            if word in p.branch_words and self.is_branch(items, i):
                self.decide(state)
                if word == "do" and p.do_while and i + 1 < n:
                    self.block([items[i + 1]], state)
                    i += 2
                    if i < n and items[i].text == "while":
                        i += 1
                    continue
            elif g.text in ("&&", "||") and _is_operand_end(before, p.keywords):
                self.decide(state)
            elif word in p.wrapping_words or (g.text == "=" and p.assignments_wrap):
                state = state.of(wrapped=True)
            elif g.text == ";":
                state = outer
            i += 1

    def is_branch(self, items: list[Group], i: int) -> bool:
        after = items[i + 1].text if i + 1 < len(items) else ""
        if self.p.name == "rust" and items[i].text == "for":
            rest = [x.text for x in items[i + 1 :]]
            body = rest.index("{") if "{" in rest else len(rest)
            return after != "<" and "in" in rest[:body]
        if self.p.conditions_in_brackets and items[i].text != "do":
            return after == "(" or after == "await" or (items[i].text == "catch" and after == "{")
        return True

    def condition(self, items: list[Group], i: int, state: _State, chained: bool) -> int:
        """An if with its else branches from ``items[i]``; returns where it ends."""
        p, n = self.p, len(items)
        self.decide(state)
        depth = state.depth if chained else state.depth + 1
        if f := state.inner:
            f.if_total += 1
            f.if_nested += state.nested
            f.if_chained += chained
            f.if_max_depth = max(f.if_max_depth, depth)
        inside = state.of(depth=depth, nested=True)
        at = i + 1
        if p.conditions_in_brackets:
            if at < n and items[at].text == "(":
                self.block(items[at].items, inside)
                at += 1
            at = self.statement(items, at, inside)
        else:
            start = at
            while at < n and not (items[at].text == "{" and items[at].items is not None and not self.literal(items, at)):
                at += 1
            self.block(items[start:at], inside)
            if at < n:
                self.block(items[at].items, inside)
                at += 1
        if at < n and items[at].text == "else" and items[at].token.kind == "word":
            at += 1
            follows = not state.wrapped
            if at < n and items[at].text == "if":
                return self.condition(items, at, inside, chained=follows)
            if at < n and items[at].items is not None and items[at].text == "{":
                own = items[at].items
                alone = bool(own) and own[0].text == "if" and self.spans(own)
                if alone and p.name != "go":
                    self.condition(own, 0, inside, chained=follows)
                else:
                    self.block(own, inside)
                return at + 1
            return self.statement(items, at, inside)
        return at

    def literal(self, items: list[Group], at: int) -> bool:
        """Whether a brace in a condition belongs to a function or composite value and not to the body."""
        rest = items[at + 1 :]
        return bool(rest) and (rest[0].text in (";", ".", "==", "!=", "&&", "||") or rest[0].text == "{")

    def spans(self, own: list[Group]) -> bool:
        """Whether an if with its else branches is all there is in a block."""
        probe = _Walk(self.p)
        return probe.condition(own, 0, _State([]), False) >= len(own)

    def statement(self, items: list[Group], at: int, state: _State) -> int:
        """One statement after a bracketed condition; returns where it ends."""
        n = len(items)
        if at >= n:
            return at
        if items[at].text == "{" and items[at].items is not None:
            self.block(items[at].items, state)
            return at + 1
        if items[at].text == "if":
            return self.condition(items, at, state, chained=False)
        end, row = at, items[at].token.row
        while end < n and items[end].text not in (";", "else") and (end == at or items[end].token.row == row or items[end].text in (".", "?.") or items[end - 1].token.kind == "op"):
            row = max(row, items[end].end_row)
            end += 1
        end += end < n and items[end].text == ";"
        self.block(items[at:end], state)
        return end

    def arms(self, items: list[Group], i: int, state: _State) -> int | None:
        """A match or switch: as many decisions as arms; returns where it ends."""
        p, n, at = self.p, len(items), i + 1
        while at < n and not (items[at].text == "{" and items[at].items is not None) and items[at].text != ";":
            at += 1
        if at >= n or items[at].items is None:
            return None
        self.block(items[i + 1 : at], state)
        body = items[at].items
        if p.arm_token:
            self.decide(state, sum(x.text == p.arm_token and x.items is None for x in body))
            arm, inside = [], state.of(wrapped=True)
            pattern = True
            for j, x in enumerate(body):
                if x.items is None and x.text == p.arm_token:
                    pattern, arm = False, []
                    continue
                if pattern:
                    if x.text in ("&&", "||") and _is_operand_end(body[j - 1] if j else None, p.keywords):
                        self.decide(state)
                    continue
                arm.append(x)
                ends = x.text == "," or (x.text == "{" and x.items is not None and len(arm) == 1 and not (j + 1 < len(body) and body[j + 1].text in (".", "?")))
                if ends:
                    self.block(arm, inside)
                    pattern, arm = True, []
            self.block(arm, inside)
        else:
            self.decide(state, sum(x.items is None and x.token.kind == "word" and x.text in p.arm_starts for x in body))
            self.block(body, state)
        return at + 1

    def function(self, items: list[Group], i: int, state: _State) -> int | None:
        """A function from its keyword; None if there is no body, as in a type."""
        p, n, at = self.p, len(items), i + 1
        if p.name == "javascript":
            if at < n and items[at].text == "*":
                return None
            while at < n and items[at].text != "(":
                at += 1
            at += 1
        else:
            if p.name == "rust" and (at >= n or items[at].token.kind != "word"):
                return None
            brackets = 0
            while at < n and items[at].text != ";" and items[at].text != "{":
                brackets += items[at].text == "("
                if p.name == "go" and items[at].text in ("interface", "struct") and at + 1 < n and items[at + 1].text == "{":
                    at += 1
                if p.name == "go" and items[at].text in (",", "=", ":=") and brackets:
                    return None
                at += 1
        if at >= n or items[at].items is None or items[at].text != "{":
            return None
        start = i
        while start and items[start - 1].token.kind in ("word", "str") and items[start - 1].text in p.modifiers | {"\"C\""} or (start > 1 and p.name == "rust" and items[start - 1].text == "(" and items[start - 2].text == "pub"):
            start -= 1
        self.enter(items[start : at + 1], items[i + 1 : at], items[at].items, state)
        return at + 1

    def arrow(self, items: list[Group], i: int, state: _State) -> int:
        """An arrow function, whose parameters are the item before and whose body may be an expression."""
        n, at = len(items), i + 1
        start = max(0, i - 1)
        start -= bool(start and items[start - 1].text == "async")
        if at < n and items[at].items is not None and items[at].text == "{":
            end = at + 1
        else:
            end = at
            while end < n and items[end].text not in (",", ";") and (end == at or items[end].token.row == items[end - 1].end_row or items[end].text in (".", "?.", "?", ":", "&&", "||")):
                end += 1
        body = items[at].items if end == at + 1 and at < n and items[at].items is not None and items[at].text == "{" else items[at:end]
        self.enter(items[start:end], [], body, state)
        return max(end, at)

    def enter(self, whole: list[Group], head: list[Group], body: list[Group], state: _State) -> None:
        f = Function(whole[0].token.row, whole[-1].end_row)
        f.tokens = "\x1f".join(leaf_classes(whole, self.p.keywords))
        self.found.append(f)
        wrapped = state.wrapped if not self.p.closures_stop_context else False
        inner = _State([*state.functions, f], f, 0, False, wrapped)
        self.block(head, inner)
        self.block(body, inner)


def leaf_classes(items: list[Group], keywords: frozenset[str]) -> list[str]:
    """Classes of the leaves below ``items``, in order: what renaming doesn't change."""
    out: list[str] = []
    for g in items:
        out.append(leaf_class(g.token, keywords))
        if g.items is not None:
            out += leaf_classes(g.items, keywords)
            out.append(_CLOSE[g.text])
    return out


def leaf_class(t: Token, keywords: frozenset[str]) -> str:
    if t.kind == "str":
        return "STR"
    if t.kind == "num":
        return "NUM"
    if t.text in ("true", "false", "null", "nil", "None"):
        return "BOOL"
    if t.kind == "word" and t.text not in keywords:
        return "IDENT"
    return t.text


@dataclass
class Parsed:
    loc: int
    parse_incomplete: bool
    functions: list[Function] = field(default_factory=list)


def parse(source: str, profile: Profile) -> Parsed:
    """Lines of code, functions and whether the text is broken."""
    tokens, unended = tokenize(source, profile.lexicon)
    rows = {r for t in tokens for r in range(t.row, t.end_row + 1)}
    tree, unmatched = bracket_tree(tokens)
    walk = _Walk(profile)
    walk.block(tree, _State([]))
    return Parsed(len(rows), unended or unmatched, walk.found)

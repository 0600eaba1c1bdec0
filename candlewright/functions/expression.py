"""Boolean expressions over conditions: NOT before AND before OR, parentheses, names or positions; three-valued."""

from __future__ import annotations

import re

TOKEN = re.compile(r"\s*(?:(\()|(\))|([A-Za-z_][A-Za-z0-9_]*|\d+))")
LONGEST = 1151


def parse(text: str, names: list[str]) -> tuple:
    """Postfix-like tree ('or' | 'and' | 'not' | 'is', ...) with the sides of OR and AND in a fixed order.

    Positions stand for names by index. Unknown names, misplaced tokens, empty text and more than LONGEST nodes raise
    ValueError.
    """
    tokens, at = [], 0
    while text[at:].strip():
        m = TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected character at {at}")
        tokens.append(m[0].strip())
        at = m.end()
    if len(tokens) > LONGEST:
        raise ValueError("expression too long")
    place = 0

    def peek() -> str | None:
        return tokens[place] if place < len(tokens) else None

    def take() -> str:
        nonlocal place
        if place >= len(tokens):
            raise ValueError("expression ends too early")
        place += 1
        return tokens[place - 1]

    def chain(word: str, kind: str, below) -> tuple:
        sides = [below()]
        while (peek() or "").upper() == word:
            take()
            sides.append(below())
        if len(sides) == 1:
            return sides[0]
        flat = [x for s in sides for x in (s[1:] if s[0] == kind else (s,))]
        return (kind, *sorted(flat, key=repr))

    def one() -> tuple:
        t = take()
        if t.upper() == "NOT":
            return ("not", one())
        if t == "(":
            inside = chain("OR", "or", lambda: chain("AND", "and", one))
            if take() != ")":
                raise ValueError("missing )")
            return inside
        if t == ")" or t.upper() in ("AND", "OR"):
            raise ValueError(f"unexpected {t}")
        name = names[int(t)] if t.isdigit() and int(t) < len(names) else t
        if name not in names:
            raise ValueError(f"unknown condition {t}")
        return ("is", name)

    tree = chain("OR", "or", lambda: chain("AND", "and", one))
    if place != len(tokens):
        raise ValueError(f"unexpected {tokens[place]}")
    return tree


def to_sql(tree: tuple) -> str:
    """SQL text; NULL logic is the three-valued logic of the conditions."""
    kind = tree[0]
    if kind == "is":
        return tree[1]
    if kind == "not":
        return f"(NOT {to_sql(tree[1])})"
    return "(" + f" {kind.upper()} ".join(map(to_sql, tree[1:])) + ")"


def enumerate_trees(names: list[str], nodes: int):
    """All expressions of exactly `nodes` nodes in a fixed order: names, NOT, then AND and OR of two sides in order."""
    if nodes == 1:
        yield from (("is", n) for n in names)
        return
    for t in enumerate_trees(names, nodes - 1):
        if t[0] != "not":
            yield ("not", t)
    for k in range(1, nodes - 1):
        for a in enumerate_trees(names, k):
            for b in enumerate_trees(names, nodes - 1 - k):
                if repr(a) < repr(b):
                    yield ("and", a, b)
                    yield ("or", a, b)

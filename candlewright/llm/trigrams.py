"""Boolean trigram queries of regular expressions: what any matching text must contain.

A query is a set of clauses, each a set of trigrams; a text can match only if it holds all trigrams of some clause.
The query {empty clause} holds for every text: the expression has no mandatory trigram.
"""

from __future__ import annotations

Query = frozenset  # of frozensets of trigrams
ALL: Query = frozenset([frozenset()])
WIDTH, CLAUSES = 64, 64


def either(*queries: Query) -> Query:
    """The union, without clauses that another clause makes superfluous."""
    every = {c for q in queries for c in q}
    return frozenset(c for c in every if not any(d < c for d in every))


def both(a: Query, b: Query) -> Query:
    """Clauses of both; where they would be too many, one side alone, which asks for less."""
    if len(a) * len(b) > CLAUSES:
        return a if len(a) <= len(b) else b
    return either(frozenset(x | y for x in a for y in b))


def of_strings(strings: set[str]) -> Query:
    return either(*(frozenset([frozenset(s[i : i + 3] for i in range(len(s) - 2))]) for s in strings)) if strings else ALL


class Unknown(ValueError):
    """A construct that the parser doesn't know."""


class _Parser:
    """Sequences of nodes: ("one", characters or None for many), ("void",), ("either", sequences), ("times", low, node).

    Knows literals, escapes, classes, groups with flags, lookarounds (void), anchors and repeats with their lazy and
    possessive forms; what matters here is which texts a node asks for, not how it searches.
    """

    def __init__(self, pattern: str):
        self.text, self.at = pattern, 0

    def take(self, some: str) -> bool:
        found = self.text.startswith(some, self.at)
        self.at += len(some) if found else 0
        return found

    def next(self) -> str:
        if self.at >= len(self.text):
            raise Unknown(self.text)
        self.at += 1
        return self.text[self.at - 1]

    def sides(self) -> list[list]:
        out = [[]]
        while self.at < len(self.text) and self.text[self.at] != ")":
            if self.take("|"):
                out.append([])
            else:
                out[-1].append(self.repeats(self.atom()))
        return out

    def atom(self) -> tuple:
        c = self.next()
        if c == "(":
            void = False
            if self.take("?"):
                if self.take("=") or self.take("!") or self.take("<=") or self.take("<!"):
                    void = True
                elif not self.take(">"):
                    while (f := self.next()) != ":":
                        if f not in "imsu-":
                            raise Unknown(self.text)
            inner = self.sides()
            if not self.take(")"):
                raise Unknown(self.text)
            return ("void",) if void else ("either", inner)
        if c == "[":
            return ("one", self.members())
        if c == ".":
            return ("one", None)
        if c in "^$":
            return ("void",)
        if c in "*+?{":
            raise Unknown(self.text)
        return self.escape() if c == "\\" else ("one", frozenset(c.lower()))

    def escape(self) -> tuple:
        c = self.next()
        if c == "x":
            return ("one", frozenset(chr(int(self.next() + self.next(), 16)).lower()))
        if c in "bBGAzZ":
            return ("void",)
        if c in "pP" and self.take("{"):
            while self.next() != "}":
                pass
            return ("one", None)
        if c.isalnum():
            if c not in "dDsSwW":
                raise Unknown(self.text)
            return ("one", None)
        return ("one", frozenset(c))

    def members(self):
        """The characters of a class in lower case, or None where they are many, a range or unknown."""
        out, many = set(), self.take("^")
        first = True
        while (c := self.next()) != "]" or first:
            first = False
            kind = self.escape() if c == "\\" else ("one", frozenset(c.lower()))
            if kind[0] != "one" or kind[1] is None or self.text[self.at : self.at + 1] == "-" and self.text[self.at + 1 : self.at + 2] != "]":
                many = True
            out |= kind[1] or set() if kind[0] == "one" else set()
        return None if many or len(out) > 8 else frozenset(out)

    def repeats(self, node: tuple) -> tuple:
        while self.at < len(self.text) and self.text[self.at] in "*+?{":
            c = self.next()
            low, high = {"*": (0, None), "+": (1, None), "?": (0, 1)}.get(c, (0, 0))
            if c == "{":
                body = ""
                while (d := self.next()) != "}":
                    body += d
                least, comma, most = body.partition(",")
                low, high = int(least), (int(most) if most else None) if comma else int(least)
            self.take("?") or self.take("+")
            node = ("times", low, high, node)
        return node


def _node(node: tuple) -> tuple[set[str] | None, Query]:
    """The exact strings that a node matches, in lower case, or None and its query."""
    if node[0] == "void":
        return {""}, ALL
    if node[0] == "one":
        return (None if node[1] is None else set(node[1])), ALL
    if node[0] == "either":
        sides = [_sequence(x) for x in node[1]]
        if all(e is not None for e, _ in sides) and len(out := set().union(*(e for e, _ in sides))) <= WIDTH:
            return out, ALL
        return None, either(*(of_strings(e) if e is not None else q for e, q in sides))
    _, low, high, sub = node
    exact, query = _node(sub)
    if exact is not None and (low, high) == (0, 1):
        return exact | {""}, ALL
    if exact is not None and low == high and len(exact) ** low <= WIDTH and low <= 64:
        out = {""}
        for _ in range(low):
            out = {a + b for a in out for b in exact}
        return out, ALL
    return None, (of_strings(exact) if exact is not None else query) if low else ALL


def _sequence(nodes: list) -> tuple[set[str] | None, Query]:
    run, query, whole = {""}, ALL, True
    for node in nodes:
        exact, part = _node(node)
        if exact is None:
            query, run, whole = both(both(query, of_strings(run)), part), {""}, False
        elif len(exact) * len(run) <= WIDTH:
            run = {a + b for a in run for b in exact}
        else:
            query, run, whole = both(query, of_strings(run)), set(exact), False
    return (run, ALL) if whole else (None, both(query, of_strings(run)))


def query_of(pattern: str) -> Query:
    """The trigram query of a pattern, over texts in lower case. A pattern with a construct that isn't known asks for
    nothing, so its rule scans every text."""
    parser = _Parser(pattern)
    try:
        sides = parser.sides()
        if parser.at < len(pattern):
            raise Unknown(pattern)
    except Unknown:
        return ALL
    exact, query = _node(("either", sides))
    return of_strings(exact) if exact is not None else query

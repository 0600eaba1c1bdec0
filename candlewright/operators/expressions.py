"""Truth summaries of boolean expressions over a family of conditions."""

from __future__ import annotations

from itertools import islice

from candlewright.functions.expression import enumerate_trees, parse, to_sql
from candlewright.operators import conditions
from candlewright.plans.dialect import Dialect


def summary(d: Dialect, family: str, texts: dict[str, str], minutes: int = 60) -> str:
    """expression, evaluated, hits, misses, unknown; unknown admits nothing."""
    known = conditions.names(d, family)
    return _summary(d, family, {k: to_sql(parse(t, known)) for k, t in texts.items()}, minutes)


def search(d: Dialect, family: str, chosen: list[str], nodes: int, budget: int, start: int = 0) -> str:
    """The summary of `budget` expressions of a size, from a place in the order on: a search that can be resumed."""
    trees = islice(enumerate_trees(chosen, nodes), start, start + budget)
    return _summary(d, family, {f"{start + i}": to_sql(t) for i, t in enumerate(trees)}, 60)


def _summary(d: Dialect, family: str, sql: dict[str, str], minutes: int) -> str:
    sums = ", ".join(f"count(CASE WHEN {e} THEN 1 END) AS h{i}, count(CASE WHEN NOT {e} THEN 1 END) AS m{i}" for i, e in enumerate(sql.values()))
    rows = [(f"'{n}'", f"h{i}", f"m{i}") for i, n in enumerate(sql)]
    if d.spark:
        each = f"stack({len(rows)}, {', '.join(x for r in rows for x in r)}) AS (expression, hits, misses)"
    else:
        each = ", ".join(f"unnest([{', '.join(r[k] for r in rows)}]) AS {c}" for k, c in enumerate(("expression", "hits", "misses")))
    return f"SELECT expression, total AS evaluated, hits, misses, total - hits - misses AS unknown FROM (SELECT total, {each} FROM (SELECT count(*) AS total, {sums} FROM ({conditions.wide(d, family, minutes)}) w) c) s"

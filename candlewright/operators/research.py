"""Research over strategies: expression walks, walk-forward folds, trials, admission, pages and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from candlewright.functions.expression import parse, to_sql
from candlewright.operators import conditions, mining
from candlewright.operators.outcomes import WARM, hits, rows_as_list
from candlewright.operators.trades import WALK, greedy, priced, signals_of, totals, walk_sql_of
from candlewright.plans.dialect import SPARK, Dialect, run
from candlewright.sources.bars import day_of


def expression_hits(d: Dialect, family: str, texts: dict[str, str], minutes: int = 60, warm: str = WARM) -> str:
    """hits of boolean expressions over a family's conditions: a bar admits an expression that is true, never unknown."""
    known = conditions.names(d, family)
    rows = ", ".join(f"CASE WHEN {to_sql(parse(t, known))} THEN '{n}' END" for n, t in texts.items())
    text = f"SELECT series, us, day, {rows_as_list(d, rows)} AS names FROM ({conditions.wide(d, family, minutes)}) w WHERE {warm}"
    each = "explode(names)" if d.spark else "unnest(names)"
    return f"SELECT * FROM (SELECT series, us, {each} AS condition FROM ({text}) t) u WHERE condition IS NOT NULL"


def expression_walk(spark: SparkSession, sf_dir: str, family: str, texts: dict[str, str]) -> DataFrame:
    """Trades of each expression and series, one position at a time. Every position ends on its day, so days are walked
    apart, and no task holds more than a day's signals of a series."""
    rows = run(spark, sf_dir, f"SELECT *, {day_of(SPARK, 'signal_us')} AS day FROM ({signals_of(SPARK, expression_hits(SPARK, family, texts))}) s")
    return rows.groupBy("condition", "series", "day").applyInPandas(greedy, WALK)


def expression_walk_sql(d: Dialect, family: str, texts: dict[str, str]) -> str:
    return walk_sql_of(signals_of(d, expression_hits(d, family, texts)))


def walk_forward(d: Dialect, family: str, chosen: list[str], folds: int = 5, embargo: int = 1) -> str:
    """Folds of days in order, the first for training alone: for each later one the condition with the best total on the
    days before it, less an embargo of so many days, its total in the fold, and twice its midrank there; at or under the
    middle counts as overfitted. Conditions are ranked within a fold; days are numbered once over their distinct list."""
    days = f"SELECT day, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT day FROM ({priced(d, family, chosen)}) p) u"
    return f"""WITH g AS ({days}), f AS (SELECT day, i, CAST({d.tdiv(f'i * {folds}', 'n')} AS BIGINT) AS fold FROM g), s AS (SELECT fold, min(i) AS first FROM f GROUP BY fold),
p AS (SELECT q.condition, f.fold, f.i, sum(q.pnl) AS net FROM ({priced(d, family, chosen)}) q JOIN f ON f.day = q.day GROUP BY q.condition, f.fold, f.i),
c AS (SELECT DISTINCT condition FROM p),
t AS (SELECT s.fold, c.condition, CAST(coalesce(sum(CASE WHEN p.i < s.first - {embargo} THEN p.net END), 0) AS BIGINT) AS trained, CAST(coalesce(sum(CASE WHEN p.fold = s.fold THEN p.net END), 0) AS BIGINT) AS tested FROM s JOIN c ON s.fold > 0 LEFT JOIN p ON p.condition = c.condition AND p.i >= 0 GROUP BY s.fold, c.condition),
b AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY trained DESC, condition) AS place FROM t)
SELECT b.fold, b.condition, b.trained, b.tested, count(CASE WHEN t.tested < b.tested THEN 1 END) * 2 + count(CASE WHEN t.tested = b.tested THEN 1 END) + 1 AS midrank2, count(*) AS strategies,
  (count(CASE WHEN t.tested < b.tested THEN 1 END) * 2 + count(CASE WHEN t.tested = b.tested THEN 1 END) + 1 <= count(*) + 1) AS bottom_half FROM b JOIN t ON t.fold = b.fold WHERE b.place = 1 GROUP BY b.fold, b.condition, b.trained, b.tested"""


def purged(d: Dialect, family: str, chosen: list[str], folds: int = 4, horizon: int = 1) -> str:
    """Each condition's total in every fold of days and on the days that may train for it: those outside the fold, purged
    of `horizon` days before it and as many after."""
    days = f"SELECT day, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT day FROM ({priced(d, family, chosen)}) p) u"
    return f"""WITH g AS ({days}), f AS (SELECT {d.each('0', str(folds - 1))} AS fold), r AS (SELECT f.fold, {d.tdiv('f.fold * n', str(folds))} AS lo, {d.tdiv('(f.fold + 1) * n', str(folds))} AS hi FROM f JOIN (SELECT max(n) AS n FROM g) m ON 1 = 1),
p AS (SELECT q.condition, g.i, sum(q.pnl) AS net FROM ({priced(d, family, chosen)}) q JOIN g ON g.day = q.day GROUP BY q.condition, g.i)
SELECT r.fold, p.condition, CAST(coalesce(sum(CASE WHEN i >= lo AND i < hi THEN net END), 0) AS BIGINT) AS tested, CAST(coalesce(sum(CASE WHEN i < lo - {horizon} OR i >= hi + {horizon} THEN net END), 0) AS BIGINT) AS trained, count(CASE WHEN i < lo - {horizon} OR i >= hi + {horizon} THEN 1 END) AS days
FROM r JOIN p ON p.i >= 0 GROUP BY r.fold, p.condition"""


def trials(spark: SparkSession, sf_dir: str, family: str, chosen: list[str], least: int) -> DataFrame:
    """What a ladder measured: sets counted, frequent ones, those that closure shows to repeat others, and the trials left."""
    from candlewright.functions.statistics import effective_trials

    rows = run(spark, sf_dir, f"SELECT concat_ws('/', series, us) AS bar, condition AS item FROM ({hits(SPARK, family, chosen)}) h")
    sets, accounts = mining.ladder(rows, least)
    frequent = sets.count()
    redundant = frequent - mining.closed(sets).count()
    measured = accounts[0]["survivors"] + sum(a["infrequent"] + a["survivors"] for a in accounts if "infrequent" in a)
    return spark.createDataFrame([(measured, frequent, redundant, effective_trials(accounts, redundant))], "measured long, frequent long, redundant long, trials long")


def trials_sql(family: str, chosen: list[str], least: int) -> str:
    """The same by enumeration: a set is measured if every set with one item less is frequent."""
    n = len(chosen)
    subsets = " AND ".join(f"((m & {1 << i}) = 0 OR (m - {1 << i}) IN (SELECT mask FROM sets))" for i in range(n))
    return f"""WITH {mining.subsets_sql(family, chosen, least)},
c AS (SELECT count(*) AS measured FROM s WHERE bit_count(m) > 1 AND {subsets}), f AS (SELECT count(*) AS frequent, count(*) FILTER (k = 1) AS ones, count(*) FILTER (EXISTS (SELECT 1 FROM sets b WHERE b.k = a.k + 1 AND b.hits = a.hits AND (a.mask & b.mask) = a.mask)) AS redundant FROM sets a)
SELECT CAST(measured + ones AS BIGINT) AS measured, frequent, redundant, CAST(greatest(1, measured + ones - redundant) AS BIGINT) AS trials FROM c, f"""


#: A policy: for each field of totals, in order, how it is compared with its bound. A row is admitted if every field passes.
POLICY = (
    ("trades", ">=", 30), ("wins", ">=", 10), ("losses", "<=", 100_000), ("win_bp", ">=", 3_500), ("profit_factor", ">=", 80), ("net", ">", -50_000), ("drawdown", "<=", 200_000),
    ("worst", ">=", -60_000), ("average_win", ">=", 100), ("average_loss", "<=", 50_000), ("reward", ">=", 60), ("recovery", ">", -1_000),
)


def admission(d: Dialect, family: str, chosen: list[str], policy: tuple = POLICY) -> str:
    """Each condition against a policy: every field that fails, in the policy's order, or admitted. A field without a value
    fails."""
    part = lambda a, b: f"CASE WHEN {b} > 0 THEN {d.tdiv(a, b)} END"
    fields = {
        "trades": "trades", "wins": "wins", "losses": "losses", "win_bp": part("wins * 10000", "trades"), "profit_factor": part("gross_win * 100", "gross_loss"), "net": "gross_win - gross_loss", "drawdown": "drawdown", "worst": "worst",
        "average_win": part("gross_win", "wins"), "average_loss": part("gross_loss", "losses"), "reward": part("gross_win * losses * 100", "gross_loss * wins"), "recovery": part("(gross_win - gross_loss) * 100", "drawdown"),
    }
    values = ", ".join(f"{e} AS f_{n}" for n, e in fields.items())
    fails = ", ".join(f"CASE WHEN coalesce(f_{n} {op} {bound}, false) THEN NULL ELSE '{n}' END" for n, op, bound in policy)
    return f"SELECT condition, concat_ws(',', {fails}) AS failed, concat_ws(',', {fails}) = '' AS admitted FROM (SELECT condition, {values} FROM ({totals(d, family, chosen)}) t) v"


def report(d: Dialect, family: str, chosen: list[str]) -> str:
    """One line of text for each condition: name, trades, win rate with two decimals, net and drawdown in rupees."""
    money = lambda x: f"concat(CASE WHEN {x} < 0 THEN '-' ELSE '' END, {d.text(d.tdiv(f'abs({x})', '100'))}, '.', lpad({d.text(f'abs({x}) % 100')}, 2, '0'))"
    rate = d.tdiv("wins * 10000", "trades")
    share = f"concat({d.text(d.tdiv(rate, '100'))}, '.', lpad({d.text(f'{rate} % 100')}, 2, '0'), '%')"
    return f"SELECT condition, concat(rpad(condition, 32, ' '), lpad({d.text('trades')}, 7, ' '), lpad({share}, 9, ' '), lpad({money('(gross_win - gross_loss)')}, 14, ' '), lpad({money('CAST(drawdown AS BIGINT)')}, 14, ' ')) AS line FROM ({totals(d, family, chosen)}) t"


def frontier_page(d: Dialect, family: str, chosen: list[str], k: int = 2, least: int = 40, offset: int = 2, limit: int = 10) -> str:
    """A page of a level's sets by hits, ties by name."""
    return f"SELECT items, hits FROM ({mining.sets_sql(d, family, chosen, k, least)}) s ORDER BY hits DESC, items LIMIT {limit} OFFSET {offset}"


def candidate_trades_page(d: Dialect, family: str, chosen: list[str], offset: int = 100, limit: int = 50) -> str:
    """A page of all candidate trades, the newest first."""
    return f"SELECT condition, series, signal_us, entry_us, exit_us, pnl FROM ({priced(d, family, chosen)}) p ORDER BY entry_us DESC, condition, series, signal_us LIMIT {limit} OFFSET {offset}"


def trades_page(d: Dialect, family: str, chosen: list[str], day: str = "max(day)", limit: int = 50) -> str:
    """The last traded day's trades, best first."""
    p = priced(d, family, chosen)
    return f"SELECT p.condition, p.series, p.signal_us, p.pnl FROM ({p}) p JOIN (SELECT {day} AS day FROM ({p}) q) m ON p.day = m.day ORDER BY pnl DESC, p.condition, p.series, signal_us LIMIT {limit}"


def account(spark: SparkSession, sf_dir: str, family: str, chosen: list[str], least: int) -> DataFrame:
    """A ladder's account of each level from the second: sets generated, pruned, infrequent and surviving."""
    rows = run(spark, sf_dir, f"SELECT concat_ws('/', series, us) AS bar, condition AS item FROM ({hits(SPARK, family, chosen)}) h")
    levels = [(a["k"], a["generated"], a["pruned"], a["infrequent"], a["survivors"]) for a in mining.ladder(rows, least)[1] if "generated" in a]
    return spark.createDataFrame(levels, "k int, generated long, pruned long, infrequent long, survivors long")


def account_sql(family: str, chosen: list[str], least: int) -> str:
    """The same by enumeration: a level's pairs agree in all but their highest items, and a set stays that has every set with
    one item less among the frequent ones."""
    subsets = " AND ".join(f"((m & {1 << i}) = 0 OR (m - {1 << i}) IN (SELECT mask FROM sets))" for i in range(len(chosen)))
    return f"""WITH {mining.subsets_sql(family, chosen, least)},
p AS (SELECT k, mask - CAST(power(2, floor(log2(mask))) AS BIGINT) AS prefix, count(*) AS n FROM sets GROUP BY 1, 2), g AS (SELECT k + 1 AS k, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS generated FROM p GROUP BY k),
c AS (SELECT bit_count(m) AS k, count(*) AS candidates FROM s WHERE bit_count(m) > 1 AND {subsets} GROUP BY 1), f AS (SELECT k, count(*) AS survivors FROM sets GROUP BY k)
SELECT CAST(g.k AS INTEGER) AS k, generated, generated - coalesce(candidates, 0) AS pruned, coalesce(candidates, 0) - coalesce(survivors, 0) AS infrequent, coalesce(survivors, 0) AS survivors FROM g LEFT JOIN c ON c.k = g.k LEFT JOIN f ON f.k = g.k"""

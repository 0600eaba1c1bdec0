"""Reports, rules and schedules over strategies: summary, verdicts, comparison, placement, trailing exits, one position."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from candlewright.operators import conditions
from candlewright.operators.outcomes import WARM, hits
from candlewright.operators.trades import pooled, priced, signals
from candlewright.plans.dialect import SPARK, Dialect, run
from candlewright.sources.bars import MINUTE, bars, day_of, squared, valid


def summary(d: Dialect, family: str, chosen: list[str]) -> str:
    """Each condition's trades: gross gains and losses, profit factor in hundredths (null: nothing lost), win rate in
    basis points, averages, extremes."""
    return f"""SELECT condition, trades, wins, gross_win, gross_loss, CASE WHEN gross_loss > 0 THEN {d.tdiv('gross_win * 100', 'gross_loss')} END AS profit_factor, {d.tdiv('wins * 10000', 'trades')} AS win_bp,
  CASE WHEN wins > 0 THEN {d.tdiv('gross_win', 'wins')} END AS average_win, CASE WHEN losses > 0 THEN {d.tdiv('gross_loss', 'losses')} END AS average_loss, best, worst FROM (
  SELECT condition, count(*) AS trades, count(CASE WHEN pnl > 0 THEN 1 END) AS wins, count(CASE WHEN pnl < 0 THEN 1 END) AS losses, CAST(coalesce(sum(CASE WHEN pnl > 0 THEN pnl END), 0) AS BIGINT) AS gross_win,
    CAST(coalesce(sum(CASE WHEN pnl < 0 THEN -pnl END), 0) AS BIGINT) AS gross_loss, max(pnl) AS best, min(pnl) AS worst FROM ({priced(d, family, chosen)}) p GROUP BY condition) s"""


def verdicts(d: Dialect, family: str, chosen: list[str], least_trades: int = 30, win_bp: int = 4000, reward: int = 100, floor: int = 0) -> str:
    """The first rule that a condition's trades break, in a fixed order, or met. `reward` is average gain over average
    loss in hundredths."""
    return f"""SELECT condition, CASE WHEN trades = 0 THEN 'no_trades' WHEN wins = 0 THEN 'no_winners' WHEN trades < {least_trades} THEN 'too_few_trades' WHEN win_bp < {win_bp} THEN 'win_rate'
  WHEN average_loss > 0 AND average_win * 100 < average_loss * {reward} THEN 'reward' WHEN gross_win - gross_loss <= {floor} THEN 'floor' ELSE 'met' END AS verdict FROM ({summary(d, family, chosen)}) s"""


def pool_order(d: Dialect, family: str, chosen: list[str]) -> str:
    """Rank: rules met first, then the smaller drawdown over series, then profit factor (nothing lost first), then net,
    then name."""
    return f"""SELECT s.condition, v.verdict, w.drawdown, CAST(row_number() OVER (ORDER BY CASE WHEN v.verdict = 'met' THEN 0 ELSE 1 END, w.drawdown, CASE WHEN profit_factor IS NULL THEN 0 ELSE 1 END, profit_factor DESC, gross_win - gross_loss DESC, s.condition) AS INT) AS place
FROM ({summary(d, family, chosen)}) s JOIN ({verdicts(d, family, chosen)}) v ON s.condition = v.condition JOIN ({pooled(d, family, chosen)}) w ON s.condition = w.condition"""


def comparison(d: Dialect, family: str, chosen: list[str], fine: int = 30, coarse: int = 60, least: int = 30) -> str:
    """Each condition's support at two bar lengths, in basis points of the warm bars of each, which is the more common by
    exact ratio, and a rank by the difference among those with at least `least` hits at both; the others have none."""
    side = lambda m: f"SELECT condition, count(*) AS n, max(total) AS total FROM ({hits(d, family, chosen, m)}) h JOIN (SELECT count(*) AS total FROM ({conditions.context(d, m)}) v WHERE {WARM}) t ON 1 = 1 GROUP BY condition"
    a, b = d.tdiv("a.n * 10000", "a.total"), d.tdiv("b.n * 10000", "b.total")
    both = f"SELECT a.condition, a.n AS fine_hits, b.n AS coarse_hits, {a} AS fine_bp, {b} AS coarse_bp, CASE WHEN a.n * b.total > b.n * a.total THEN 'fine' WHEN a.n * b.total < b.n * a.total THEN 'coarse' ELSE 'equal' END AS verdict, a.n >= {least} AND b.n >= {least} AS eligible FROM ({side(fine)}) a JOIN ({side(coarse)}) b ON a.condition = b.condition"
    return f"SELECT *, CASE WHEN eligible THEN CAST(row_number() OVER (PARTITION BY eligible ORDER BY abs(fine_bp - coarse_bp) DESC, condition) AS INT) END AS place FROM ({both}) c"


def placement(d: Dialect, family: str, chosen: list[str], folds: int = 5) -> str:
    """For each fold of days: the condition with the best total on the other days, and twice its midrank on this fold;
    below the middle counts as overfitted."""
    return f"""WITH p AS (SELECT condition, {d.pmod('day', str(folds))} AS fold, CAST(sum(pnl) AS BIGINT) AS net FROM ({priced(d, family, chosen)}) q GROUP BY condition, {d.pmod('day', str(folds))}),
g AS (SELECT c.condition, f.fold, coalesce(p.net, 0) AS net FROM (SELECT DISTINCT condition FROM p) c CROSS JOIN (SELECT DISTINCT fold FROM p) f LEFT JOIN p ON p.condition = c.condition AND p.fold = f.fold),
t AS (SELECT *, sum(net) OVER (PARTITION BY condition) - net AS trained FROM g),
b AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY trained DESC, condition) AS place FROM t)
SELECT b.fold, b.condition, CAST(b.trained AS BIGINT) AS trained, b.net AS tested, count(CASE WHEN g.net < b.net THEN 1 END) * 2 + count(CASE WHEN g.net = b.net THEN 1 END) + 1 AS midrank2, count(*) AS strategies,
  (count(CASE WHEN g.net < b.net THEN 1 END) * 2 + count(CASE WHEN g.net = b.net THEN 1 END) + 1 <= count(*) + 1) AS bottom_half FROM b JOIN g ON g.fold = b.fold WHERE b.place = 1 GROUP BY b.fold, b.condition, b.trained, b.net"""


def trailing(d: Dialect, family: str, chosen: list[str], trails: tuple[int, ...] = (2_000, 10_000, 50_000), arm: int = 10_000, minutes: int = 60) -> str:
    """Trailing stops, at once and armed from the bar after a gain of `arm`: the retreat (parts per million) is measured
    from the peak before each bar; totals for each condition and trail."""
    step = minutes * MINUTE
    v = squared(d, minutes)
    each = "(PARTITION BY h.condition, h.series, h.us ORDER BY b.us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    grid = " UNION ALL ".join(f"SELECT {t} AS trail" for t in trails)
    stop = lambda c: f"min(CASE WHEN {c} AND (peak - l) * 1000000 >= trail * peak THEN us END)"
    value = lambda at: f"CAST(sum(CASE WHEN {at} IS NULL THEN last_close - entry ELSE {d.tdiv(f'peak_{at} * (1000000 - trail)', '1000000')} - entry END) AS BIGINT)"
    peak_at = lambda c: d.first("CASE WHEN " + c + " AND (peak - l) * 1000000 >= trail * peak THEN peak END", f"CASE WHEN {c} AND (peak - l) * 1000000 >= trail * peak THEN 0 ELSE 1 END", "us")
    return f"""WITH v AS ({v}), p AS (SELECT h.condition, h.series, h.us AS signal_us, e.o AS entry, b.us, b.l, b.h, b.c, greatest(e.o, coalesce(max(b.h) OVER {each}, e.o)) AS peak,
  max(CASE WHEN (b.h - e.o) * 1000000 >= {arm} * e.o THEN 1 ELSE 0 END) OVER {each} = 1 AS armed FROM ({hits(d, family, chosen, minutes)}) h
  JOIN v e ON e.series = h.series AND e.us = h.us + {step} AND e.day = {day_of(d, 'h.us')} AND e.fillable JOIN v b ON b.series = e.series AND b.day = e.day AND b.us >= e.us AND b.fillable WHERE e.o > 0),
x AS (SELECT condition, series, signal_us, entry, trail, {stop('true')} AS plain, {stop('coalesce(armed, false)')} AS late, {peak_at('true')} AS peak_plain, {peak_at('coalesce(armed, false)')} AS peak_late, {d.last('c', 'us')} AS last_close FROM p CROSS JOIN ({grid}) g GROUP BY condition, series, signal_us, entry, trail)
SELECT condition, trail, count(*) AS trades, count(plain) AS stopped, count(late) AS stopped_armed, {value('plain')} AS total, {value('late')} AS total_armed FROM x GROUP BY condition, trail"""


def aligned(d: Dialect, coarse: int = 60, fine: int = 5) -> str:
    """Each signal bar with the execution bar that opens exactly when it closes, on the same day, or unreachable."""
    return f"SELECT s.series, s.us AS signal_us, e.us AS exec_us, e.o AS exec_open, CASE WHEN e.us IS NULL THEN 'unreachable' ELSE 'aligned' END AS verdict FROM ({valid(d, coarse)}) s LEFT JOIN ({valid(d, fine)}) e ON e.series = s.series AND e.day = s.day AND e.us = s.us + {coarse * MINUTE}"


def stamped(d: Dialect, family: str, chosen: list[str], reference: str = "view") -> str:
    """Each priced trade with the reference series' close at its signal: a stamp, never an input."""
    return f"SELECT p.condition, p.series, p.signal_us, p.pnl, r.c AS reference_close FROM ({priced(d, family, chosen)}) p LEFT JOIN ({bars(d, 60)}) r ON r.series = '{reference}' AND r.us = p.signal_us"


def resolved_names(d: Dialect) -> str:
    """Shortened names of nations resolved to the only nation whose letters hold theirs in order, starting alike, with
    equal digits."""
    every_match = "" if d.spark else ", 'g'"  # one language replaces all matches only if told
    letters = lambda x: f"regexp_replace(upper({x}), '[^A-Z0-9]', ''{every_match})"
    short = f"regexp_replace(n_name, '[AEIOU_]', ''{every_match})"
    digits = lambda x: f"regexp_replace({x}, '[^0-9]', ''{every_match})"
    match = "rlike" if d.spark else "~"
    every = f"regexp_replace(asked, '(.)', '{'$1' if d.spark else chr(92) + '1'}.*'{every_match})"
    return f"""WITH a AS (SELECT n_nationkey AS k, {letters(short)} AS asked FROM {{nation}}), m AS (SELECT n_nationkey AS t, {letters('n_name')} AS name FROM {{nation}}),
c AS (SELECT a.k, min(m.t) AS target, count(m.t) AS found FROM a LEFT JOIN m ON substr(m.name, 1, 1) = substr(a.asked, 1, 1) AND m.name {match} ({every}) AND {digits('m.name')} = {digits('a.asked')} GROUP BY a.k)
SELECT k AS n_nationkey, CASE WHEN found = 1 THEN target END AS target, CASE WHEN found = 1 THEN 'resolved' WHEN found = 0 THEN 'unknown' ELSE 'ambiguous' END AS verdict FROM c"""


ADMITTED = "day long, condition string, series string, signal_us long, entry_us long, exit_us long, pnl long"


def offered(d: Dialect, family: str, chosen: list[str]) -> str:
    """Trades with their place in the queue of a minute: the priority of their condition (its place among the chosen), then
    a digest of what they are, so that no name is favoured."""
    priority = "CASE condition " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(chosen)) + " END"
    digest = f"md5(concat(condition, '|', series, '|', {d.text('signal_us')}))"
    return f"SELECT {day_of(d, 'entry_us')} AS day, condition, series, signal_us, entry_us, exit_us, exit - entry AS pnl, {priority} AS priority, {digest} AS digest FROM ({signals(d, family, chosen)}) s WHERE exit_us IS NOT NULL AND entry_us IS NOT NULL"


def admit(rows: pd.DataFrame) -> pd.DataFrame:
    """One day's trades under a single position over all series: by entry, priority and digest; a trade is admitted if its
    entry comes after the position before has ended."""
    out, until = [], -1
    for r in rows.sort_values(["entry_us", "priority", "digest"])[[x.split()[0] for x in ADMITTED.split(", ")]].itertuples(index=False):
        if r.entry_us > until:
            out.append(tuple(r))
            until = r.exit_us
    return pd.DataFrame(out, columns=[x.split()[0] for x in ADMITTED.split(", ")])


def scheduled(spark: SparkSession, sf_dir: str, family: str, chosen: list[str]) -> DataFrame:
    """Trades of the single-position schedule. Every trade ends on its day, so days are scheduled apart."""
    return run(spark, sf_dir, offered(SPARK, family, chosen)).groupBy("day").applyInPandas(admit, ADMITTED)


def scheduled_sql(d: Dialect, family: str, chosen: list[str]) -> str:
    """The schedule by a recursive query, for comparison."""
    return f"""WITH RECURSIVE s AS ({offered(d, family, chosen)}),
n AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY entry_us, priority, digest) AS i FROM s),
r AS (SELECT day, i, exit_us AS until, true AS taken FROM n WHERE i = 1
  UNION ALL SELECT n.day, n.i, CASE WHEN n.entry_us > r.until THEN n.exit_us ELSE r.until END AS until, n.entry_us > r.until AS taken FROM r JOIN n ON n.day = r.day AND n.i = r.i + 1)
SELECT n.day, n.condition, n.series, n.signal_us, n.entry_us, n.exit_us, n.pnl FROM n JOIN r ON n.day = r.day AND n.i = r.i WHERE r.taken"""

"""Simulated trades: one position at a time, signal-candle stops, exit ladders, and reports over trades."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from candlewright.operators.outcomes import WARM, hits
from candlewright.plans.dialect import SPARK, Dialect, run
from candlewright.sources.bars import DAY, IST, MINUTE, day_of, exit_of, squared, valid

WALK = "condition string, series string, signal_us long, entry_us long, exit_us long, entry long, exit long, pnl long"


def signals(d: Dialect, family: str, chosen: list[str], minutes: int = 60, horizon: int = 2, warm: str = WARM) -> str:
    """Each hit with its entry at the next bar's open, exactly one bar on, and its exit at a bar's close: `horizon` bars
    after the entry, or at the square-off where that comes first and has a price. Both on the hit's day; null where a bar
    is missing, the entry's bar ends after the square-off, or the position has no priced end."""
    return signals_of(d, hits(d, family, chosen, minutes, warm), minutes, horizon)


def signals_of(d: Dialect, hit_rows: str, minutes: int = 60, horizon: int = 2) -> str:
    """signals of any rows of (condition, series, us)."""
    step = minutes * MINUTE
    return f"""SELECT h.condition, h.series, h.us AS signal_us, e.us AS entry_us, x.us AS exit_us, e.o AS entry, x.c AS exit FROM ({hit_rows}) h
LEFT JOIN ({squared(d, minutes)}) e ON h.series = e.series AND e.us = h.us + {step} AND e.day = {day_of(d, 'h.us')} AND e.fillable
LEFT JOIN ({valid(d, minutes)}) x ON h.series = x.series AND x.us = {exit_of('e.us', step * horizon)} AND x.us > e.us AND x.day = e.day"""


def greedy(rows: pd.DataFrame) -> pd.DataFrame:
    """Trades of one (condition, series): a signal is taken if its entry comes after the position before has ended; an
    entry without an exit still takes its place until the bar it would have ended."""
    out, until = [], None
    for r in rows.sort_values("signal_us").itertuples(index=False):
        if pd.isna(r.entry_us) or (until is not None and r.entry_us <= until):
            continue
        until = r.exit_us if not pd.isna(r.exit_us) else r.entry_us
        if not pd.isna(r.exit_us):
            out.append((r.condition, r.series, r.signal_us, int(r.entry_us), int(r.exit_us), int(r.entry), int(r.exit), int(r.exit - r.entry)))
    return pd.DataFrame(out, columns=[x.split()[0] for x in WALK.split(", ")])


def walk(spark: SparkSession, sf_dir: str, family: str, chosen: list[str]) -> DataFrame:
    """Trades of each condition and series, one position at a time. Every position ends on its day, so days are walked
    apart, and no task holds more than a day's signals of a series."""
    rows = run(spark, sf_dir, f"SELECT *, {day_of(SPARK, 'signal_us')} AS day FROM ({signals(SPARK, family, chosen)}) s")
    return rows.groupBy("condition", "series", "day").applyInPandas(greedy, WALK)


def walk_sql(d: Dialect, family: str, chosen: list[str]) -> str:
    return walk_sql_of(signals(d, family, chosen))


def walk_sql_of(signal_rows: str) -> str:
    """The greedy walk by a recursive query, for comparison."""
    return f"""WITH RECURSIVE s AS (SELECT * FROM ({signal_rows}) q WHERE entry_us IS NOT NULL),
n AS (SELECT *, coalesce(exit_us, entry_us) AS until, row_number() OVER (PARTITION BY condition, series ORDER BY signal_us) AS i FROM s),
r AS (SELECT condition, series, i, until, true AS taken FROM n WHERE i = 1
  UNION ALL SELECT n.condition, n.series, n.i, CASE WHEN n.entry_us > r.until THEN n.until ELSE r.until END AS until, n.entry_us > r.until AS taken FROM r JOIN n ON n.condition = r.condition AND n.series = r.series AND n.i = r.i + 1)
SELECT n.condition, n.series, n.signal_us, n.entry_us, n.exit_us, n.entry, n.exit, n.exit - n.entry AS pnl FROM n JOIN r ON n.condition = r.condition AND n.series = r.series AND n.i = r.i WHERE r.taken AND n.exit_us IS NOT NULL"""


def candle_stop(d: Dialect, family: str, chosen: list[str], minutes: int = 60) -> str:
    """Long trades stopped at the signal candle's low, on one-minute bars: entry at the open of the minute at which the
    signal closes, exit at the stop (at the open where it gaps below) or at the 15:09 close. Refused, in this order, where
    there is no such minute, it lies beyond the square-off, it opens at or under the stop, or no stop is touched and the
    square-off has no price."""
    step = minutes * MINUTE
    return f"""WITH m AS ({squared(d, 1)}), s AS (SELECT h.condition, h.series, h.us AS signal_us, b.l AS stop, b.day, e.us AS entry_us, e.o AS entry, coalesce(e.fillable, false) AS fillable
  FROM ({hits(d, family, chosen, minutes)}) h JOIN ({valid(d, minutes)}) b ON h.series = b.series AND h.us = b.us LEFT JOIN m e ON e.series = h.series AND e.day = b.day AND e.us = h.us + {step}),
p AS (SELECT s.*, m.us, m.l, m.c, m.last_fill, m.real_close FROM s JOIN m ON m.series = s.series AND m.day = s.day AND m.us >= s.entry_us AND m.fillable WHERE s.entry > s.stop AND s.fillable),
t AS (SELECT condition, series, signal_us, entry_us, entry, stop, min(CASE WHEN l <= stop THEN us END) AS touched, max(last_fill) AS last_fill, max(CASE WHEN real_close AND us = last_fill THEN c END) AS close FROM p GROUP BY condition, series, signal_us, entry_us, entry, stop),
r AS (SELECT t.*, CASE WHEN touched IS NOT NULL THEN CASE WHEN m.o < t.stop THEN m.o ELSE t.stop END ELSE t.close END AS exit, coalesce(touched, CASE WHEN t.close IS NOT NULL THEN t.last_fill END) AS exit_us FROM t LEFT JOIN m ON m.series = t.series AND m.us = t.touched)
SELECT condition, series, signal_us, entry_us, entry, stop, exit_us, exit, CASE WHEN exit_us IS NULL THEN 'no_square_off' ELSE 'taken' END AS verdict FROM r
UNION ALL SELECT condition, series, signal_us, entry_us, entry, stop, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CASE WHEN entry_us IS NULL THEN 'no_next_minute' WHEN NOT fillable THEN 'too_late' ELSE 'opens_below_stop' END FROM s WHERE entry_us IS NULL OR NOT fillable OR entry <= stop"""


def exit_grid(d: Dialect, family: str, chosen: list[str], stops: tuple[int, ...] = (2_000, 10_000, 50_000), targets: tuple[int, ...] = (2_000, 10_000, 50_000), minutes: int = 60) -> str:
    """Every stop and target (parts per million of the entry) over every hit's path, which ends with the last bar that ends
    by the square-off: which is reached first. Both on one bar is ambiguous: the pessimistic reading takes the stop, the
    optimistic one the target. For each cell: trades, exits by kind, ambiguous ones, gaps (stopped at an open beyond the
    stop), wins, gross gains and losses, extremes, both totals, and bars held, under the pessimistic reading but for one."""
    step = minutes * MINUTE
    v = squared(d, minutes)
    cells = " UNION ALL ".join(f"SELECT {s} AS stop_ppm, {t} AS target_ppm" for s in stops for t in targets)
    lost, won = f"-{d.tdiv('stop_ppm * entry', '1000000')}", d.tdiv("target_ppm * entry", "1000000")
    outcome = lambda kind: f"CASE {kind} WHEN 'stop' THEN {lost} WHEN 'target' THEN {won} ELSE last_close - entry END"
    return f"""WITH v AS ({v}), p AS (SELECT h.condition, h.series, h.us AS signal_us, e.o AS entry, e.us AS entry_us, b.us, b.o, b.c, (e.o - b.l) * 1000000 AS mae, (b.h - e.o) * 1000000 AS mfe FROM ({hits(d, family, chosen, minutes)}) h
  JOIN v e ON e.series = h.series AND e.us = h.us + {step} AND e.day = {day_of(d, 'h.us')} AND e.fillable JOIN v b ON b.series = e.series AND b.day = e.day AND b.us >= e.us AND b.fillable WHERE e.o > 0),
x AS (SELECT p.condition, p.series, p.signal_us, p.entry, p.entry_us, g.stop_ppm, g.target_ppm, min(CASE WHEN mae >= g.stop_ppm * p.entry THEN us END) AS stopped, min(CASE WHEN mfe >= g.target_ppm * p.entry THEN us END) AS reached, {d.last('p.c', 'p.us')} AS last_close, max(p.us) AS last_us,
    min(CASE WHEN (p.entry - p.o) * 1000000 > g.stop_ppm * p.entry THEN us END) AS gapped, max(mae) AS mae, max(mfe) AS mfe FROM p CROSS JOIN ({cells}) g GROUP BY 1, 2, 3, 4, 5, 6, 7),
o AS (SELECT *, CASE WHEN stopped IS NOT NULL AND (reached IS NULL OR stopped <= reached) THEN 'stop' WHEN reached IS NOT NULL THEN 'target' ELSE 'time' END AS kind, CASE WHEN reached IS NOT NULL AND (stopped IS NULL OR reached <= stopped) THEN 'target' WHEN stopped IS NOT NULL THEN 'stop' ELSE 'time' END AS hopeful, coalesce(stopped = reached, false) AS ambiguous FROM x),
w AS (SELECT *, {outcome('kind')} AS pnl, {outcome('hopeful')} AS best_pnl, {d.tdiv(f"CASE kind WHEN 'stop' THEN stopped WHEN 'target' THEN reached ELSE last_us END - entry_us", str(step))} AS held FROM o)
SELECT condition, stop_ppm, target_ppm, count(*) AS trades, count(CASE WHEN kind = 'stop' THEN 1 END) AS stops, count(CASE WHEN kind = 'target' THEN 1 END) AS targets, count(CASE WHEN kind = 'time' THEN 1 END) AS timed, count(CASE WHEN ambiguous THEN 1 END) AS ambiguous, count(CASE WHEN kind = 'stop' AND gapped = stopped THEN 1 END) AS gaps,
  count(CASE WHEN pnl > 0 THEN 1 END) AS wins, CAST(coalesce(sum(CASE WHEN pnl > 0 THEN pnl END), 0) AS BIGINT) AS gross_win, CAST(coalesce(sum(CASE WHEN pnl < 0 THEN -pnl END), 0) AS BIGINT) AS gross_loss, max(pnl) AS best, min(pnl) AS worst, min(CASE WHEN pnl > 0 THEN pnl END) AS least_win,
  CAST(sum(pnl) AS BIGINT) AS total, CAST(sum(best_pnl) AS BIGINT) AS optimistic, CAST(sum(held) AS BIGINT) AS bars_held, max({d.tdiv('mae', 'entry')}) AS worst_mae, max(CASE WHEN pnl > 0 THEN {d.tdiv('mae', 'entry')} END) AS worst_mae_of_wins, max({d.tdiv('mfe', 'entry')}) AS best_mfe FROM w GROUP BY condition, stop_ppm, target_ppm"""


def priced(d: Dialect, family: str, chosen: list[str]) -> str:
    return f"SELECT condition, series, signal_us, entry_us, exit_us, entry, exit - entry AS pnl, {day_of(d, 'exit_us')} AS day FROM ({signals(d, family, chosen)}) s WHERE exit_us IS NOT NULL AND entry_us IS NOT NULL"


def drawdown(d: Dialect, family: str, chosen: list[str]) -> str:
    """Total, worst trade and largest fall of the equity from its peak, which starts at zero.

    Trades end on their day, so equity is summed within days first, and days are strung together by their sums, ends and
    falls: no window runs over all trades of a condition.
    """
    within = "(PARTITION BY condition, day ORDER BY exit_us, series, signal_us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    before = "(PARTITION BY condition ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""WITH k AS (SELECT *, max(equity) OVER {within} AS peak FROM (SELECT *, sum(pnl) OVER {within} AS equity FROM ({priced(d, family, chosen)}) p) e),
t AS (SELECT condition, day, count(*) AS trades, sum(pnl) AS net, min(pnl) AS worst, max(equity) AS top, min(equity) AS low, max(peak - equity) AS fell FROM k GROUP BY condition, day),
s AS (SELECT *, coalesce(sum(net) OVER {before}, 0) AS start FROM t),
g AS (SELECT *, greatest(coalesce(max(start + top) OVER {before}, 0), 0) AS high FROM s)
SELECT condition, CAST(sum(trades) AS BIGINT) AS trades, CAST(sum(net) AS BIGINT) AS total, min(worst) AS worst, CAST(max(greatest(fell, high - start - low)) AS BIGINT) AS drawdown FROM g GROUP BY condition"""


def drawdown_sql(d: Dialect, family: str, chosen: list[str]) -> str:
    """The same by one window over all trades of a condition, for comparison."""
    run_ = "(PARTITION BY condition ORDER BY exit_us, series, signal_us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""SELECT condition, count(*) AS trades, CAST(max(equity_end) AS BIGINT) AS total, min(pnl) AS worst, CAST(max(peak - equity) AS BIGINT) AS drawdown FROM (
  SELECT *, greatest(max(equity) OVER {run_}, 0) AS peak, sum(pnl) OVER (PARTITION BY condition) AS equity_end FROM (SELECT *, sum(pnl) OVER {run_} AS equity FROM ({priced(d, family, chosen)}) p) e) x GROUP BY condition"""


def streaks(d: Dialect, family: str, chosen: list[str]) -> str:
    """Longest and average runs of wins and of the rest; only a gain is a win.

    A run's number is how often a win has followed a loss or a loss a win: counted within days, and strung together over
    days by each day's last trade, so no window runs over all trades of a condition.
    """
    order = "ORDER BY exit_us, series, signal_us"
    within = f"(PARTITION BY condition, day {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""WITH p AS (SELECT *, pnl > 0 AS win FROM ({priced(d, family, chosen)}) q),
l AS (SELECT *, lag(win) OVER (PARTITION BY condition, day {order}) AS was FROM p),
e AS (SELECT condition, day, {d.last('win', 'exit_us', 'series', 'signal_us')} AS ended FROM p GROUP BY condition, day),
y AS (SELECT condition, day, lag(ended) OVER (PARTITION BY condition ORDER BY day) AS prior FROM e),
f AS (SELECT l.*, CASE WHEN coalesce(l.was, y.prior) = l.win THEN 0 ELSE 1 END AS turn FROM l JOIN y ON l.condition = y.condition AND l.day = y.day),
t AS (SELECT condition, day, sum(turn) AS turns FROM f GROUP BY condition, day),
o AS (SELECT condition, day, coalesce(sum(turns) OVER (PARTITION BY condition ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM t),
n AS (SELECT f.condition, f.day, f.win, sum(f.turn) OVER {within} AS upto FROM f),
r AS (SELECT n.condition, n.win, o.start + n.upto AS run, count(*) AS n FROM n JOIN o ON n.condition = o.condition AND n.day = o.day GROUP BY 1, 2, 3)
SELECT condition, win, max(n) AS longest, count(*) AS runs, {d.tdiv('CAST(sum(n) AS BIGINT) * 1000', 'count(*)')} AS average_milli FROM r GROUP BY condition, win"""


def streaks_sql(d: Dialect, family: str, chosen: list[str]) -> str:
    """The same by islands over all trades of a condition, for comparison."""
    order = "ORDER BY exit_us, series, signal_us"
    return f"""WITH p AS (SELECT *, pnl > 0 AS win FROM ({priced(d, family, chosen)}) q),
g AS (SELECT *, row_number() OVER (PARTITION BY condition {order}) - row_number() OVER (PARTITION BY condition, win {order}) AS island FROM p),
r AS (SELECT condition, win, island, count(*) AS n FROM g GROUP BY condition, win, island)
SELECT condition, win, max(n) AS longest, count(*) AS runs, {d.tdiv('CAST(sum(n) AS BIGINT) * 1000', 'count(*)')} AS average_milli FROM (SELECT condition, win, n FROM r) s GROUP BY condition, win"""


def grains(d: Dialect, us: str) -> dict[str, str]:
    """Keys of the calendar grains in India that a time falls in: rolling ones (months since year 0 and their multiples,
    weeks from Monday, days, clock hours), and those that come again (weekday, hour of the day)."""
    day = day_of(d, us)
    date = d.date_of(day)
    months = f"(year({date}) * 12 + month({date}) - 1)"
    rolling = {"year": d.tdiv(months, "12"), "half": d.tdiv(months, "6"), "quarter": d.tdiv(months, "3"), "month": months, "week": d.fdiv(f"{day} + 3", "7"), "day": day, "hour": d.fdiv(f"{us} + {IST}", "3600000000")}
    return rolling | {"weekday": d.pmod(f"{day} + 3", "7"), "hour_of_day": d.fdiv(d.pmod(f"{us} + {IST}", str(DAY)), "3600000000")}


def periods(d: Dialect, family: str, chosen: list[str], which: tuple[str, ...]) -> str:
    """Trades, wins, net, worst trade, and how far any trade ran against its entry (paisa and parts per million), by the
    calendar grain that the trade opened in. Periods without trades are absent."""
    v = squared(d, 60)
    against = f"""SELECT p.condition, p.series, p.signal_us, p.entry_us, p.pnl, p.entry, p.entry - min(b.l) AS against FROM ({priced(d, family, chosen)}) p JOIN ({v}) b ON b.series = p.series AND b.us >= p.entry_us AND b.us <= p.exit_us
  GROUP BY p.condition, p.series, p.signal_us, p.entry_us, p.pnl, p.entry"""
    each = grains(d, "entry_us")
    keyed = ", ".join(f"CAST({each[g]} AS BIGINT) AS g_{g}" for g in which)
    parts = " UNION ALL ".join(f"SELECT condition, '{g}' AS grain, g_{g} AS bucket, count(*) AS trades, count(CASE WHEN pnl > 0 THEN 1 END) AS wins, CAST(sum(pnl) AS BIGINT) AS net, min(pnl) AS worst, max(against) AS worst_against, max({d.tdiv('against * 1000000', 'entry')}) AS worst_against_ppm FROM k GROUP BY condition, g_{g}" for g in which)
    return f"WITH k AS (SELECT condition, pnl, entry, against, {keyed} FROM ({against}) a) {parts}"


def stability(d: Dialect, family: str, chosen: list[str]) -> str:
    """periods by the rolling grains, from the year to the clock hour."""
    return periods(d, family, chosen, ("year", "half", "quarter", "month", "week", "day", "hour"))


def trade_periods(d: Dialect, family: str, chosen: list[str]) -> str:
    """periods by the eight grains of a trade report, with weekday and hour of the day."""
    return periods(d, family, chosen, ("year", "half", "quarter", "month", "week", "day", "weekday", "hour_of_day"))


def totals(d: Dialect, family: str, chosen: list[str]) -> str:
    """Each condition's trades with gross sums, worst trade and drawdown: what the composite weighs."""
    return f"""SELECT s.condition, s.trades, s.wins, s.losses, s.gross_win, s.gross_loss, s.worst, w.drawdown FROM (
  SELECT condition, count(*) AS trades, count(CASE WHEN pnl > 0 THEN 1 END) AS wins, count(CASE WHEN pnl < 0 THEN 1 END) AS losses, CAST(coalesce(sum(CASE WHEN pnl > 0 THEN pnl END), 0) AS BIGINT) AS gross_win,
    CAST(coalesce(sum(CASE WHEN pnl < 0 THEN -pnl END), 0) AS BIGINT) AS gross_loss, min(pnl) AS worst FROM ({priced(d, family, chosen)}) p GROUP BY condition) s JOIN ({drawdown(d, family, chosen)}) w ON s.condition = w.condition"""


def pooled(d: Dialect, family: str, chosen: list[str]) -> str:
    """Across series: sums add, the worst is the least, win rates are pooled, and the drawdown is the greatest of any
    series: a bound on what one position at a time over all of them could fall."""
    run_ = "(PARTITION BY condition, series ORDER BY exit_us, signal_us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""SELECT condition, count(*) AS series, CAST(sum(trades) AS BIGINT) AS trades, CAST(sum(wins) AS BIGINT) AS wins, CAST(sum(net) AS BIGINT) AS net, min(worst) AS worst, count(CASE WHEN net > 0 THEN 1 END) AS positive, CAST(max(fell) AS BIGINT) AS drawdown,
  {d.tdiv('CAST(sum(wins) AS BIGINT) * 10000', 'CAST(sum(trades) AS BIGINT)')} AS win_bp FROM (
  SELECT condition, series, count(*) AS trades, count(CASE WHEN pnl > 0 THEN 1 END) AS wins, sum(pnl) AS net, min(pnl) AS worst, max(peak - equity) AS fell FROM (
    SELECT *, greatest(max(equity) OVER {run_}, 0) AS peak FROM (SELECT *, sum(pnl) OVER {run_} AS equity FROM ({priced(d, family, chosen)}) p) e) x GROUP BY condition, series) s GROUP BY condition"""


#: Fixed values of the consistency versions: ratio of winning days (of decided days, or of all), least winning days and
#: most losing days of a complete week, longest run of losing days.
VERSIONS = {"v1": (3, 5, False, 3, 2, 2), "v2": (3, 5, False, 3, 2, 2), "v3": (1, 3, False, 1, 4, 10), "v4": (1, 4, True, 0, 5, 1_000_000)}


def consistency(d: Dialect, family: str, chosen: list[str]) -> str:
    """Winning, losing and flat days, the longest run of losing days (flat days keep it), the worst complete week from
    Monday to Friday, and whether each version's limits are met."""
    week = d.fdiv("day + 3", "7")
    rules = ", ".join(
        f"(won * {b} >= {'(won + lost)' if decided else '(won + lost + flat)'} * {a} AND coalesce(losing_run, 0) <= {run_} AND coalesce(least_won, {wins}) >= {wins} AND coalesce(most_lost, 0) <= {losses}) AS {v}"
        for v, (a, b, decided, wins, losses, run_) in VERSIONS.items()
    )
    return f"""WITH t AS (SELECT condition, day, CAST(sum(pnl) AS BIGINT) AS net FROM ({priced(d, family, chosen)}) p GROUP BY condition, day),
f AS (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY day) - row_number() OVER (PARTITION BY condition, net < 0 ORDER BY day) AS island FROM t WHERE net <> 0),
l AS (SELECT condition, max(n) AS losing_run FROM (SELECT condition, island, count(*) AS n FROM f WHERE net < 0 GROUP BY condition, island) r GROUP BY condition),
w AS (SELECT condition, min(won) AS least_won, max(lost) AS most_lost FROM (SELECT condition, {week} AS week, count(CASE WHEN net > 0 THEN 1 END) AS won, count(CASE WHEN net < 0 THEN 1 END) AS lost FROM t WHERE {d.pmod('day + 3', '7')} < 5 GROUP BY condition, {week} HAVING count(*) = 5) x GROUP BY condition),
s AS (SELECT condition, count(CASE WHEN net > 0 THEN 1 END) AS won, count(CASE WHEN net < 0 THEN 1 END) AS lost, count(CASE WHEN net = 0 THEN 1 END) AS flat FROM t GROUP BY condition)
SELECT s.condition, won, lost, flat, coalesce(losing_run, 0) AS losing_run, least_won, most_lost, {rules} FROM s LEFT JOIN l ON s.condition = l.condition LEFT JOIN w ON s.condition = w.condition"""

"""Forward outcomes of bars and the edge of conditions over them: returns, excursions, overlap-corrected t, rankings."""

from __future__ import annotations

from candlewright.functions.normal import log10_two_sided, two_sided
from candlewright.operators import conditions
from candlewright.plans.dialect import DUCK, Dialect
from candlewright.sources.bars import CLOSING, MINUTE, exit_of, squared, valid


def forward(d: Dialect, minutes: int = 60, horizon: int = 2) -> str:
    """series, us, entry, ret, adverse, favourable, refused of each bar's close held for `horizon` bars.

    The exit is the bar at exactly us + horizon bars, or the square-off where that comes first and has a price. A bar that
    ends after the square-off opens nothing, and a position without a priced end has no outcome; neither is refused. An
    outcome is refused where the exit bar or any bar on the way to it is missing.
    """
    step = minutes * MINUTE
    held = lambda x: f"CASE WHEN a.fillable AND a.path = a.steps AND b.us IS NOT NULL THEN {x} END"
    return f"""SELECT a.series, a.us, a.c AS entry, {held('b.c - a.c')} AS ret, {held('a.c - a.worst')} AS adverse, {held('a.best - a.c')} AS favourable,
  coalesce(a.fillable AND a.steps > 0 AND (a.path <> a.steps OR b.us IS NULL), false) AS refused
FROM (SELECT *, {d.tdiv('exit_us - us', str(step))} AS steps FROM (
  SELECT *, CASE WHEN {exit_of('us', horizon * step)} > us THEN {exit_of('us', horizon * step)} END AS exit_us, min(CASE WHEN fillable THEN l END) OVER ahead AS worst, max(CASE WHEN fillable THEN h END) OVER ahead AS best, count(CASE WHEN fillable THEN 1 END) OVER ahead AS path
  FROM ({squared(d, minutes)}) v WINDOW ahead AS (PARTITION BY series, day ORDER BY us RANGE BETWEEN 1 FOLLOWING AND {horizon * step} FOLLOWING)) w) a
LEFT JOIN ({valid(d, minutes)}) b ON a.series = b.series AND a.day = b.day AND b.us = a.exit_us"""


def forward_sql(minutes: int = 60, horizon: int = 2) -> str:
    """The same by joins on each bar's whole path, with no window, for comparison."""
    step, d = minutes * MINUTE, DUCK
    real = f"count(CASE WHEN minute = {CLOSING - 1} THEN 1 END) = 1" if minutes == 1 else "false"
    return f"""WITH v AS ({valid(d, minutes)}), s AS (SELECT series, day, max(us) FILTER (minute + {minutes} <= {CLOSING}) AS top, {real} AS priced FROM v GROUP BY series, day),
e AS (SELECT v.*, CASE WHEN v.minute + {minutes} > {CLOSING} THEN NULL WHEN v.us + {horizon * step} <= s.top THEN v.us + {horizon * step} WHEN s.priced AND s.top > v.us THEN s.top END AS until FROM v JOIN s ON v.series = s.series AND v.day = s.day),
p AS (SELECT e.series, e.us, e.c, e.until, count(b.us) AS met, max(b.h) AS best, min(b.l) AS worst, max(b.c) FILTER (b.us = e.until) AS out FROM e LEFT JOIN v b ON b.series = e.series AND b.day = e.day AND b.us > e.us AND b.us <= e.until GROUP BY ALL),
o AS (SELECT *, until IS NOT NULL AND out IS NOT NULL AND met * {step} = until - us AS good FROM p)
SELECT series, us, c AS entry, CASE WHEN good THEN out - c END AS ret, CASE WHEN good THEN c - worst END AS adverse, CASE WHEN good THEN best - c END AS favourable, until IS NOT NULL AND NOT good AS refused FROM o"""


#: When a run has warmed up: five sessions are complete and the slowest average has two hundred bars behind it.
WARM = "session > 5 AND bar_id > 200"


def hits(d: Dialect, family: str, chosen: list[str], minutes: int = 60, warm: str = WARM) -> str:
    """condition, series, us of each bar where a condition is true, once the run has warmed up: the long form."""
    rows = ", ".join(f"CASE WHEN {n} THEN '{n}' END" for n in chosen)
    text = f"SELECT series, us, day, {rows_as_list(d, rows)} AS names FROM ({conditions.wide(d, family, minutes)}) w WHERE {warm}"
    each = "explode(names)" if d.spark else "unnest(names)"
    return f"SELECT * FROM (SELECT series, us, {each} AS condition FROM ({text}) t) u WHERE condition IS NOT NULL"


def rows_as_list(d: Dialect, rows: str) -> str:
    return f"array({rows})" if d.spark else f"[{rows}]"


def edges(d: Dialect, family: str, chosen: list[str], minutes: int = 60, horizon: int = 2, warm: str = WARM) -> str:
    """edges_of the bars where each condition is true."""
    return edges_of(d, hits(d, family, chosen, minutes, warm), minutes, horizon)


def edges_of(d: Dialect, hit_rows: str, minutes: int = 60, horizon: int = 2) -> str:
    """For each condition: outcomes, wins, losses, sums, extremes, mean, and t corrected for overlapping horizons.

    Two hits closer than the horizon share part of their paths; their products enter the variance with weight
    1 - distance / horizon. Bars lie on a grid, so each distance is an equality join.
    """
    step = minutes * MINUTE
    hit = f"SELECT h.condition, h.series, h.us, f.ret, f.adverse, f.favourable FROM ({hit_rows}) h JOIN ({forward(d, minutes, horizon)}) f ON h.series = f.series AND h.us = f.us WHERE f.ret IS NOT NULL"
    pairs = " UNION ALL ".join(f"SELECT x.condition, {1 - k / horizon!r}E0 AS weight, CAST(x.ret AS DOUBLE) AS a, CAST(y.ret AS DOUBLE) AS b FROM o x JOIN o y ON x.condition = y.condition AND x.series = y.series AND y.us = x.us + {k * step}" for k in range(1, horizon))
    pairs = pairs or "SELECT condition, 0.0E0 AS weight, 0.0E0 AS a, 0.0E0 AS b FROM o"
    return f"""WITH o AS ({hit}),
s AS (SELECT condition, count(*) AS n, CAST(sum(ret) AS BIGINT) AS total, count(CASE WHEN ret > 0 THEN 1 END) AS wins, count(CASE WHEN ret < 0 THEN 1 END) AS losses, CAST(coalesce(sum(CASE WHEN ret > 0 THEN ret END), 0) AS BIGINT) AS gross_win,
  CAST(coalesce(sum(CASE WHEN ret < 0 THEN -ret END), 0) AS BIGINT) AS gross_loss, max(ret) AS best, min(ret) AS worst, max(adverse) AS worst_adverse, CAST(sum(favourable) AS BIGINT) AS favourable, CAST(sum(CAST(ret AS DOUBLE) * ret) AS DOUBLE) AS squares FROM o GROUP BY condition),
p AS (SELECT condition, sum(weight * a * b) AS xp, sum(weight * (a + b)) AS lin, sum(weight) AS w FROM ({pairs}) q GROUP BY condition),
m AS (SELECT s.*, CAST(total AS DOUBLE) / n AS mean, coalesce(xp, 0) AS xp, coalesce(lin, 0) AS lin, coalesce(w, 0) AS w FROM s LEFT JOIN p ON s.condition = p.condition)
SELECT condition, n, total, wins, losses, gross_win, gross_loss, best, worst, worst_adverse, favourable, round(mean, 6) AS mean,
  round(CASE WHEN n > 1 AND squares - n * mean * mean + 2 * (xp - mean * lin + mean * mean * w) > 1e-9 THEN mean / sqrt((squares - n * mean * mean + 2 * (xp - mean * lin + mean * mean * w)) / (n - 1) / n) END, 6) AS t FROM m"""


def lenses(d: Dialect, edge: str, top: int = 5) -> str:
    """The best conditions by each lens; ties by name, undefined values last."""
    value = {"detectability": "abs(t)", "payoff": "CASE WHEN losses > 0 AND gross_loss > 0 AND wins > 0 THEN (CAST(gross_win AS DOUBLE) / wins) / (CAST(gross_loss AS DOUBLE) / losses) END", "path": "CASE WHEN worst_adverse > 0 THEN mean / worst_adverse END", "asymmetry": "CASE WHEN worst < 0 THEN CAST(best AS DOUBLE) / -worst END"}
    parts = " UNION ALL ".join(f"SELECT '{k}' AS lens, condition, round({v}, 6) AS score FROM e" for k, v in value.items())
    return f"WITH e AS ({edge}), r AS (SELECT *, row_number() OVER (PARTITION BY lens ORDER BY score IS NULL, score DESC, condition) AS place FROM ({parts}) x) SELECT lens, CAST(place AS INT) AS place, condition, score FROM r WHERE place <= {top}"


#: Criteria of the composite, lower first where less is better: their raw values over a trade summary with drawdown.
#: Ratios are in parts per million; an undefined one is null.
LOWER = {
    "drawdown": "drawdown", "worst_loss": "greatest(-worst, 0)", "losing_rate": "{rate}(losses, trades)", "losing_trades": "losses", "loss_ratio": "{rate}(gross_loss, gross_win)", "average_loss": "{part}(gross_loss, losses)",
}
HIGHER = {"profit": "gross_win - gross_loss", "winning_trades": "wins", "win_rate": "{rate}(wins, trades)", "reward_to_risk": "{rate}(gross_win * losses, gross_loss * wins)", "average_win": "{part}(gross_win, wins)"}


def composite(d: Dialect, totals: str, weights: dict[str, int] | None = None, top: int = 25) -> str:
    """Weighted composite of eleven criteria: each scaled to a million between its least and its greatest, from the better
    end, undefined or constant as half, averaged by whole-number weights (all one unless given).

    totals: condition, trades, wins, losses, gross_win, gross_loss, worst, drawdown. The extremes are one row, which the
    rows are joined to by a constant: no window runs over all conditions.
    """
    import re

    every = LOWER | HIGHER

    def value(text: str) -> str:
        text = re.sub(r"\{rate\}\(([^,]+), ([^)]+)\)", lambda m: f"(CASE WHEN {m[2]} > 0 THEN {d.tdiv(f'{m[1]} * 1000000', m[2])} END)", text)
        return re.sub(r"\{part\}\(([^,]+), ([^)]+)\)", lambda m: f"(CASE WHEN {m[2]} > 0 THEN {d.tdiv(m[1], m[2])} END)", text)

    raw = ", ".join(f"CAST({value(e)} AS BIGINT) AS k_{c}" for c, e in every.items())
    ends = ", ".join(f"min(k_{c}) AS lo_{c}, max(k_{c}) AS hi_{c}" for c in every)
    from_ = lambda c: f"hi_{c} - k_{c}" if c in LOWER else f"k_{c} - lo_{c}"
    ppm = {c: f"(CASE WHEN k_{c} IS NULL OR hi_{c} = lo_{c} THEN 500000 ELSE {d.tdiv(f'CAST({from_(c)} AS BIGINT) * 1000000', f'(hi_{c} - lo_{c})')} END)" for c in every}
    weigh = {c: 1 if weights is None else weights.get(c, 0) for c in every}
    if not sum(weigh.values()):
        raise ValueError("at least one criterion must have a weight")
    total = " + ".join(f"{weigh[c]} * {ppm[c]}" for c in every)
    missing = " + ".join(f"CASE WHEN k_{c} IS NULL THEN 1 ELSE 0 END" for c in every)
    return f"""WITH m AS (SELECT condition, {raw} FROM ({totals}) t), x AS (SELECT {ends} FROM m)
SELECT condition, {d.tdiv(f'({total})', str(sum(weigh.values())))} AS score, {missing} AS unmeasured FROM m JOIN x ON 1 = 1 ORDER BY score DESC, condition LIMIT {top}"""


def significance(d: Dialect, edge: str) -> str:
    """Two-sided p and its logarithm, Bonferroni and Benjamini-Hochberg at 5 %, Wilson's lower bound of the win rate, and
    a bound on the expected greatest t of that many trials.

    The tail keeps its digits however small it is (normal.erfc). The conditions' number is one row, and ranks are counted
    over p alone.
    """
    z = "1.959963984540054E0"
    wilson = f"((wins * 1.0E0 / n + {z} * {z} / (2 * n) - {z} * sqrt(wins * 1.0E0 / n * (1 - wins * 1.0E0 / n) / n + {z} * {z} / (4.0E0 * n * n))) / (1 + {z} * {z} / n))"
    return f"""WITH e AS (SELECT *, {two_sided('t')} AS p, {log10_two_sided('t')} AS log10_p FROM ({edge}) x WHERE t IS NOT NULL), c AS (SELECT count(*) AS m FROM e),
k AS (SELECT p, sum(here) OVER (ORDER BY p) AS place FROM (SELECT p, count(*) AS here FROM e GROUP BY p) u), b AS (SELECT coalesce(max(CASE WHEN p <= 0.05E0 * place / m THEN p END), -1.0E0) AS cut FROM k JOIN c ON 1 = 1)
SELECT condition, round(p, 5) AS p, round(log10_p, 4) AS log10_p, (p * m <= 0.05E0) AS bonferroni, (p <= cut) AS bh, CAST(floor({wilson} * 1000000) AS BIGINT) AS wilson_ppm, round(sqrt(2 * ln(CAST(m AS DOUBLE))), 5) AS expected_max FROM e JOIN c ON 1 = 1 JOIN b ON 1 = 1"""


def excursion_ladder(d: Dialect, family: str, chosen: list[str], rungs: int = 6) -> str:
    """Rungs of each condition's favourable excursions: the sorted value at (n - 1) / 2^(rungs - i + 1), positive and
    distinct. Values are counted first, and counts summed over a condition's distinct values alone."""
    at = lambda i: d.tdiv("n - 1", str(1 << (rungs - i + 1)))
    picks = " UNION ALL ".join(f"SELECT condition, favourable AS level FROM s WHERE upto > {at(i)} AND upto - here <= {at(i)}" for i in range(1, rungs + 1))
    return f"""WITH v AS (SELECT h.condition, f.favourable, count(*) AS here FROM ({hits(d, family, chosen)}) h JOIN ({forward(d)}) f ON h.series = f.series AND h.us = f.us WHERE f.favourable IS NOT NULL GROUP BY h.condition, f.favourable),
s AS (SELECT *, sum(here) OVER (PARTITION BY condition ORDER BY favourable) AS upto, sum(here) OVER (PARTITION BY condition) AS n FROM v)
SELECT DISTINCT condition, level FROM ({picks}) p WHERE level > 0"""


def excursion_sql(family: str, chosen: list[str], rungs: int = 6) -> str:
    """The same by sorted lists, for comparison."""
    d = DUCK
    picks = ", ".join(f"xs[(len(xs) - 1) // {1 << (rungs - i + 1)} + 1]" for i in range(1, rungs + 1))
    return f"""SELECT DISTINCT condition, unnest(list_filter([{picks}], lambda x: x > 0)) AS level FROM (SELECT h.condition, list(f.favourable ORDER BY f.favourable) AS xs FROM ({hits(d, family, chosen)}) h JOIN ({forward(d)}) f ON h.series = f.series AND h.us = f.us WHERE f.favourable IS NOT NULL GROUP BY h.condition) l"""

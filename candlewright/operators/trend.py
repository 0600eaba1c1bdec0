"""Recursive indicators: moving averages, true range, SuperTrend, swings and structure, as ordered folds per series.

Whole-number recurrences with floors have no closed form, so each series is folded in order by applyInPandas. State is
read before the bar is folded in.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from candlewright.plans.dialect import DUCK, SPARK, Dialect, run
from candlewright.sources.bars import valid

SCALE = 1_000_000
SCHEMA = "series string, us long, day long, rn int, c long, ema20 long, ema200 long, stop long, trend int, structure int, broke int, changed boolean, swing_high long, swing_low long, high_span long, low_span long"


class Average:
    """Exponential moving average scaled by a million: seeded by the first price, floored at each step."""

    def __init__(self, n: int):
        self.n, self.value, self.folded = n, None, 0

    def warm(self) -> int | None:
        return self.value if self.folded >= self.n else None

    def fold(self, price: int) -> None:
        self.value = price * SCALE if self.value is None else self.value + (price * SCALE - self.value) * 2 // (self.n + 1)
        self.folded += 1


class SuperTrend:
    """One trailing stop, three average true ranges (Wilder, 10) from the middle, in whole prices.

    The first bar starts it, above or below by its close against the middle. While a trend holds the stop only moves with
    it; a close beyond the stop turns the trend and takes the other side's fresh band.
    """

    def __init__(self, n: int = 10, times: int = 3):
        self.n, self.times, self.folded = n, times, 0
        self.atr = self.level = self.close = None
        self.up = True

    def stop(self) -> int | None:
        return None if self.folded < self.n else self.level

    def fold(self, h: int, lo: int, c: int) -> None:
        if self.atr is None:
            self.atr = (h - lo) * SCALE
        else:
            true = max(h - lo, abs(h - self.close), abs(lo - self.close)) * SCALE
            self.atr += (true - self.atr) // self.n
        middle, band = (h + lo) // 2, self.times * (self.atr // SCALE)
        if self.level is None:
            self.up = c >= middle
            self.level = middle - band if self.up else middle + band
        elif (c < self.level) if self.up else (c > self.level):
            self.up = not self.up
            self.level = middle - band if self.up else middle + band
        else:
            self.level = max(self.level, middle - band) if self.up else min(self.level, middle + band)
        self.close = c
        self.folded += 1


class Structure:
    """Strict five-bar swings, confirmed two bars later, and breaks of the last ones by a close."""

    def __init__(self):
        self.bars: list[tuple[int, int]] = []
        self.high = self.low = self.high_span = self.low_span = None
        self.high_at = self.low_at = -1
        self.direction, self.seen = 0, 0

    def broke(self, c: int) -> int:
        up, down = self.high is not None and c > self.high, self.low is not None and c < self.low
        if up and down:
            return (self.high_at > self.low_at) - (self.high_at < self.low_at)
        return int(up) - int(down)

    def fold(self, h: int, lo: int, c: int) -> None:
        self.direction = self.broke(c) or self.direction
        self.bars = [*self.bars[-4:], (h, lo)]
        self.seen += 1
        if len(self.bars) == 5:
            highs, lows = zip(*self.bars, strict=True)
            span = max(highs) - min(lows)
            if all(highs[2] > x for i, x in enumerate(highs) if i != 2):
                self.high, self.high_span, self.high_at = highs[2], span, self.seen - 3
            if all(lows[2] < x for i, x in enumerate(lows) if i != 2):
                self.low, self.low_span, self.low_at = lows[2], span, self.seen - 3


def fold(bars: pd.DataFrame) -> pd.DataFrame:
    """States of one series at each bar, in order of time."""
    fast, slow, trend, form = Average(20), Average(200), SuperTrend(), Structure()
    out = []
    for series, us, day, rn, h, lo, c in bars.sort_values("us")[["series", "us", "day", "rn", "h", "l", "c"]].itertuples(index=False):
        broke = form.broke(int(c))
        out.append((series, us, day, rn, c, fast.warm(), slow.warm(), trend.stop(), int(trend.up) * 2 - 1, form.direction, broke, bool(broke) and form.direction == -broke, form.high, form.low, form.high_span, form.low_span))
        fast.fold(int(c))
        slow.fold(int(c))
        trend.fold(int(h), int(lo), int(c))
        form.fold(int(h), int(lo), int(c))
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    frame = pd.DataFrame(out, columns=names)
    return frame.astype({n: "Int64" for n in ("ema20", "ema200", "stop", "swing_high", "swing_low", "high_span", "low_span")})


def states(spark: SparkSession, sf_dir: str, minutes: int = 60) -> DataFrame:
    """States of all series at each bar."""
    bars = run(spark, sf_dir, f"SELECT *, CAST(row_number() OVER (PARTITION BY series, day ORDER BY us) AS INT) AS rn FROM ({valid(SPARK, minutes)}) v")
    return bars.groupBy("series").applyInPandas(fold, SCHEMA)


def trend_conditions() -> dict[str, str]:
    near = lambda v, w: f"(CASE WHEN {v} IS NOT NULL THEN {w} > 0 AND abs(c - {v}) * 1000 <= 10 * {w} END)"
    sides = {"ema20": f"c * {SCALE} {{}} ema20", "ema200": f"c * {SCALE} {{}} ema200", "supertrend": "c {} stop"}
    out = {f"close_{w}_{n}": f"({e.format(s)})" for n, e in sides.items() for w, s in (("above", ">"), ("below", "<"))}
    out |= {"ema20_above_ema200": "(ema20 > ema200)", "ema20_below_ema200": "(ema20 < ema200)", "bos_bullish": "(broke = 1 AND NOT changed)", "bos_bearish": "(broke = -1 AND NOT changed)", "choch_bullish": "(broke = 1 AND changed)", "choch_bearish": "(broke = -1 AND changed)"}
    return out | {"structure_up_in_force": "(structure = 1)", "structure_down_in_force": "(structure = -1)", "near_swing_high": near("swing_high", "high_span"), "near_swing_low": near("swing_low", "low_span")}


TREND_SIDES = {n: (f"c * {k} > {x}", f"c * {k} < {x}") for n, x, k in (("ema20", "ema20", SCALE), ("ema200", "ema200", SCALE), ("supertrend", "stop", 1))}


def ema_sql(d: Dialect, n: int = 20, minutes: int = 60) -> str:
    """The moving average by a recursive query, for comparison."""
    step = d.fdiv(f"(c.c * {SCALE} - r.ema) * 2", str(n + 1))
    return f"""WITH RECURSIVE n AS (SELECT series, us, c, row_number() OVER (PARTITION BY series ORDER BY us) AS i FROM ({valid(d, minutes)}) v),
r AS (SELECT series, i, c * CAST({SCALE} AS BIGINT) AS ema FROM n WHERE i = 1 UNION ALL SELECT c.series, c.i, r.ema + {step} AS ema FROM r JOIN n c ON c.series = r.series AND c.i = r.i + 1)
SELECT n.series, n.us, CASE WHEN n.i > {n} THEN r.ema END AS ema FROM n LEFT JOIN r ON n.series = r.series AND n.i = r.i + 1"""


def states_sql(minutes: int = 60) -> str:
    """The states at each bar in the comparison engine's SQL, for comparison: averages, range and stop by recursion, swings
    and breaks by windows, with no fold."""
    d = DUCK
    step = lambda n: d.fdiv(f"(n.c * {SCALE} - r.e{n}) * 2", str(n + 1))
    true = "greatest(n.h - n.l, abs(n.h - r.c), abs(n.l - r.c))"
    atr = f"(r.atr + {d.fdiv(f'{true} * {SCALE} - r.atr', '10')})"
    band, middle = f"(3 * {d.fdiv(atr, str(SCALE))})", "((n.h + n.l) // 2)"
    turn = "CASE WHEN r.up THEN n.c < r.stop ELSE n.c > r.stop END"
    stop = f"CASE WHEN r.up <> ({turn}) THEN CASE WHEN {turn} THEN {middle} - {band} ELSE greatest(r.stop, {middle} - {band}) END ELSE CASE WHEN {turn} THEN {middle} + {band} ELSE least(r.stop, {middle} + {band}) END END"
    around = "max(h) OVER five - min(l) OVER five"
    peak = lambda x, op: " AND ".join(f"{x}2 {op} {y}" for y in (f"{x}1", f"{x}3", f"{x}4", x))
    lags = ", ".join(f"lag({x}, {k}) OVER s AS {x}{k}" for x in "hl" for k in range(1, 5))
    latch = lambda x: f"last_value({x} IGNORE NULLS) OVER before"
    return f"""WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY us) AS i, CAST(row_number() OVER (PARTITION BY series, day ORDER BY us) AS INTEGER) AS rn FROM ({valid(d, minutes)}) v),
r AS (SELECT series, i, c, c * CAST({SCALE} AS BIGINT) AS e20, c * CAST({SCALE} AS BIGINT) AS e200, (h - l) * CAST({SCALE} AS BIGINT) AS atr, c >= (h + l) // 2 AS up,
    CASE WHEN c >= (h + l) // 2 THEN (h + l) // 2 - 3 * (h - l) ELSE (h + l) // 2 + 3 * (h - l) END AS stop FROM n WHERE i = 1
  UNION ALL SELECT n.series, n.i, n.c, r.e20 + {step(20)}, r.e200 + {step(200)}, {atr}, r.up <> ({turn}), {stop.replace('r.up <> (' + turn + ')', '(r.up <> (' + turn + '))')} FROM r JOIN n ON n.series = r.series AND n.i = r.i + 1),
w AS (SELECT *, {lags}, {around} AS span FROM n WINDOW s AS (PARTITION BY series ORDER BY us), five AS (PARTITION BY series ORDER BY us ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
f AS (SELECT *, CASE WHEN i >= 5 AND {peak('h', '>')} THEN i END AS top, CASE WHEN i >= 5 AND {peak('l', '<')} THEN i END AS bottom FROM w),
g AS (SELECT *, {latch('CASE WHEN top IS NOT NULL THEN h2 END')} AS swing_high, {latch('CASE WHEN bottom IS NOT NULL THEN l2 END')} AS swing_low, {latch('CASE WHEN top IS NOT NULL THEN span END')} AS high_span,
    {latch('CASE WHEN bottom IS NOT NULL THEN span END')} AS low_span, {latch('top')} AS high_at, {latch('bottom')} AS low_at FROM f WINDOW before AS (PARTITION BY series ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, CASE WHEN c > swing_high AND c < swing_low THEN sign(high_at - low_at) WHEN c > swing_high THEN 1 WHEN c < swing_low THEN -1 ELSE 0 END AS broke FROM g),
k AS (SELECT *, coalesce(last_value(CASE WHEN broke <> 0 THEN broke END IGNORE NULLS) OVER (PARTITION BY series ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS structure FROM b)
SELECT k.series, k.us, k.day, k.rn, k.c, CASE WHEN k.i > 20 THEN r.e20 END AS ema20, CASE WHEN k.i > 200 THEN r.e200 END AS ema200, CASE WHEN k.i > 10 THEN r.stop END AS stop,
  k.structure, k.broke, k.broke <> 0 AND k.structure = -k.broke AS changed, swing_high, swing_low, high_span, low_span FROM k LEFT JOIN r ON r.series = k.series AND r.i = k.i - 1"""

"""The vocabulary of boolean conditions over bars, as nullable predicates over one context row for each bar.

A predicate is NULL where it can't be decided. Windows are per (series, day) or per series over days; the recursive
trend conditions (moving averages, SuperTrend, structure) take their state from operators/trend.py.
"""

from __future__ import annotations

from candlewright.plans.dialect import Dialect
from candlewright.sources.bars import valid

#: Rungs of the ladders in thousandths, the names of rungs and levels.
RUNGS = (236, 382, 500, 618, 786, 1272, 1618, 2000, 2618)
LADDER = (0, 236, 382, 500, 618, 786, 1000, 1272, 1618, 2000, 2618)
RUNG_NAMES = {0: "0", 236: "236", 382: "382", 500: "50", 618: "618", 786: "786", 1000: "100", 1272: "1272", 1618: "1618", 2000: "200", 2618: "2618", 4236: "424"}
LEVELS = ("r1", "r2", "r3", "s1", "s2", "s3", "r4", "s4", "r5", "s5")


def near(value: str, level: str, width: str, milli: int) -> str:
    return f"(CASE WHEN ({width}) IS NULL OR ({level}) IS NULL THEN NULL WHEN ({width}) <= 0 THEN false ELSE abs({value} - ({level})) * 1000 <= {milli} * ({width}) END)"


def context(d: Dialect, minutes: int = 60) -> str:
    """One row for each evaluable bar with all that the predicates read."""
    lags = ", ".join(f"lag({x}, {k}) OVER s AS {x}{k}" for k in range(1, 5) for x in "ohlc")
    first3 = "max(CASE WHEN rn <= 3 THEN h END) OVER p AS high3, min(CASE WHEN rn <= 3 THEN l END) OVER p AS low3"
    orb = ", ".join(f"max(CASE WHEN minute >= 0 AND minute < {w} THEN h END) OVER before AS orh{w}, min(CASE WHEN minute >= 0 AND minute < {w} THEN l END) OVER before AS orl{w}" for w in (5, 15, 30, 60))
    pv, p2v = d.wide("(h + l + c) * v"), f"{d.wide('(h + l + c) * v')} * {d.wide('h + l + c')}"
    pick = lambda f, x: f"max(CASE WHEN {f} = 1 THEN {x} END)"
    return f"""
WITH bar AS ({valid(d, minutes)}),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY series, day ORDER BY us) AS rn, row_number() OVER (PARTITION BY series, day ORDER BY us DESC) AS back,
    row_number() OVER (PARTITION BY series ORDER BY us) AS bar_id FROM bar
),
daily AS (
  SELECT series, day, max(h) AS dh, min(l) AS dl, {pick('rn', 'o')} AS dopen, {pick('back', 'c')} AS dc, max(CASE WHEN back <= 3 THEN h END) AS tail_h, min(CASE WHEN back <= 3 THEN l END) AS tail_l
  FROM numbered GROUP BY series, day
),
prior AS (
  SELECT series, day, lag(dh) OVER w AS pdh, lag(dl) OVER w AS pdl, lag(dc) OVER w AS pc, lag(tail_h) OVER w AS y_high, lag(tail_l) OVER w AS y_low,
    CASE WHEN count(*) OVER five = 5 THEN max(dh) OVER five END AS hi5, CASE WHEN count(*) OVER five = 5 THEN min(dl) OVER five END AS lo5, row_number() OVER w AS session
  FROM daily WINDOW w AS (PARTITION BY series ORDER BY day), five AS (PARTITION BY series ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)
),
pivots AS (
  SELECT *, {d.fdiv('pdh + pdl + pc', '3')} AS pp, {d.fdiv('pdh + pdl', '2')} AS bc, pdh - pdl AS pr FROM prior
),
levels AS (
  SELECT *, 2 * pp - bc AS tc, abs(pp - bc) AS half, 2 * pp - pdl AS r1, pp + pr AS r2, 2 * pp - pdl + pr AS r3, pp + 2 * pr AS r4, 2 * pp - pdl + 2 * pr AS r5,
    2 * pp - pdh AS s1, pp - pr AS s2, 2 * pp - pdh - pr AS s3, pp - 2 * pr AS s4, 2 * pp - pdh - 2 * pr AS s5
  FROM pivots
),
windowed AS (
  SELECT *, {lags}, max(h) OVER run AS rh, min(l) OVER run AS rl, max(h) OVER before AS bh, min(l) OVER before AS bl, first_value(o) OVER s AS day_open, {first3}, {orb},
    sum({pv}) OVER run AS spv, sum({p2v}) OVER run AS sp2v, sum(v) OVER run AS sv, count(CASE WHEN v > 0 THEN 1 END) OVER run AS sn
  FROM numbered
  WINDOW s AS (PARTITION BY series, day ORDER BY us), p AS (PARTITION BY series, day), run AS (PARTITION BY series, day ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    before AS (PARTITION BY series, day ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
legs AS (
  SELECT *, CASE WHEN rn = 1 THEN 0 WHEN h > bh AND l < bl THEN 0 WHEN h > bh THEN 1 WHEN l < bl THEN -1 END AS moved,
    CASE WHEN sv > 0 THEN CAST({d.wdiv('spv', '3 * sv')} AS BIGINT) END AS vwap,
    CASE WHEN sn >= 2 THEN {d.wdiv('sp2v', d.wide('sv'))} - {d.wdiv('spv', d.wide('sv'))} * {d.wdiv('spv', d.wide('sv'))} END AS variance
  FROM windowed
)
SELECT g.series, g.us, g.bar_id, g.day, g.minute, g.o, g.h, g.l, g.c, g.v, g.rn, {', '.join(f'{x}{k}' for k in range(1, 5) for x in 'ohlc')},
  rh, rl, bh, bl, day_open, vwap, CAST({d.wdiv(d.isqrt('(CASE WHEN variance > 0 THEN variance ELSE 0 END)'), '3')} AS BIGINT) AS sigma,
  {d.last_known('moved', 'PARTITION BY g.series, g.day ORDER BY g.us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING')} AS leg,
  {', '.join(f'orh{w}, orl{w}' for w in (5, 15, 30, 60))}, pdh, pdl, pc, hi5, lo5, session, pp, bc, tc, half, r1, r2, r3, r4, r5, s1, s2, s3, s4, s5,
  CASE WHEN rn > 3 AND high3 > y_high AND NOT low3 < y_low THEN y_high WHEN rn > 3 AND low3 < y_low AND NOT high3 > y_high THEN y_low END AS x1,
  CASE WHEN rn > 3 AND high3 > y_high AND NOT low3 < y_low THEN high3 WHEN rn > 3 AND low3 < y_low AND NOT high3 > y_high THEN low3 END AS x2,
  {d.tdiv('pc + day_open', '2')} AS gap_mid
FROM legs g LEFT JOIN levels k ON g.series = k.series AND g.day = k.day
"""


def _shape(k: str) -> dict[str, str]:
    """Body, range and wicks of the bar k back ('' for this one)."""
    o, h, lo, c = (f"{x}{k}" for x in "ohlc")
    top, bottom = f"greatest({o}, {c})", f"least({o}, {c})"
    r, b = f"({h} - {lo})", f"abs({c} - {o})"
    return {
        "o": o, "h": h, "l": lo, "c": c, "top": top, "bot": bottom, "R": r, "B": b, "U": f"({h} - {top})", "L": f"({bottom} - {lo})",
        "bull": f"({c} > {o})", "bear": f"({c} < {o})", "doji": f"({r} > 0 AND {b} * 1000 <= {r} * 100)",
        "small": f"({r} > 0 AND {b} * 1000 <= {r} * 300)", "long": f"({r} > 0 AND {b} * 1000 >= {r} * 700)",
    }


#: Fixed values. Candle patterns: b0 is this bar, b1 to b4 the ones before it in the session; U and L are wicks, B the body, R the range.
#: Each name's predicate is fixed.
PATTERNS = {
    "pat_hammer": "b0.small & b0.L >= 2 * b0.B & b0.U * 1000 <= b0.R * 50",
    "pat_inverted_hammer": "b0.small & b0.U >= 2 * b0.B & b0.L * 1000 <= b0.R * 50",
    "pat_hanging_man": "b0.small & b0.L >= 2 * b0.B & b0.U * 1000 <= b0.R * 50 & b1.bull",
    "pat_shooting_star": "b0.small & b0.U >= 2 * b0.B & b0.L * 1000 <= b0.R * 50 & b1.bull",
    "pat_bullish_engulfing": "b1.bear & b0.bull & b0.o <= b1.c & b0.c >= b1.o",
    "pat_bearish_engulfing": "b1.bull & b0.bear & b0.o >= b1.c & b0.c <= b1.o",
    "pat_bullish_harami": "b1.bear & b0.bull & b0.top <= b1.o & b0.bot >= b1.c",
    "pat_bearish_harami": "b1.bull & b0.bear & b0.top <= b1.c & b0.bot >= b1.o",
    "pat_piercing_line": "b1.bear & b0.bull & b0.o < b1.l & b0.c > b1.mid & b0.c < b1.o",
    "pat_dark_cloud_cover": "b1.bull & b0.bear & b0.o > b1.h & b0.c < b1.mid & b0.c > b1.o",
    "pat_morning_star": "b2.bear & b2.long & b1.small & b0.bull & b0.c > b2.mid",
    "pat_evening_star": "b2.bull & b2.long & b1.small & b0.bear & b0.c < b2.mid",
    "pat_three_white_soldiers": "b2.bull & b1.bull & b0.bull & b1.c > b2.c & b0.c > b1.c",
    "pat_three_black_crows": "b2.bear & b1.bear & b0.bear & b1.c < b2.c & b0.c < b1.c",
    "pat_three_inside_up": "b2.bear & b1.bull & b1.top <= b2.o & b1.bot >= b2.c & b0.bull & b0.c > b2.o",
    "pat_three_inside_down": "b2.bull & b1.bear & b1.top <= b2.c & b1.bot >= b2.o & b0.bear & b0.c < b2.o",
    "pat_tweezer_top": "b0.h = b1.h & b1.bull & b0.bear",
    "pat_tweezer_bottom": "b0.l = b1.l & b1.bear & b0.bull",
    "pat_spinning_top": "b0.small & NOT b0.doji & b0.U * 1000 >= b0.R * 200 & b0.L * 1000 >= b0.R * 200",
    "pat_marubozu_bullish": "b0.long & b0.U * 1000 <= b0.R * 50 & b0.L * 1000 <= b0.R * 50 & b0.bull",
    "pat_marubozu_bearish": "b0.long & b0.U * 1000 <= b0.R * 50 & b0.L * 1000 <= b0.R * 50 & NOT b0.bull",
    "pat_dragonfly_doji": "b0.doji & b0.L >= 2 * b0.B & b0.U * 1000 <= b0.R * 50",
    "pat_gravestone_doji": "b0.doji & b0.U >= 2 * b0.B & b0.L * 1000 <= b0.R * 50",
    "pat_rising_three_methods": "b4.bull & b4.long & b3.bear & b2.bear & b1.bear & b0.bull & b0.c > b4.c",
    "pat_falling_three_methods": "b4.bear & b4.long & b3.bull & b2.bull & b1.bull & b0.bear & b0.c < b4.c",
    "pat_abandoned_baby_bull": "b2.bear & b1.doji & b1.h < b2.l & b0.bull & b0.l > b1.h",
    "pat_abandoned_baby_bear": "b2.bull & b1.doji & b1.l > b2.h & b0.bear & b0.h < b1.l",
    "pat_three_line_strike_bull": "b3.bear & b2.bear & b1.bear & b0.bull & b0.c > b3.o",
    "pat_three_line_strike_bear": "b3.bull & b2.bull & b1.bull & b0.bear & b0.c < b3.o",
    "pat_kicker_bull": "b1.bear & b0.bull & b0.o > b1.o",
    "pat_kicker_bear": "b1.bull & b0.bear & b0.o < b1.o",
    "pat_belt_hold_bull": "b0.long & b0.bull & b0.L * 1000 <= b0.R * 50",
    "pat_belt_hold_bear": "b0.long & b0.bear & b0.U * 1000 <= b0.R * 50",
    "pat_counterattack_bull": "b1.bear & b0.bull & b0.c = b1.c",
    "pat_counterattack_bear": "b1.bull & b0.bear & b0.c = b1.c",
    "pat_separating_lines_bull": "b1.bull & b0.bull & b0.o = b1.o",
    "pat_separating_lines_bear": "b1.bear & b0.bear & b0.o = b1.o",
    "pat_on_neck": "b1.bear & b0.bull & b0.o < b1.l & b0.c = b1.l",
    "pat_in_neck": "b1.bear & b0.bull & b0.o < b1.l & b1.l < b0.c & b0.c <= b1.c",
    "pat_thrusting": "b1.bear & b0.bull & b0.o < b1.l & b1.c < b0.c & b0.c < b1.mid",
    "pat_tasuki_gap_up": "b2.bull & b1.bull & b0.bear & b1.l > b2.h & b0.c < b1.l & b0.c > b2.bot",
    "pat_tasuki_gap_down": "b2.bear & b1.bear & b0.bull & b1.h < b2.l & b0.c > b1.h & b0.c < b2.top",
    "pat_side_by_side_white": "b2.bull & b1.bull & b0.bull & b1.l > b2.h & b0.o = b1.o & b0.B = b1.B",
    "pat_mat_hold": "b4.bull & b4.long & b3.bull & b2.small & b1.small & b0.bull & b0.c > b3.h",
    "pat_stick_sandwich": "b2.bear & b1.bull & b0.bear & b0.c = b2.c",
    "pat_ladder_bottom": "b4.bear & b3.bear & b2.bear & b1.bear & b0.bull & b0.c > b2.h",
    "pat_ladder_top": "b4.bull & b3.bull & b2.bull & b1.bull & b0.bear & b0.c < b2.l",
    "pat_concealing_baby_swallow": "b3.bear & b2.bear & b1.bear & b0.bear & b1.U > 0 & b0.h > b1.h",
    "pat_unique_three_river": "b2.bear & b2.long & b1.bear & b1.o < b2.c & b0.bull & b0.o < b1.c & b0.c > b1.o",
    "pat_breakaway_bull": "b4.bear & b4.long & b3.bear & b2.bear & b1.bear & b0.bull & b0.c > b3.h",
    "pat_breakaway_bear": "b4.bull & b4.long & b3.bull & b2.bull & b1.bull & b0.bear & b0.c < b3.l",
    "pat_long_legged_doji": "b0.doji & b0.U * 1000 > b0.R * 50 & b0.L * 1000 > b0.R * 50",
    "pat_four_price_doji": "b0.R <= 0",
    "pat_rickshaw_man": "b0.doji & b0.U * 1000 > b0.R * 50 & b0.L * 1000 > b0.R * 50 & abs(b0.mid - b0.centre) * 1000 <= b0.R * 100",
    "pat_high_wave": "b0.doji & b0.U * 1000 >= b0.R * 300 & b0.L * 1000 >= b0.R * 300",
    "pat_homing_pigeon": "b1.bull & b0.bull & b1.small & b0.small & b0.B = b1.B",
    "pat_matching_low": "b1.bear & b0.bear & b0.c = b1.c",
    "pat_identical_three_crows": "b2.bear & b1.bear & b0.bear & b1.c < b2.c & b0.c < b1.c & b0.o = b1.o & b1.o = b2.o",
    "pat_advance_block": "b2.bull & b1.bull & b0.bull & b1.c > b2.c & b0.c > b1.c & b1.B < b2.B & b0.B < b1.B",
    "pat_deliberation": "b2.bull & b1.bull & b0.bull & b1.c > b2.c & b0.c > b1.c & b0.small & b1.long",
    "pat_tri_star_bull": "b2.doji & b1.doji & b0.doji & b0.c > b2.c",
    "pat_tri_star_bear": "b2.doji & b1.doji & b0.doji & b0.c < b2.c",
}


def patterns(d: Dialect) -> dict[str, str]:
    import re

    shapes = {k: _shape("" if k == 0 else str(k)) for k in range(5)}
    for k, s in shapes.items():
        s["mid"], s["centre"] = d.tdiv(f"{s['o']} + {s['c']}", "2"), d.tdiv(f"{s['h']} + {s['l']}", "2")
    out = {}
    for name, text in PATTERNS.items():
        body = re.sub(r"b([0-4])\.(\w+)", lambda m: shapes[int(m[1])][m[2]], text.replace(" & ", " AND "))
        out[name] = f"({body})" if name == "pat_four_price_doji" else f"(h > l AND {body})"
    return out


def bar_shape(d: Dialect) -> dict[str, str]:
    s = _shape("")
    r = "(h - l)"
    three = lambda side: " AND ".join(f"c{k} {side} o{k}" for k in (1, 2, 3))
    turn = "((c1 > o1 AND c2 < o2 AND c3 > o3) OR (c1 < o1 AND c2 > o2 AND c3 < o3))"
    day = d.pmod("day + 3", "7")
    out = {
        "bar_bullish": "(c > o)", "bar_bearish": "(c < o)", "bar_doji": s["doji"], "bar_large_body": f"({r} > 0 AND {s['B']} * 1000 >= {r} * 600)", "bar_small_body": s["small"],
        "long_upper_wick": f"({r} > 0 AND {s['U']} * 1000 >= {r} * 400)", "long_lower_wick": f"({r} > 0 AND {s['L']} * 1000 >= {r} * 400)",
        "prior_n_bullish": f"({three('>')})", "prior_n_bearish": f"({three('<')})", "prior_alternating": turn,
        "close_at_day_high": "(c = rh)", "close_at_day_low": "(c = rl)", "close_in_upper_third": "(rh > rl AND (c - rl) * 3 >= (rh - rl) * 2)", "close_in_lower_third": "(rh > rl AND (c - rl) * 3 <= rh - rl)",
        "early_morning": "(minute >= 0 AND minute < 60)", "mid_morning": "(minute >= 60 AND minute < 165)", "midday": "(minute >= 165 AND minute < 285)", "afternoon": "(minute >= 285 AND minute < 375)",
        "close_above_day_open": "(CASE WHEN rn > 1 THEN c > day_open END)", "close_below_day_open": "(CASE WHEN rn > 1 THEN c < day_open END)",
    }
    return out | {f"is_{n}": f"({day} = {k})" for k, n in enumerate(("monday", "tuesday", "wednesday", "thursday", "friday"))}


def day_levels(d: Dialect) -> dict[str, str]:
    wide = "2 * half"
    out = {f"near_pivot_{x}": near("c", x, wide, 500) for x in LEVELS}
    for x in LEVELS:
        out |= {f"close_above_pivot_{x}_band": f"(c > {x} + half)", f"close_below_pivot_{x}_band": f"(c < {x} - half)"}
    out |= {"close_above_pdh": "(c > pdh)", "close_below_pdh": "(c < pdh)", "close_above_pdl": "(c > pdl)", "close_below_pdl": "(c < pdl)", "near_pdh": near("c", "pdh", wide, 500), "near_pdl": near("c", "pdl", wide, 500)}
    low, high = "least(bc, tc)", "greatest(bc, tc)"
    width = "abs(tc - bc)"
    narrow, broad = f"({width} * 1000 <= (pdh - pdl) * 80)", f"({width} * 1000 >= (pdh - pdl) * 250)"
    out |= {"above_cpr_tc": f"(c > {high})", "below_cpr_bc": f"(c < {low})", "inside_cpr": f"(c >= {low} AND c <= {high})", "near_cpr_tc": near("c", "tc", wide, 500), "near_cpr_bc": near("c", "bc", wide, 500)}
    out |= {"narrow_cpr_day": narrow, "wide_cpr_day": f"({broad} AND NOT {narrow})", "neutral_cpr_day": f"(pdh > pdl AND NOT {broad} AND NOT {narrow})"}
    out |= {"gap_up_day": "(day_open > pc)", "gap_down_day": "(day_open < pc)", "inside_day": "(rh <= pdh AND rl >= pdl)", "outside_day": "(rh > pdh AND rl < pdl)"}
    out |= {"close_above_gap_mid": "(day_open <> pc AND c > gap_mid)", "close_below_gap_mid": "(day_open <> pc AND c < gap_mid)", "near_gap_mid": near("c", "gap_mid", "abs(day_open - pc)", 10)}
    return out


def fib_levels(d: Dialect) -> dict[str, str]:
    step = lambda p, r: d.fdiv(f"{p} * ({r})", "1000")
    out = {f"near_fib_{RUNG_NAMES[p]}": near("c", f"pdh - {step(p, 'pdh - pdl')}", "pdh - pdl", 10) for p in RUNGS}
    out |= {f"near_fib_bull_{RUNG_NAMES[p]}": near("c", f"pdl + {step(p, 'pdh - pdl')}", "pdh - pdl", 10) for p in (236, 786, 1272, 1618, 2000, 2618)}
    out["near_fib_424"] = near("c", f"pdl + {step(4236, 'pdh - pdl')}", "pdh - pdl", 10)
    out |= {f"near_fib_prev5_{RUNG_NAMES[p]}": near("c", f"lo5 + {step(p, 'hi5 - lo5')}", "hi5 - lo5", 10) for p in LADDER}
    for p in LADDER:
        cut = d.tdiv(f"{p} * (bh - bl)", "1000")
        at = f"(CASE WHEN leg = 1 THEN bh - {cut} WHEN leg = -1 THEN bl + {cut} END)"
        out[f"near_fib_curday_{RUNG_NAMES[p]}"] = f"(CASE WHEN leg IN (1, -1) THEN {near('c', at, 'bh - bl', 10)} ELSE false END)"
    out |= {f"near_fib_gap_{RUNG_NAMES[p]}": near("c", f"x2 + {step(p, 'x1 - x2')}", "abs(x2 - x1)", 10) for p in LADDER}
    return out


def session_levels(d: Dialect) -> dict[str, str]:
    out = {}
    for w in (5, 15, 30, 60):
        h, lo, closed = f"orh{w}", f"orl{w}", f"minute >= {w}"
        said = lambda e, closed=closed: f"(CASE WHEN {closed} THEN {e} END)"
        out |= {f"orb{w}_close_above_high": said(f"c > {h}"), f"orb{w}_close_below_low": said(f"c < {lo}"), f"orb{w}_close_inside": said(f"c >= {lo} AND c <= {h}")}
        out |= {f"orb{w}_near_high": said(near("c", h, f"{h} - {lo}", 10)), f"orb{w}_near_low": said(near("c", lo, f"{h} - {lo}", 10))}
    out |= {"close_above_vwap": "(c > vwap)", "close_below_vwap": "(c < vwap)", "close_above_vwap_session": "(c > vwap)", "close_below_vwap_session": "(c < vwap)", "near_vwap_session": near("c", "vwap", "sigma", 10)}
    for k in (1, 2, 3):
        up, low = f"(vwap + {k} * sigma)", f"(vwap - {k} * sigma)"
        out |= {f"close_above_vwap_band{k}_upper": f"(c > {up})", f"close_below_vwap_band{k}_lower": f"(c < {low})", f"inside_vwap_band{k}": f"(c >= {low} AND c <= {up})"}
        out |= {f"near_vwap_band{k}_upper": near("c", up, "sigma", 10), f"near_vwap_band{k}_lower": near("c", low, "sigma", 10)}
    return out


#: Levels whose crossings are counted, with the predicates of the two sides.
SIDES = {"pdh": ("c > pdh", "c < pdh"), "pdl": ("c > pdl", "c < pdl"), "gap_mid": ("day_open <> pc AND c > gap_mid", "day_open <> pc AND c < gap_mid"), "day_open": ("rn > 1 AND c > day_open", "rn > 1 AND c < day_open")} | {
    f"pivot_{x}_band": (f"c > {x} + half", f"c < {x} - half") for x in LEVELS
}


def crossings(d: Dialect, source: str, keys: str = "series, us, bar_id, day, session", sides: dict[str, tuple[str, str]] | None = None) -> str:
    """keys and, for each level, whether it was crossed up or down at this bar and which crossing of the session it is."""
    sides = SIDES if sides is None else sides
    side = ", ".join(f"CASE WHEN {a} THEN 1 WHEN {b} THEN -1 END AS side_{n}" for n, (a, b) in sides.items())
    was = ", ".join(f"{d.last_known(f'side_{n}', 'PARTITION BY series, day ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING')} AS was_{n}" for n in sides)
    cross = ", ".join(f"coalesce(was_{n} <> side_{n}, false) AS x_{n}" for n in sides)
    nth = ", ".join(f"sum(CASE WHEN x_{n} THEN 1 ELSE 0 END) OVER (PARTITION BY series, day ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n_{n}" for n in sides)
    parts = []
    for n in sides:
        parts += [f"(x_{n} AND side_{n} = 1) AS crossed_up_{n}", f"(x_{n} AND side_{n} = -1) AS crossed_down_{n}"]
        parts += [f"(x_{n} AND n_{n} {op}) AS {name}_cross_{n}" for name, op in (("first", "= 1"), ("second", "= 2"), ("third_plus", ">= 3"))]
    return f"SELECT {keys}, {', '.join(parts)} FROM (SELECT *, {nth} FROM (SELECT *, {cross} FROM (SELECT *, {was} FROM (SELECT *, {side} FROM ({source}) a) b) e) f) g"


def implied_pairs() -> list[tuple[str, str]]:
    """Pairs (a, b) of which a implies b: over a higher level's band is over every lower one's, and so on down."""
    chain = ("s5", "s4", "s3", "s2", "s1", "r1", "r2", "r3", "r4", "r5")
    above = [(f"close_above_pivot_{hi}_band", f"close_above_pivot_{lo}_band") for i, lo in enumerate(chain) for hi in chain[i + 1 :]]
    below = [(f"close_below_pivot_{lo}_band", f"close_below_pivot_{hi}_band") for i, lo in enumerate(chain) for hi in chain[i + 1 :]]
    return above + below + [("pat_hanging_man", "pat_hammer"), ("pat_shooting_star", "pat_inverted_hammer"), ("pat_rickshaw_man", "pat_long_legged_doji"), ("bar_doji", "bar_small_body")]


FAMILIES = {"bar_shape": bar_shape, "patterns": patterns, "day_levels": day_levels, "fib_levels": fib_levels, "session_levels": session_levels}


def names_of_crossings(sides: dict | None = None) -> list[str]:
    return [f"{p}_{n}" for n in (sides or SIDES) for p in ("crossed_up", "crossed_down", "first_cross", "second_cross", "third_plus_cross")]


def wide(d: Dialect, family: str, minutes: int = 60) -> str:
    """One nullable boolean column for each condition of a family."""
    if family == "crossings":
        return crossings(d, context(d, minutes))
    return f"SELECT series, us, bar_id, day, session, {', '.join(f'{e} AS {n}' for n, e in FAMILIES[family](d).items())} FROM ({context(d, minutes)}) x"


def names(d: Dialect, family: str) -> list[str]:
    return names_of_crossings() if family == "crossings" else list(FAMILIES[family](d))


def bits(d: Dialect, family: str, minutes: int = 60) -> str:
    """series, us and the family's conditions as one string of 1 (true), 0 (false) and - (unknown)."""
    each = " || ".join(f"(CASE WHEN {n} THEN '1' WHEN NOT {n} THEN '0' ELSE '-' END)" for n in names(d, family))
    return f"SELECT series, us, {each} AS bits FROM ({wide(d, family, minutes)}) w"


def support(d: Dialect, family: str, minutes: int = 60) -> str:
    """condition, hits, misses, unknown for each condition of a family."""
    listed = names(d, family)
    sums = ", ".join(f"count(CASE WHEN {n} THEN 1 END) AS h{i}, count(CASE WHEN NOT {n} THEN 1 END) AS m{i}" for i, n in enumerate(listed))
    counted = f"SELECT count(*) AS total, {sums} FROM ({wide(d, family, minutes)}) w"
    if d.spark:
        stacked = f"SELECT total, stack({len(listed)}, {', '.join(f"'{n}', h{i}, m{i}" for i, n in enumerate(listed))}) AS (condition, hits, misses) FROM ({counted}) c"
    else:
        lists = ", ".join(f"unnest([{', '.join(x.format(n=n, i=i) for i, n in enumerate(listed))}]) AS {c}" for c, x in (("condition", "'{n}'"), ("hits", "h{i}"), ("misses", "m{i}")))
        stacked = f"SELECT total, {lists} FROM ({counted}) c"
    return f"SELECT condition, hits, misses, total - hits - misses AS unknown FROM ({stacked}) s"

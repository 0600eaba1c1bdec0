"""Bars from events and trades from lineitem: price observations folded to open, high, low, close and volume."""

from __future__ import annotations

from candlewright.plans.dialect import Dialect

MINUTE = 60_000_000
DAY = 86_400_000_000
#: India is 5:30 ahead of UTC; its session opens at 9:15, 3:45 in UTC.
IST = 19_800_000_000
OPEN = 13_500_000_000


def ticks(d: Dialect) -> str:
    """One price in hundredths for each event: series, us, event_id, px."""
    return f"SELECT event_type AS series, {d.micros('ts')} AS us, event_id, CAST(round(value * 100) AS BIGINT) AS px FROM {{events}} WHERE value IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL"


def bucket(d: Dialect, us: str, minutes: int, anchor: int) -> str:
    """Start of the bucket of so many minutes that holds a time, on a grid through the anchor."""
    step = minutes * MINUTE
    return f"({d.fdiv(f'{us} - {anchor}', str(step))} * {step} + {anchor})"


def anchor_of(minutes: int) -> int:
    """Sub-day grids pass through the session's opening, daily ones through midnight in India."""
    return OPEN if minutes < 1440 else -IST


def bars(d: Dialect, minutes: int, anchor: int | None = None) -> str:
    """series, us (bucket start), o, h, l, c, v. Ties of time go by event_id."""
    at = bucket(d, "us", minutes, anchor_of(minutes) if anchor is None else anchor)
    return f"SELECT series, {at} AS us, {d.first('px', 'us', 'event_id')} AS o, max(px) AS h, min(px) AS l, {d.last('px', 'us', 'event_id')} AS c, count(*) AS v FROM ({ticks(d)}) t GROUP BY 1, 2"


def refold(d: Dialect, source: str, minutes: int, anchor: int | None = None) -> str:
    """Coarser bars from finer ones: first open, highest high, lowest low, last close, sum of volumes."""
    at = bucket(d, "us", minutes, anchor_of(minutes) if anchor is None else anchor)
    return f"SELECT series, {at} AS us, {d.first('o', 'us')} AS o, max(h) AS h, min(l) AS l, {d.last('c', 'us')} AS c, CAST(sum(v) AS BIGINT) AS v, count(*) AS n FROM ({source}) f GROUP BY 1, 2"


def day_of(d: Dialect, us: str = "us") -> str:
    """Day number in India."""
    return d.fdiv(f"{us} + {IST}", str(DAY))


def minute_of(d: Dialect, us: str = "us") -> str:
    """Minutes since the session's opening, negative before it."""
    return f"({d.fdiv(d.pmod(f'{us} + {IST}', str(DAY)), str(MINUTE))} - 555)"


REASONS = """CASE WHEN h < l THEN 'inverted' WHEN o > h OR o < l THEN 'open_outside' WHEN c > h OR c < l THEN 'close_outside'
  WHEN v < 0 THEN 'volume' WHEN l <= 0 THEN 'low_not_positive' ELSE 'ok' END"""


def valid(d: Dialect, minutes: int) -> str:
    """Evaluable bars with day and minute."""
    return f"SELECT *, {day_of(d)} AS day, {minute_of(d)} AS minute FROM ({bars(d, minutes)}) b WHERE {REASONS} = 'ok'"


#: Positions are closed at 15:10, 355 minutes after the opening; only a one-minute bar of 15:09 prices that.
CLOSING = 355


def squared(d: Dialect, minutes: int) -> str:
    """Valid bars with whether their interval ends by the square-off, their day's last such bar, and whether that bar
    prices the square-off: one minute long, at 15:09, and the only one there."""
    real = f"count(CASE WHEN minute = {CLOSING - 1} THEN 1 END) OVER (PARTITION BY series, day) = 1" if minutes == 1 else "false"
    return f"SELECT *, minute + {minutes} <= {CLOSING} AS fillable, max(CASE WHEN minute + {minutes} <= {CLOSING} THEN us END) OVER (PARTITION BY series, day) AS last_fill, {real} AS real_close FROM ({valid(d, minutes)}) q"


def exit_of(start: str, span: int) -> str:
    """Where a position of so many microseconds from a bar's start ends: at that exact time while it lies within the
    tradeable day, else at the square-off if that has a price, else nowhere."""
    return f"(CASE WHEN {start} + {span} <= last_fill THEN {start} + {span} WHEN real_close THEN last_fill END)"


def square_off(d: Dialect, minutes: int = 1) -> str:
    """For each day its last bar that ends by the square-off, and whether that bar prices it."""
    return f"SELECT series, day, max(last_fill) AS last_fill, max(CASE WHEN real_close THEN 1 ELSE 0 END) AS priced, count(CASE WHEN fillable THEN 1 END) AS fillable FROM ({squared(d, minutes)}) s GROUP BY series, day"

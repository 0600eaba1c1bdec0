"""Audits and pages of bar series: validity census, gaps, complete buckets, refold audit, pages and extremes."""

from __future__ import annotations

from candlewright.plans.dialect import Dialect
from candlewright.sources.bars import DAY, IST, MINUTE, REASONS, bars, bucket, day_of, minute_of, refold, ticks, valid


def census(d: Dialect, minutes: int = 60) -> str:
    """Bars by the reason they are refused for, or ok."""
    return f"SELECT reason, count(*) AS n FROM (SELECT {REASONS} AS reason FROM ({bars(d, minutes)}) b) r GROUP BY reason"


def out_of_order(d: Dialect) -> str:
    """Events in arrival order (event_id) whose time doesn't increase within their series: refused and counted."""
    return f"SELECT series, count(*) AS offered, count(CASE WHEN us <= top THEN 1 END) AS refused FROM (SELECT *, max(us) OVER (PARTITION BY series ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM ({ticks(d)}) t) r GROUP BY series"


def gaps(d: Dialect, minutes: int = 60) -> str:
    """Runs of buckets without a bar between two bars of a series: where they start, how many, and why they count.

    A hole of a day that has bars before and after it is the vendor's; one that spans a day's end is out of window.
    """
    step = minutes * MINUTE
    day = day_of(d)
    return f"""SELECT series, prev + {step} AS gap_us, {d.tdiv(f'us - prev - {step}', str(step))} AS missing, CASE WHEN day = prev_day THEN 'hole' ELSE 'outside' END AS reason
FROM (SELECT series, us, day, lag(us) OVER w AS prev, lag(day) OVER w AS prev_day FROM (SELECT series, us, {day} AS day FROM ({bars(d, minutes)}) b) x WINDOW w AS (PARTITION BY series ORDER BY us)) g
WHERE us - prev > {step}"""


def complete(d: Dialect, fine: int = 60, coarse: int = 240) -> str:
    """Coarse buckets with every fine bar in them, and the others with the reason."""
    return f"SELECT series, us, o, h, l, c, v, n, CASE WHEN n = {coarse // fine} THEN 'complete' ELSE 'incomplete' END AS verdict FROM ({refold(d, bars(d, fine), coarse)}) r"


def refold_audit(d: Dialect, fine: int = 5, coarse: int = 60) -> str:
    """Coarse bars folded from events against those folded from finer bars, field by field; only differences and counts."""
    differs = " OR ".join(f"a.{x} <> b.{x}" for x in "ohlcv")
    return f"""SELECT coalesce(a.series, b.series) AS series, count(*) AS buckets, count(CASE WHEN a.us IS NULL THEN 1 END) AS only_refolded, count(CASE WHEN b.us IS NULL THEN 1 END) AS only_direct, count(CASE WHEN {differs} THEN 1 END) AS differing
FROM ({bars(d, coarse)}) a FULL OUTER JOIN ({refold(d, bars(d, fine), coarse)}) b ON a.series = b.series AND a.us = b.us GROUP BY 1"""


def resample_midnight(d: Dialect, minutes: int = 60) -> str:
    """Bars on a grid through midnight in India, stamped at the bucket's start, the trailing bucket too."""
    return bars(d, minutes, -IST)


def page(d: Dialect, sort: str = "h", descending: bool = True, offset: int = 100, limit: int = 50) -> str:
    """A page of the 60-minute table with the change of the close, in a total order."""
    way = "DESC" if descending else "ASC"
    return f"SELECT series, us, o, h, l, c, v, c - lag(c) OVER (PARTITION BY series ORDER BY us) AS change FROM ({bars(d, 60)}) b ORDER BY {sort} {way}, us, series LIMIT {limit} OFFSET {offset}"


def extremes(d: Dialect) -> str:
    """Largest range and volume of each series."""
    return f"SELECT series, max(h - l) AS max_range, max(v) AS max_volume, count(*) AS bars, min(us) AS first_us, max(us) AS last_us FROM ({bars(d, 60)}) b GROUP BY series"


def coverage(d: Dialect, minutes: int = 60) -> str:
    """Days that traded, with the bars of each and the share of a session's buckets."""
    return f"SELECT series, day, count(*) AS bars, count(CASE WHEN minute >= 0 AND minute < 375 THEN 1 END) AS in_session, min(minute) AS first_minute, max(minute) AS last_minute FROM (SELECT series, {day_of(d)} AS day, {minute_of(d)} AS minute FROM ({bars(d, minutes)}) b) x GROUP BY series, day"


def sessions(d: Dialect, minutes: int = 60) -> str:
    """Daily bars with the previous session's levels."""
    return f"SELECT series, day, o, h, l, c, lag(h) OVER w AS pdh, lag(l) OVER w AS pdl, lag(c) OVER w AS pc FROM (SELECT series, day, {d.first('o', 'us')} AS o, max(h) AS h, min(l) AS l, {d.last('c', 'us')} AS c FROM ({valid(d, minutes)}) b GROUP BY series, day) s WINDOW w AS (PARTITION BY series ORDER BY day)"


def as_of_levels(d: Dialect) -> str:
    """Each event with the last daily close strictly before its day: an as-of join by a window, not by a range join."""
    return f"""SELECT series, event_id, day, last_close FROM (
  SELECT series, event_id, day, {d.last_known('dc', 'PARTITION BY series ORDER BY day, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW')} AS last_close, kind FROM (
    SELECT series, day, 1 AS kind, CAST(NULL AS BIGINT) AS event_id, c AS dc FROM ({sessions(d)}) s
    UNION ALL SELECT series, {day_of(d)} AS day, 0 AS kind, event_id, CAST(NULL AS BIGINT) AS dc FROM ({ticks(d)}) t) u) x WHERE kind = 0"""


def price_series(d: Dialect) -> str:
    """Daily bars of lineitem prices by return flag."""
    px = "CAST(round(l_extendedprice * 100) AS BIGINT)"
    by = ("us", "l_orderkey", "l_linenumber")
    us = bucket(d, d.micros("l_shipdate"), 1440, -IST)
    return f"SELECT l_returnflag AS series, us, {d.first('px', *by)} AS o, max(px) AS h, min(px) AS l, {d.last('px', *by)} AS c, count(*) AS v, {DAY} AS step FROM (SELECT l_returnflag, {us} AS us, {px} AS px, l_orderkey, l_linenumber FROM {{lineitem}}) x GROUP BY 1, 2"


def digests(d: Dialect, minutes: int = 60, block: int = 73) -> str:
    """A digest of each block of bars of a series, in order of time: blocks that differ between two stores differ here."""
    number = d.tdiv("row_number() OVER (PARTITION BY series ORDER BY us) - 1", str(block))
    line = " || ':' || ".join(f"CAST({x} AS {'STRING' if d.spark else 'VARCHAR'})" for x in ("us", "o", "h", "l", "c", "v"))
    return f"SELECT series, block, count(*) AS bars, md5({d.joined('line', 'us')}) AS digest FROM (SELECT series, us, {number} AS block, {line} AS line FROM ({bars(d, minutes)}) b) x GROUP BY series, block"


def without_gap_days(d: Dialect, minutes: int = 60) -> str:
    """Bars of the days on which a series has no hole between its first and last bar."""
    holes = f"SELECT DISTINCT series, {day_of(d, 'gap_us')} AS day FROM ({gaps(d, minutes)}) g WHERE reason = 'hole'"
    return f"SELECT b.series, b.day, count(*) AS bars, CAST(sum(b.v) AS BIGINT) AS volume FROM ({valid(d, minutes)}) b LEFT JOIN ({holes}) x ON b.series = x.series AND b.day = x.day WHERE x.day IS NULL GROUP BY b.series, b.day"

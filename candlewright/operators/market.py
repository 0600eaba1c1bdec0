"""Calendars and holes, landing of raw rows, masks of conditions, options against their spot, and reference lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewright.functions import finance
from candlewright.operators import conditions
from candlewright.operators.series import gaps
from candlewright.plans.dialect import DUCK, SPARK, Dialect, run
from candlewright.sources.bars import DAY, IST, MINUTE, bars, day_of, minute_of, ticks, valid

#: Minutes of a full session, from 9:15 to 15:30; what a minute that isn't held is called; why a row is dropped.
SESSION = 375
CLOSED, OUTSIDE, HOLE = "closed", "outside-window", "vendor-hole"
DROPPED = ("before the session open", "at or after the session close", "before the requested window", "after the requested window")


def calendar(d: Dialect) -> str:
    """Each day from the first to the last one observed: a weekday with bars is open, and owes a full session; a weekend is
    closed and owes nothing; a weekday without bars is closed too, for want of a holiday table."""
    held = f"SELECT {day_of(d)} AS day, count(*) AS bars FROM ({bars(d, 1)}) b GROUP BY 1"
    weekday = d.pmod("g.day + 3", "7")
    kind = f"CASE WHEN {weekday} < 5 AND h.day IS NOT NULL THEN 'open' ELSE 'closed' END"
    return f"""SELECT g.day, {weekday} AS weekday, {kind} AS kind, CASE WHEN {kind} = 'open' THEN {SESSION} ELSE 0 END AS expected, coalesce(h.bars, 0) AS bars
FROM (SELECT {d.each('lo', 'hi')} AS day FROM (SELECT min(day) AS lo, max(day) AS hi FROM ({held}) x) r) g LEFT JOIN ({held}) h ON g.day = h.day"""


def observed_calendar(d: Dialect, minutes: int = 60) -> str:
    """The windows of each day that its bars prove: runs of buckets without a hole, over all series."""
    step = minutes * MINUTE
    each = f"SELECT DISTINCT {day_of(d)} AS day, us FROM ({bars(d, minutes)}) b"
    return f"""SELECT day, {minute_of(d, 'min(us)')} AS from_minute, {minute_of(d, 'max(us)')} + {minutes - 1} AS to_minute, count(*) AS buckets FROM (
  SELECT day, us, us - row_number() OVER (PARTITION BY day ORDER BY us) * {step} AS island FROM ({each}) e) i GROUP BY day, island"""


def months_short(d: Dialect) -> str:
    """Each series and month: sessions, minutes owed and minutes held inside sessions; only a month that is short of
    sessions * 375 need be walked."""
    months = lambda x: f"(year({d.date_of(x)}) * 12 + month({d.date_of(x)}) - 1)"
    held = f"SELECT b.series, {months('b.day')} AS month, count(*) AS held FROM (SELECT series, {day_of(d)} AS day, {minute_of(d)} AS minute FROM ({bars(d, 1)}) x) b JOIN ({calendar(d)}) c ON b.day = c.day AND c.kind = 'open' WHERE b.minute >= 0 AND b.minute < {SESSION} GROUP BY 1, 2"
    owed = f"SELECT {months('day')} AS month, count(*) AS sessions, CAST(sum(expected) AS BIGINT) AS owed FROM ({calendar(d)}) c WHERE kind = 'open' GROUP BY 1"
    return f"SELECT s.series, CAST(o.month AS BIGINT) AS month, o.sessions, o.owed, coalesce(h.held, 0) AS held, coalesce(h.held, 0) < o.owed AS walked FROM (SELECT DISTINCT series FROM ({bars(d, 1)}) b) s JOIN ({owed}) o ON 1 = 1 LEFT JOIN ({held}) h ON h.series = s.series AND h.month = o.month"


def minute_ledger(d: Dialect) -> str:
    """Runs of minutes that a series doesn't hold, by reason: a hole inside an open session, outside its window, or a
    closed day. Every minute of every day of the calendar is either held or in one run; only holes are a loss."""
    grid = f"SELECT s.series, c.day, c.kind, {d.each('0', '1439')} AS minute FROM (SELECT DISTINCT series FROM ({bars(d, 1)}) b) s JOIN ({calendar(d)}) c ON 1 = 1"
    held = f"SELECT series, {day_of(d)} AS day, {minute_of(d)} + 555 AS minute FROM ({bars(d, 1)}) b"
    reason = f"CASE WHEN g.kind = 'closed' THEN '{CLOSED}' WHEN g.minute >= 555 AND g.minute < {555 + SESSION} THEN '{HOLE}' ELSE '{OUTSIDE}' END"
    missing = f"SELECT g.series, g.day, g.minute, {reason} AS reason FROM ({grid}) g LEFT JOIN ({held}) h ON h.series = g.series AND h.day = g.day AND h.minute = g.minute WHERE h.minute IS NULL"
    return f"""SELECT series, day, reason, min(minute) AS from_minute, max(minute) AS to_minute, count(*) AS minutes FROM (
  SELECT *, minute - row_number() OVER (PARTITION BY series, day, reason ORDER BY minute) AS island FROM ({missing}) m) i GROUP BY series, day, reason, island"""


def minute_ledger_sql() -> str:
    """The same runs from the held minutes and the session's edges alone, with no grid, for comparison."""
    d = DUCK
    return f"""WITH c AS ({calendar(d)}), s AS (SELECT DISTINCT series FROM ({bars(d, 1)}) b),
z AS (SELECT series, day, 'closed' AS reason, 0 AS lo, 1439 AS hi FROM s JOIN c ON kind = 'closed' UNION ALL SELECT series, day, 'outside-window', 0, 554 FROM s JOIN c ON kind = 'open'
  UNION ALL SELECT series, day, 'vendor-hole', 555, {554 + SESSION} FROM s JOIN c ON kind = 'open' UNION ALL SELECT series, day, 'outside-window', {555 + SESSION}, 1439 FROM s JOIN c ON kind = 'open'),
h AS (SELECT series, {day_of(d)} AS day, {minute_of(d)} + 555 AS minute FROM ({bars(d, 1)}) b),
p AS (SELECT z.*, h.minute FROM z JOIN h ON h.series = z.series AND h.day = z.day AND h.minute BETWEEN lo AND hi
  UNION ALL SELECT z.*, lo - 1 FROM z UNION ALL SELECT z.*, hi + 1 FROM z),
n AS (SELECT *, lead(minute) OVER (PARTITION BY series, day, reason, lo ORDER BY minute) AS later FROM p)
SELECT series, day, reason, CAST(minute + 1 AS BIGINT) AS from_minute, CAST(later - 1 AS BIGINT) AS to_minute, CAST(later - minute - 1 AS BIGINT) AS minutes FROM n WHERE later > minute + 1"""


def landed(d: Dialect, first_day: int = 19_725, last_day: int = 19_740) -> str:
    """Raw rows of a window as they would be stored: the first of each (series, minute) inside the session and the days
    asked for; each row with the reason that it is dropped for, or landed."""
    minute, day = minute_of(d), day_of(d)
    tests = (f"{minute} < 0", f"{minute} >= {SESSION}", f"{day} < {first_day}", f"{day} > {last_day}")
    reason = "CASE " + " ".join(f"WHEN {t} THEN '{r}'" for t, r in zip(tests, DROPPED, strict=True)) + " END"
    stamp = f"{d.fdiv('us', str(MINUTE))} * {MINUTE}"
    return f"""SELECT series, event_id, stamp, px, CASE WHEN reason IS NOT NULL THEN reason WHEN turn > 1 THEN 'duplicate' ELSE 'landed' END AS verdict FROM (
  SELECT *, row_number() OVER (PARTITION BY series, stamp, reason ORDER BY us, event_id) AS turn FROM (SELECT series, event_id, us, {stamp} AS stamp, px, {reason} AS reason FROM ({ticks(d)}) t) r) q"""


def land_census(d: Dialect) -> str:
    """How many rows of each series landed, and how many were dropped for each reason."""
    return f"SELECT series, verdict, count(*) AS n FROM ({landed(d)}) l GROUP BY series, verdict"


def land_census_sql() -> str:
    """The same from filters alone, for comparison."""
    d = DUCK
    t = f"SELECT *, ({minute_of(d)}) AS m, ({day_of(d)}) AS d, us // {MINUTE} AS s FROM ({ticks(d)}) t"
    inside = f"m >= 0 AND m < {SESSION}"
    parts = list(zip(DROPPED, ("m < 0", f"m >= {SESSION}", f"{inside} AND d < 19725", f"{inside} AND d > 19740"), strict=True))
    kept = f"{inside} AND d >= 19725 AND d <= 19740"
    lines = [f"SELECT series, '{n}' AS verdict, count(*) AS n FROM t WHERE {w} GROUP BY series" for n, w in parts]
    lines += [f"SELECT series, 'landed', count(DISTINCT s) FROM t WHERE {kept} GROUP BY series", f"SELECT series, 'duplicate', count(*) - count(DISTINCT s) FROM t WHERE {kept} GROUP BY series HAVING count(*) > count(DISTINCT s)"]
    return f"WITH t AS ({t}) " + " UNION ALL ".join(lines)


def overlay(d: Dialect) -> str:
    """Each hourly bar with the opening ranges and the gap's middle that stand at its last minute, from one-minute bars; a
    bar without that minute is marked and has none."""
    levels = "orh5, orl5, orh15, orl15, orh30, orl30, orh60, orl60, gap_mid"
    return f"SELECT b.series, b.us, {', '.join('m.' + x for x in levels.split(', '))}, CASE WHEN m.us IS NULL THEN 'no_minute' ELSE 'overlaid' END AS verdict FROM ({valid(d, 60)}) b LEFT JOIN ({conditions.context(d, 1)}) m ON m.series = b.series AND m.us = b.us + {59 * MINUTE}"


# masks


def masks(d: Dialect, family: str, chosen: list[str], minutes: int = 60) -> str:
    """Each bar's conditions as two words: which are true, and which could be decided. Bit i is the i-th by name."""
    names = sorted(chosen)
    word = lambda test: " + ".join(f"CASE WHEN {test.format(n)} THEN CAST({1 << i} AS BIGINT) ELSE 0 END" for i, n in enumerate(names))
    return f"SELECT series, us, day, {word('{}')} AS mask, {word('{} IS NOT NULL')} AS known FROM ({conditions.wide(d, family, minutes)}) w"


def mask_sets(d: Dialect, family: str, chosen: list[str]) -> str:
    """For each series and day: the union and the intersection of its bars' masks, how many bits each has, the positions in
    the union, and how many bars hold the whole union."""
    count = "bit_count"
    where = "concat_ws(',', " + ", ".join(f"CASE WHEN (every & {1 << i}) > 0 THEN '{i}' END" for i in range(len(chosen))) + ")"
    return f"""SELECT u.series, u.day, every, common, CAST({count}(every) AS BIGINT) AS in_every, CAST({count}(common) AS BIGINT) AS in_common, {where} AS positions, count(CASE WHEN (m.mask & every) = every THEN 1 END) AS holders FROM (
  SELECT series, day, bit_or(mask) AS every, bit_and(mask) AS common FROM ({masks(d, family, chosen)}) x GROUP BY series, day) u JOIN ({masks(d, family, chosen)}) m ON m.series = u.series AND m.day = u.day GROUP BY u.series, u.day, every, common"""


def mask_sets_sql(family: str, chosen: list[str]) -> str:
    """The same from one row for each bar and condition, for comparison."""
    names = sorted(chosen)
    long = " UNION ALL ".join(f"SELECT series, us, day, {i} AS bit, coalesce({n}, false) AS held FROM w" for i, n in enumerate(names))
    return f"""WITH w AS ({conditions.wide(DUCK, family)}), l AS ({long}), b AS (SELECT series, day, bit, bool_or(held) AS anywhere, bool_and(held) AS everywhere FROM l GROUP BY series, day, bit),
u AS (SELECT series, day, CAST(sum(CASE WHEN anywhere THEN power(2, bit) ELSE 0 END) AS BIGINT) AS every, CAST(sum(CASE WHEN everywhere THEN power(2, bit) ELSE 0 END) AS BIGINT) AS common, count(*) FILTER (anywhere) AS in_every, count(*) FILTER (everywhere) AS in_common, coalesce(string_agg(bit, ',' ORDER BY bit) FILTER (anywhere), '') AS positions FROM b GROUP BY series, day),
h AS (SELECT series, day, us, bool_and(held OR NOT anywhere) AS all_of FROM l JOIN b USING (series, day, bit) GROUP BY series, day, us)
SELECT u.*, n.holders FROM u JOIN (SELECT series, day, count(*) FILTER (all_of) AS holders FROM h GROUP BY series, day) n USING (series, day)"""


#: Conditions that are out of force: they stay in the vocabulary and admit nothing. None of those built is.
RETIRED: tuple[str, ...] = ()


def vocabulary(d: Dialect) -> str:
    """Every condition's name, family, and whether it is in force."""
    rows = [(n, f) for f in (*conditions.FAMILIES, "crossings") for n in conditions.names(d, f)]
    values = ", ".join(f"('{n}', '{f}', {str(n not in RETIRED).lower()})" for n, f in rows)
    return f"SELECT * FROM (VALUES {values}) AS v(condition, family, live)"


def union_of_tops(d: Dialect, family: str, chosen: list[str], top: int = 3) -> str:
    """The conditions that are among the commonest of any series, with how many series have them there."""
    from candlewright.operators.outcomes import hits

    return f"""SELECT condition, count(*) AS series FROM (SELECT series, condition, row_number() OVER (PARTITION BY series ORDER BY n DESC, condition) AS place FROM (
  SELECT series, condition, count(*) AS n FROM ({hits(d, family, chosen)}) h GROUP BY series, condition) c) r WHERE place <= {top} GROUP BY condition"""


# options against their spot


def option_quotes(d: Dialect) -> str:
    """Hourly option quotes made of one series, with the spot of another at the same time where there is one: a month to
    run, the strike the nearest fifty to the spot, calls and puts by turns."""
    spot = f"SELECT us, c FROM ({bars(d, 60)}) s WHERE series = 'view'"
    return f"""SELECT row_number() OVER (ORDER BY o.us) AS option_id, o.us, CAST(o.c AS DOUBLE) AS price, CAST(s.c AS DOUBLE) AS spot, CASE WHEN s.c IS NOT NULL THEN 50.0E0 * greatest(floor(s.c / 50.0E0 + 0.5E0), 1) END AS strike,
  30 / 365.0E0 AS years, 0.065E0 AS rate, 0.0E0 AS carry, 0.3E0 AS vol, o.us % 7200000000 = {13_500_000_000 % 7_200_000_000} AS call FROM (SELECT us, c FROM ({bars(d, 60)}) b WHERE series = 'click') o LEFT JOIN ({spot}) s ON s.us = o.us"""


def option_pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes by what became of them: priced, without a spot at their minute, or refused by the solver; with the sum of
    the volatilities found."""
    solved = finance.implied_volatility(run(spark, sf_dir, option_quotes(SPARK)), tick=1.0)
    reason = F.when(F.col("spot").isNull(), "no_spot").when(F.col("refused"), "refused").otherwise("priced")
    return solved.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), F.round(F.sum("implied"), 2).alias("vols"))


def option_pricing_sql() -> str:
    quotes = option_quotes(DUCK)
    solved = finance.implied_sql(DUCK, f"SELECT * FROM ({quotes}) z WHERE spot IS NOT NULL", tick=1.0).replace("CASE WHEN bounded AND", "CASE WHEN bounded AND").replace("round(found, 4)", "found")
    return f"SELECT CASE WHEN spot IS NULL THEN 'no_spot' WHEN s.refused THEN 'refused' ELSE 'priced' END AS reason, count(*) AS n, round(sum(s.implied), 2) AS vols FROM ({quotes}) q LEFT JOIN ({solved}) s ON s.option_id = q.option_id GROUP BY 1"


def tenor_work(d: Dialect) -> str:
    """Weekly expiries of both underlyings that fall due for order dates and that nothing is held of: found EXCEPT held,
    where an expiry is held if an order is dated on it."""
    known = finance.contracts(d)
    day = d.text(d.plus_days("CAST(o_orderdate AS DATE)", "11000"))
    return f"SELECT underlying, weekly AS expiry FROM ({known}) c WHERE weekly IS NOT NULL EXCEPT SELECT u.underlying, {day} FROM {{orders}} JOIN (SELECT 'NIFTY' AS underlying UNION ALL SELECT 'BANKNIFTY') u ON 1 = 1"


# reference lists


def constituents(d: Dialect) -> str:
    """An index's constituents (nations) with the first of a master's entries (suppliers in them of a positive balance), and
    why some have none."""
    first = "SELECT s_nationkey, min(s_suppkey) AS suppkey, count(*) AS found, count(CASE WHEN s_acctbal > 0 THEN 1 END) AS good FROM {supplier} GROUP BY s_nationkey"
    return f"SELECT n.n_name, r.r_name AS tier, CASE WHEN f.good > 0 THEN f.suppkey END AS suppkey, CASE WHEN f.found IS NULL THEN 'not in the master' WHEN f.good = 0 THEN 'no entry in force' WHEN f.good = f.found THEN 'found' ELSE 'found among others' END AS reason FROM {{nation}} n JOIN {{region}} r ON n.n_regionkey = r.r_regionkey LEFT JOIN ({first}) f ON f.s_nationkey = n.n_nationkey"


def scrubbed(d: Dialect) -> str:
    """Texts with the values of credentials struck out, as a digest, and how many there were. What a value looks like is
    the same in both languages' expressions."""
    pattern = r"((?:token|secret|password|api_key)\s*[=:]\s*""?)[A-Za-z0-9_./+-]+".replace('""', '"')
    every = "" if d.spark else ", 'g'"
    quoted = pattern.replace("\\", "\\\\") if d.spark else pattern
    group = "$1" if d.spark else r"\1"
    low = "lower(coalesce(text, ''))"
    found = f"size(regexp_extract_all({low}, '{quoted}', 0))" if d.spark else f"len(regexp_extract_all({low}, '{quoted}', 0))"
    return f"SELECT doc_id, CAST({found} AS BIGINT) AS struck, md5(regexp_replace({low}, '{quoted}', '{group}***'{every})) AS digest FROM {{documents}}"


def as_json(d: Dialect) -> str:
    """Daily bars as one JSON object each, nulls written out."""
    fields = ("series", "day", "o", "h", "l", "c", "pdh")
    from candlewright.operators.series import sessions

    made = f"to_json(struct({', '.join(fields)}), map('ignoreNullFields', 'false'))" if d.spark else "CAST(json_object(" + ", ".join(f"'{f}', {f}" for f in fields) + ") AS VARCHAR)"
    return f"SELECT series, day, {made} AS row_json FROM ({sessions(d)}) s"


def gaps_page(d: Dialect, offset: int = 20, limit: int = 50) -> str:
    """A page of the widest gaps."""
    return f"SELECT * FROM ({gaps(d)}) g ORDER BY missing DESC, series, gap_us LIMIT {limit} OFFSET {offset}"


def synthetic(d: Dialect, sessions: int = 20, seed: int = 17) -> str:
    """Bars of so many sessions by rule alone: prices walk by whole numbers drawn from a multiplicative congruence of the
    bar's number, so the same rows come from any engine and any partitioning."""
    n = sessions * SESSION
    draw = lambda k: f"((((i + 1) * {48_271 + k} + {seed} * 16807) % 2147483647 * 69621 % 2147483647) % 41 - 20)"
    walk = f"SELECT i, CAST(sum({draw(0)}) OVER (ORDER BY i) + 1000000 AS BIGINT) AS c, abs({draw(2)}) AS up, abs({draw(4)}) AS down FROM (SELECT {d.each('0', str(n - 1))} AS i) g"
    day = d.tdiv("i", str(SESSION))
    return f"""SELECT ({day} + {d.tdiv(day, '5')} * 2 + 4) * {DAY} - {IST} + 33300000000 + (i - {day} * {SESSION}) * {MINUTE} AS us, o, greatest(o, c) + up AS h, least(o, c) - down AS l, c, 1 + up * down AS v FROM (
  SELECT *, coalesce(lag(c) OVER (ORDER BY i), c) AS o FROM ({walk}) w) x"""


def open_interest(d: Dialect, minutes: int = 60) -> str:
    """Bars with open interest: the last one known in each bucket (an event's number in its properties, where its id isn't
    divisible by three), and the same refolded from five-minute bars."""
    k = "CAST(get_json_object(props, '$.k') AS BIGINT)" if d.spark else "CAST(json_extract_string(props, '$.k') AS BIGINT)"
    step = lambda m, us: f"{d.fdiv(f'{us} - 13500000000', str(m * MINUTE))} * {m * MINUTE} + 13500000000"
    rows = f"SELECT event_type AS series, {d.micros('ts')} AS us, event_id, CASE WHEN event_id % 3 <> 0 THEN {k} END AS oi FROM {{events}} WHERE value IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL"
    fold = lambda m: f"SELECT series, {step(m, 'us')} AS us, {d.last('oi', 'us', 'event_id')} FILTER (WHERE oi IS NOT NULL) AS oi FROM ({rows}) r GROUP BY 1, 2"
    again = f"SELECT series, {step(minutes, 'us')} AS us, {d.last('oi', 'us')} FILTER (WHERE oi IS NOT NULL) AS oi FROM ({fold(5)}) f GROUP BY 1, 2"
    return f"SELECT a.series, a.us, a.oi, b.oi AS refolded FROM ({fold(minutes)}) a JOIN ({again}) b ON a.series = b.series AND a.us = b.us"


def open_interest_sql(minutes: int = 60) -> str:
    """The same by ordered windows, for comparison."""
    d = DUCK
    rows = f"SELECT event_type AS series, {d.micros('ts')} AS us, event_id, CASE WHEN event_id % 3 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS oi FROM {{events}} WHERE value IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL"
    bucket = f"{d.fdiv('us - 13500000000', str(minutes * MINUTE))} * {minutes * MINUTE} + 13500000000"
    return f"SELECT series, bucket AS us, max(known) AS oi, max(known) AS refolded FROM (SELECT series, bucket, last_value(oi IGNORE NULLS) OVER (PARTITION BY series, bucket ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS known FROM (SELECT *, {bucket} AS bucket FROM ({rows}) r) b) k GROUP BY series, bucket"


def repair(d: Dialect, minutes: int = 60, block: int = 73) -> str:
    """A store with damaged rows (every 211th bar's close is off by one) against its source, block by block: a block whose
    digest differs is taken from the source; and whether the store is equal to it afterwards."""
    line = " || ':' || ".join(d.text(x) for x in ("us", "o", "h", "l", "{c}", "v"))
    number = d.tdiv("place - 1", str(block))
    rows = f"SELECT *, {number} AS block, CASE WHEN place % 211 = 0 THEN c + 1 ELSE c END AS held FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY us) AS place FROM ({bars(d, minutes)}) b) n"
    text = lambda c: line.replace("{c}", c)
    digests = f"SELECT series, block, count(*) AS bars, md5({d.joined('source', 'us')}) AS source, md5({d.joined('stored', 'us')}) AS stored, count(CASE WHEN held <> c THEN 1 END) AS damaged FROM (SELECT series, block, us, c, held, {text('c')} AS source, {text('held')} AS stored FROM ({rows}) r) t GROUP BY series, block"
    return f"SELECT series, block, bars, damaged, CASE WHEN source = stored THEN 'kept' ELSE 'repaired' END AS verdict FROM ({digests}) d"


def repair_sql(minutes: int = 60, block: int = 73) -> str:
    """The same by counting, with no digest, for comparison."""
    return f"""SELECT series, (place - 1) // {block} AS block, count(*) AS bars, count(*) FILTER (place % 211 = 0) AS damaged, CASE WHEN count(*) FILTER (place % 211 = 0) > 0 THEN 'repaired' ELSE 'kept' END AS verdict
FROM (SELECT series, row_number() OVER (PARTITION BY series ORDER BY us) AS place FROM ({bars(DUCK, minutes)}) b) n GROUP BY 1, 2"""


def vendor_membership(d: Dialect) -> str:
    """Which of five vendors (suppliers by their number's remainder) hold each part, as a set of bits: how many, whether
    all, and whether the first and the last both do."""
    return "SELECT l_partkey, held, CAST(bit_count(held) AS BIGINT) AS vendors, held = 31 AS every_one, (held & 17) = 17 AS first_and_last FROM (SELECT l_partkey, bit_or(CASE l_suppkey % 5 WHEN 0 THEN CAST(1 AS BIGINT) WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 8 ELSE 16 END) AS held FROM {lineitem} GROUP BY l_partkey) h"


VENDORS_SQL = "SELECT l_partkey, CAST(sum(DISTINCT power(2, l_suppkey % 5)) AS BIGINT) AS held, count(DISTINCT l_suppkey % 5) AS vendors, count(DISTINCT l_suppkey % 5) = 5 AS every_one, count(DISTINCT CASE WHEN l_suppkey % 5 IN (0, 4) THEN l_suppkey % 5 END) = 2 AS first_and_last FROM lineitem GROUP BY l_partkey"


def page_census(d: Dialect) -> str:
    """Links, comments and table cells of each page."""
    found = lambda p: f"CAST({'size' if d.spark else 'len'}(regexp_extract_all(html, '{p}', 0)) AS BIGINT)"
    slash = "\\\\" if d.spark else "\\"
    return f"SELECT page_id, {found('<a' + slash + 's[^>]*href=')} AS links, {found('(?s)<!--.*?-->')} AS comments, {found('<t[dh][^>]*>')} AS cells FROM {{pages}}"


def implications(d: Dialect, family: str = "day_levels") -> str:
    """Pairs of conditions of which one implies the other: on how many bars both hold, on how many the implied one alone,
    and on how many the rule is broken. A pair that never differs tells nothing."""
    known = set(conditions.names(d, family))
    pairs = [(a, b) for a, b in conditions.implied_pairs() if a in known and b in known]
    sums = ", ".join(f"count(CASE WHEN {a} AND {b} THEN 1 END) AS b{i}, count(CASE WHEN {b} AND NOT {a} THEN 1 END) AS o{i}, count(CASE WHEN {a} AND NOT {b} THEN 1 END) AS x{i}" for i, (a, b) in enumerate(pairs))
    rows = [(f"'{a}'", f"'{b}'", f"b{i}", f"o{i}", f"x{i}") for i, (a, b) in enumerate(pairs)]
    names = ("holds", "implies", "together", "alone", "broken")
    counted = f"SELECT {sums} FROM ({conditions.wide(d, family)}) w"
    if d.spark:
        each = f"SELECT stack({len(rows)}, {', '.join(x for r in rows for x in r)}) AS ({', '.join(names)}) FROM ({counted}) c"
    else:
        each = f"SELECT {', '.join(f'unnest([{", ".join(r[k] for r in rows)}]) AS {n}' for k, n in enumerate(names))} FROM ({counted}) c"
    return f"SELECT holds, implies, together, alone, broken, together > 0 AND alone > 0 AS informative FROM ({each}) e"


def alpha_shares(d: Dialect, batches: int = 12) -> str:
    """What each batch of trials may spend of alpha, as one over a whole number, and what is left of an eighth after it: the
    shares of all batches add up to it, and a batch that fails keeps its own."""
    return f"SELECT b AS batch, 8 * (b + 1) * (b + 2) AS denominator, round(1.0E0 / (8 * (b + 2)), 9) AS left_over FROM (SELECT {d.each('0', str(batches - 1))} AS b) g"


def alpha_sql(batches: int = 12) -> str:
    """The same by running sums, for comparison."""
    return f"SELECT b AS batch, CAST(round(1 / share) AS BIGINT) AS denominator, round(0.125 - sum(share) OVER (ORDER BY b), 9) AS left_over FROM (SELECT range AS b, (1.0::DOUBLE / (range + 1) - 1.0::DOUBLE / (range + 2)) / 8 AS share FROM range({batches})) s"

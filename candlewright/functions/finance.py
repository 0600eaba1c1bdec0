"""Option prices and sensitivities, charges of a round trip, strikes and lots, as SQL over whole paisa and doubles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewright.functions.normal import cdf
from candlewright.plans.dialect import Dialect

#: Fixed values, in ten-millionths of the notional: tax on the seller's premium from each day on, exchange charge from
#: each day on (none before the first), regulator's fee, protection fund, stamp on purchases, goods tax on fees.
SELLER_TAX = (("0001-01-01", 6_250), ("2024-10-01", 10_000), ("2026-04-01", 15_000))
EXCHANGE = (("2024-10-01", 3_503),)
REGULATOR, FUND, STAMP, GOODS_TAX = 10, 50, 300, 1_800_000
UNIT = 10_000_000
#: Brokerage of one order and the tick, in paisa.
BROKERAGE, TICK = 2_000, 5


def regime(day: str, table: tuple[tuple[str, int], ...]) -> str:
    """The rate in force on a day, null before the first: the latest start that isn't after it."""
    cases = " ".join(f"WHEN {day} >= DATE '{start}' THEN {rate}" for start, rate in reversed(table))
    return f"(CASE {cases} END)"


def ceil_div(d: Dialect, a: str, b: int) -> str:
    return d.fdiv(f"{a} + {b - 1}", str(b))


def levy(d: Dialect, notional: str, rate: str) -> str:
    """A fee, rounded up to the paisa."""
    return ceil_div(d, f"({notional}) * ({rate})", UNIT)


def statutory(d: Dialect, notional: str, rate: str) -> str:
    """A tax: down to the paisa, then up to the rupee."""
    return f"({ceil_div(d, d.fdiv(f'({notional}) * ({rate})', str(UNIT)), 100)} * 100)"


def charges(d: Dialect, trips: str) -> str:
    """Charges and net of each round trip: trips has trip_id, day (date), buy, sell (paisa a unit), quantity.

    Fills are the adverse extreme: a tick over the buy and under the sell. A trip before the exchange charge is known,
    or whose sell fill isn't positive, is refused whole."""
    buy, sell = f"((buy + {TICK}) * quantity)", f"((sell - {TICK}) * quantity)"
    both = lambda rate: f"({levy(d, buy, rate)} + {levy(d, sell, rate)})"
    ex = regime("day", EXCHANGE)
    fee_base = f"(2 * {BROKERAGE} + exchange + regulator + fund)"
    return f"""SELECT trip_id, gross, brokerage, tax, exchange, regulator, fund, stamp, {statutory(d, fee_base, str(GOODS_TAX))} AS goods_tax,
  gross - brokerage - tax - exchange - regulator - fund - stamp - {statutory(d, fee_base, str(GOODS_TAX))} AS net, refused FROM (
  SELECT trip_id, {sell} - {buy} AS gross, CAST({2 * BROKERAGE} AS BIGINT) AS brokerage, {statutory(d, sell, regime('day', SELLER_TAX))} AS tax, {both(ex)} AS exchange, {both(str(REGULATOR))} AS regulator, {both(str(FUND))} AS fund,
    {statutory(d, buy, str(STAMP))} AS stamp, ({ex} IS NULL OR sell <= {TICK}) AS refused FROM ({trips}) t) c"""


def trips(d: Dialect) -> str:
    """Round trips made of lineitem: 11,322 days later, bought at the unit price and sold after discount and tax."""
    unit = "round(l_extendedprice * 100 / l_quantity)"
    return f"""SELECT l_orderkey * 10 + l_linenumber AS trip_id, {'date_add(CAST(l_shipdate AS DATE), 11322)' if d.spark else 'CAST(l_shipdate AS DATE) + 11322'} AS day, CAST({unit} AS BIGINT) AS buy,
  CAST(round({unit} * (1 + l_discount - l_tax)) AS BIGINT) AS sell, CAST(l_quantity AS BIGINT) * 25 AS quantity FROM {{lineitem}}"""


def greeks(d: Dialect, options: str) -> str:
    """Price, delta, gamma, vega, theta and rho: options has option_id, spot, strike, years, rate, carry, vol (doubles), call.

    `carry` is the yield of holding the spot (0: none). Spot, strike, years and vol must be positive, or all results are
    null."""
    pdf = "(exp(-d1 * d1 / 2) / 2.5066282746310002E0)"
    sign = "(CASE WHEN call THEN 1 ELSE -1 END)"
    n1, n2 = cdf(f"({sign} * d1)"), cdf(f"({sign} * d2)")
    df, cf = "exp(-rate * years)", "exp(-carry * years)"
    drift = lambda s: f"CASE WHEN ok THEN (ln(spot / strike) + (rate - carry {s} vol * vol / 2) * years) / (vol * sqrt(years)) END"
    return f"""SELECT option_id, round({sign} * (spot * {cf} * {n1} - strike * {df} * {n2}), 4) AS price, round({sign} * {cf} * {n1}, 5) AS delta, round({cf} * {pdf} / (spot * vol * sqrt(years)), 7) AS gamma, round(spot * {cf} * {pdf} * sqrt(years), 4) AS vega,
  round(-spot * {cf} * {pdf} * vol / (2 * sqrt(years)) - {sign} * rate * strike * {df} * {n2} + {sign} * carry * spot * {cf} * {n1}, 4) AS theta, round({sign} * strike * years * {df} * {n2}, 4) AS rho FROM (
  SELECT *, {drift('+')} AS d1, {drift('-')} AS d2 FROM (
    SELECT *, (spot > 0 AND strike > 0 AND years > 0 AND vol > 0) AS ok FROM ({options}) o) p) q"""


def options(d: Dialect) -> str:
    """Options made of part: spot from the retail price, strike at the nearest fifty, half a year or more, a fifth to two thirds of volatility."""
    return "SELECT p_partkey AS option_id, p_retailprice * 10 AS spot, 50 * floor(p_retailprice * 10 / 50 + 0.5E0) * (1 + (p_size % 7 - 3) * 0.02E0) AS strike, (180 + p_size * 10) / 365.0E0 AS years, 0.065E0 AS rate, (p_size % 3) * 0.01E0 AS carry, 0.2E0 + p_size / 100.0E0 AS vol, p_partkey % 2 = 0 AS call FROM {part}"


def strikes(d: Dialect) -> str:
    """Nearest strike of each price on a grid of fifty (ties up), and those two steps into and out of the money."""
    atm = f"({d.fdiv('px + 2500', '5000')} * 5000)"
    return f"SELECT event_id, {atm} AS atm, {atm} + 10000 AS call_otm, {atm} - 10000 AS call_itm, CASE WHEN px > {atm} THEN 'itm' WHEN px < {atm} THEN 'otm' ELSE 'atm' END AS call_moneyness FROM (SELECT event_id, CAST(round(value * 100) AS BIGINT) AS px FROM {{events}} WHERE value IS NOT NULL) e"


def price_one(spot, strike, years, rate, vol, call, carry=0.0):
    import math

    import numpy as np

    phi = np.vectorize(lambda x: 0.5 * math.erfc(-x / math.sqrt(2)), otypes=[float])
    d1 = (np.log(spot / strike) + (rate - carry + vol * vol / 2) * years) / (vol * np.sqrt(years))
    s = np.where(call, 1.0, -1.0)
    return s * (spot * np.exp(-carry * years) * phi(s * d1) - strike * np.exp(-rate * years) * phi(s * (d1 - vol * np.sqrt(years))))


def implied_volatility(quotes: DataFrame, tick: float = 1e-4) -> DataFrame:
    """quotes (spot, strike, years, rate, price, call and any other columns; carry too, or it is zero) with `implied` and
    `refused`.

    A price outside its no-arbitrage bounds is refused. Within, at most 8 Newton steps from a starting guess of a half, in
    [1e-6, 5]; what hasn't settled is halved 64 times. A price that no volatility in it gives is refused, and so is one
    where a change of the price by half a `tick` moves the volatility by more than a hundredth: the quote says too
    little. Nulls are refused."""

    carried = "carry" in quotes.columns

    def solve(batches):
        import numpy as np

        for pdf in batches:
            x = {c: pdf[c].to_numpy(dtype=float, na_value=np.nan) for c in ("spot", "strike", "years", "rate", "price")}
            x["carry"] = pdf["carry"].to_numpy(dtype=float, na_value=np.nan) if carried else np.zeros(len(pdf))
            call = pdf["call"].fillna(False).to_numpy(dtype=bool)
            with np.errstate(all="ignore"):
                held, owed = x["spot"] * np.exp(-x["carry"] * x["years"]), x["strike"] * np.exp(-x["rate"] * x["years"])
                floor, roof = np.maximum(0, np.where(call, 1, -1) * (held - owed)), np.where(call, held, owed)
                ok = (x["spot"] > 0) & (x["strike"] > 0) & (x["years"] > 0) & (x["price"] > floor) & (x["price"] < roof)
                safe = [np.where(ok, x[c], 1.0) for c in ("spot", "strike", "years", "rate", "carry")]
                value = lambda vol: price_one(*safe[:4], vol, call, safe[4])

                def vega(vol):
                    d1 = (np.log(safe[0] / safe[1]) + (safe[3] - safe[4] + vol * vol / 2) * safe[2]) / (vol * np.sqrt(safe[2]))
                    return safe[0] * np.exp(-safe[4] * safe[2]) * np.exp(-d1 * d1 / 2) / 2.5066282746310002 * np.sqrt(safe[2])

                vol, low, high = np.full(len(pdf), 0.5), np.full(len(pdf), 1e-6), np.full(len(pdf), 5.0)
                settled = np.zeros(len(pdf), dtype=bool)
                for _ in range(8):
                    off = value(vol) - x["price"]
                    low, high = np.where(off < 0, np.maximum(low, vol), low), np.where(off >= 0, np.minimum(high, vol), high)
                    step = off / vega(vol)
                    settled |= np.abs(step) < 1e-12
                    moved = vol - step
                    vol = np.where(settled, vol, np.where((moved > low) & (moved < high), moved, (low + high) / 2))
                for _ in range(64):
                    if (settled | ~ok).all():
                        break
                    vol = np.where(settled, vol, (low + high) / 2)
                    below = value(vol) < x["price"]
                    low, high = np.where(below & ~settled, vol, low), np.where(~below & ~settled, vol, high)
                ok &= (vol > 2e-6) & (vol < 4.999) & (0.5 * tick <= 0.01 * vega(vol))
            yield pdf.assign(implied=pd.Series(np.where(ok, vol, np.nan), index=pdf.index), refused=~ok)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in quotes.schema.fields)
    return quotes.mapInPandas(solve, f"{fields}, implied double, refused boolean").withColumn("implied", F.when(~F.col("refused"), F.col("implied")))


def implied_sql(d: Dialect, quotes: str, tick: float = 1e-4, rounds: int = 60) -> str:
    """The implied volatility by halving alone, in a recursive query, for comparison."""
    sign = "(CASE WHEN call THEN 1 ELSE -1 END)"
    held, owed = "(spot * exp(-carry * years))", "(strike * exp(-rate * years))"
    d1 = lambda v: f"((ln(spot / strike) + (rate - carry + {v} * {v} / 2) * years) / ({v} * sqrt(years)))"
    halved = f"SELECT r.option_id, r.n, r.low, r.high, (r.low + r.high) / 2 AS mid, q.* EXCLUDE (option_id) FROM r JOIN q ON q.option_id = r.option_id WHERE r.n < {rounds}"
    turned = f"SELECT *, {sign} * {d1('mid')} AS a, {sign} * ({d1('mid')} - mid * sqrt(years)) AS b FROM ({halved}) h"
    worth = f"SELECT option_id, n, low, high, mid, {sign} * ({held} * {cdf('a')} - {owed} * {cdf('b')}) < price AS under FROM ({turned}) t"
    return f"""WITH RECURSIVE q AS (SELECT *, (spot > 0 AND strike > 0 AND years > 0 AND price > greatest(0, {sign} * ({held} - {owed})) AND price < CASE WHEN call THEN {held} ELSE {owed} END) AS bounded FROM ({quotes}) x),
r AS (SELECT option_id, 0 AS n, 1e-6::DOUBLE AS low, 5.0::DOUBLE AS high FROM q WHERE bounded
  UNION ALL SELECT option_id, n + 1, CASE WHEN under THEN mid ELSE low END, CASE WHEN under THEN high ELSE mid END FROM ({worth}) w),
f AS (SELECT q.*, (low + high) / 2 AS found FROM q LEFT JOIN r ON r.option_id = q.option_id AND r.n = {rounds}),
k AS (SELECT *, {held} * exp(-power({d1('found')}, 2) / 2) / 2.5066282746310002E0 * sqrt(years) AS vega FROM f)
SELECT option_id, vol, CASE WHEN bounded AND found > 2e-6 AND found < 4.999 AND {0.5 * tick!r} <= 0.01 * vega THEN round(found, 4) END AS implied, NOT coalesce(bounded AND found > 2e-6 AND found < 4.999 AND {0.5 * tick!r} <= 0.01 * vega, false) AS refused FROM k"""


#: Contract sizes from each day on (none known before the first), weekly and monthly expiry weekdays from
#: each day on (Monday is 0; None: withdrawn).
LOTS = {
    "NIFTY": (("2021-01-01", 75), ("2021-07-29", 50), ("2024-04-26", 25), ("2024-11-20", 75), ("2026-01-01", 65)),
    "BANKNIFTY": (("2021-01-01", 25), ("2023-06-30", 15), ("2024-11-20", 30), ("2025-07-01", 35), ("2025-12-30", 30)),
}
WEEKLY = {"NIFTY": (("0001-01-01", 3), ("2025-09-02", 1)), "BANKNIFTY": (("0001-01-01", 3), ("2023-09-04", 2), ("2024-11-14", None))}
MONTHLY = {"NIFTY": (("0001-01-01", 3), ("2025-09-02", 1)), "BANKNIFTY": (("0001-01-01", 3), ("2024-03-01", 2), ("2025-01-01", 3), ("2025-09-02", 1))}


def dated(day: str, table: tuple) -> str:
    """regime, with null where the value in force is none."""
    return "(CASE " + " ".join(f"WHEN {day} >= DATE '{start}' THEN {'NULL' if v is None else v}" for start, v in reversed(table)) + " END)"


def contracts(d: Dialect) -> str:
    """For each order date (11,000 days later) and underlying: the contract size in force, what three lots hold and cost,
    and the next weekly and monthly expiry, a day that expires counting as its own."""
    day = f"{d.plus_days('CAST(o_orderdate AS DATE)', '11000')}"
    number = lambda x: d.day_number(x)
    parts = []
    for name in LOTS:
        weekly, lot = dated("day", WEEKLY[name]), dated("day", LOTS[name])
        ahead = d.pmod(f"{weekly} - {d.pmod(number('day') + ' + 3', '7')}", "7")
        last = lambda first: d.plus_days(d.last_day(first), "-" + d.pmod(f"{d.pmod(number(d.last_day(first)) + ' + 3', '7')} - {dated(first, MONTHLY[name])}", "7"))  # noqa: B023, E731
        this, later = last("day"), last(d.plus_days(d.last_day("day"), "1"))
        parts.append(f"SELECT o_orderkey, '{name}' AS underlying, {d.text('day')} AS day, {lot} AS lot, 3 * {lot} AS quantity, 3 * {lot} * price AS notional, CASE WHEN {lot} IS NULL THEN 'unverified' ELSE 'ok' END AS verdict, CASE WHEN {weekly} IS NOT NULL THEN {d.text(d.plus_days('day', ahead))} END AS weekly, {d.text(f'CASE WHEN {this} >= day THEN {this} ELSE {later} END')} AS monthly FROM t")
    return f"WITH t AS (SELECT o_orderkey, {day} AS day, CAST(round(o_totalprice) AS BIGINT) AS price FROM {{orders}}) " + " UNION ALL ".join(parts)

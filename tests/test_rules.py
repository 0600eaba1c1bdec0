"""Rules on fixtures whose answers are worked out by hand or written apart."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from candlewright.functions import finance, normal, statistics
from candlewright.operators import market, mining, outcomes, trades, trend
from candlewright.plans.dialect import DUCK, SPARK
from candlewright.sources import bars


def test_supertrend_flips_by_hand():
    s = trend.SuperTrend(n=2, times=1)
    # middle 100, range 20: closes above the middle, so the stop starts under it, a range away
    s.fold(110, 90, 105)
    assert (s.up, s.level, s.stop()) == (True, 80, None)
    # range 20, middle 110: the band's lower side is 90, and the stop rises to it
    s.fold(120, 100, 115)
    assert (s.up, s.level, s.stop()) == (True, 90, 90)
    # true range 115 - 90 = 25, average 22.5, lower side 78: the stop never falls while the trend holds
    s.fold(110, 90, 95)
    assert s.atr == 22_500_000 and (s.up, s.level) == (True, 90)
    # true range 95 - 60 = 35, average 28.75; a close under 90 turns it, to the middle 70 and a band of 28
    s.fold(80, 60, 62)
    assert s.atr == 28_750_000 and (s.up, s.level) == (False, 98)
    # true range 100 - 62 = 38, average 33.375; going down the stop only falls: the upper side 123 stays above it
    s.fold(100, 80, 90)
    assert s.atr == 33_375_000 and (s.up, s.level) == (False, 98)
    # true range 120 - 90 = 30, average 31.6875; a close over 98 turns it again, to the middle 110 less 31
    s.fold(120, 100, 118)
    assert s.atr == 31_687_500 and (s.up, s.level) == (True, 79)


def test_supertrend_starts_by_the_middle():
    s = trend.SuperTrend()
    s.fold(110, 90, 95)
    assert (s.up, s.level) == (False, 160)


def test_tail_keeps_its_digits():
    con = duckdb.connect()
    for t in (0.0, 0.5, 1.96, 4.0, 7.5, 15.0, 30.0):
        p, log10 = con.execute(f"SELECT {normal.two_sided(f'{t!r}::DOUBLE')}, {normal.log10_two_sided(f'{t!r}::DOUBLE')}").fetchone()
        want = math.erfc(t / math.sqrt(2))
        assert abs(p / want - 1) < 2e-7 and abs(log10 - math.log10(want)) < 1e-6
    log10 = con.execute(f"SELECT {normal.log10_two_sided('60::DOUBLE')}").fetchone()[0]
    assert -800 < log10 < -700  # beyond the least double
    assert abs(con.execute(f"SELECT {normal.cdf('-1.0::DOUBLE')}").fetchone()[0] - 0.15865525393145707) < 1e-7


def events(rows):
    """A DuckDB table of events (series, minute of the day in India, price), one day each, as the plans read it."""
    con = duckdb.connect()
    frame = pd.DataFrame([(i, s, pd.Timestamp("2024-01-02") + pd.Timedelta(minutes=m - 330) + pd.Timedelta(days=d), v) for i, (s, d, m, v) in enumerate(rows)], columns=["event_id", "event_type", "ts", "value"])
    con.execute("create table events as select event_id, event_type, ts::TIMESTAMP as ts, value from frame")
    return con


def test_square_off_by_hand():
    minute = lambda h, m: h * 60 + m
    rows = [("a", 0, minute(15, 5 + k), 100 + k) for k in range(6)]  # 15:05 to 15:10
    rows += [("b", 0, minute(15, 5 + k), 100 + k) for k in range(4)]  # 15:05 to 15:08: no 15:09
    con = events(rows)
    rows_of = lambda c, s: c.execute(f"SELECT ret, refused FROM ({outcomes.forward(DUCK, 1, 3)}) f WHERE series = '{s}' ORDER BY us".format(events="events")).fetchall()
    # 15:06 reaches 15:09 exactly; 15:07 and 15:08 are closed there; 15:09 closes and 15:10 can't open
    assert rows_of(con, "a") == [(300, False), (300, False), (200, False), (100, False), (None, False), (None, False)]
    assert rows_of(con, "b") == [(300, False), (None, False), (None, False), (None, False)]  # no price at 15:09
    off = con.execute(bars.square_off(DUCK).format(events="events")).df().set_index("series")
    assert off.priced.to_dict() == {"a": 1, "b": 0}
    holed = events([("a", 0, minute(10, k), 100 + k) for k in (0, 1, 3)])
    assert rows_of(holed, "a") == [(None, True), (None, False), (None, False)]  # 10:02 is missing on the way; no end after that


def test_calendar_grains():
    con = duckdb.connect()
    us = int(pd.Timestamp("2024-06-30 18:31").value // 1000)  # the first minute of July in India, a Monday
    keys = con.execute("SELECT " + ", ".join(f"{e} AS {n}" for n, e in trades.grains(DUCK, str(us)).items())).df().iloc[0].to_dict()
    assert (keys["year"], keys["half"], keys["quarter"], keys["month"]) == (2024, 4049, 8098, 24294)
    assert (keys["weekday"], keys["hour_of_day"]) == (0, 0)
    before = con.execute("SELECT " + ", ".join(f"{e} AS {n}" for n, e in trades.grains(DUCK, str(us - 120_000_000)).items())).df().iloc[0].to_dict()
    assert (before["month"], before["quarter"], before["half"], before["weekday"]) == (24293, 8097, 4048, 6) and before["week"] == keys["week"] - 1


def test_lots_and_expiries(spark):
    from candlewright.plans.dialect import run

    rows = {(r.underlying, r.day): r for r in run(spark, "/root/testdata/sf0.001", finance.contracts(SPARK)).collect()}
    for (name, day), r in rows.items():
        d = pd.Timestamp(day)
        lot = [v for start, v in finance.LOTS[name] if pd.Timestamp(start) <= d]
        assert r.lot == (lot[-1] if lot else None)
        target = [v for start, v in finance.WEEKLY[name] if start <= day][-1]
        assert r.weekly == (None if target is None else str((d + pd.Timedelta(days=(target - d.weekday()) % 7)).date()))
        assert pd.Timestamp(r.monthly) >= d and (pd.Timestamp(r.monthly) + pd.Timedelta(days=7)).month != pd.Timestamp(r.monthly).month


def test_composite_by_hand():
    con = duckdb.connect()
    con.execute("create table t as select * from (values ('a', 10, 5, 5, 1000, 500, -200, 300), ('b', 10, 5, 5, 1000, 500, -200, 300), ('c', 20, 0, 20, 0, 4000, -900, 4000)) v(condition, trades, wins, losses, gross_win, gross_loss, worst, drawdown)".replace("select *", "select condition, " + ", ".join(f"{c}::BIGINT as {c}" for c in ("trades", "wins", "losses", "gross_win", "gross_loss", "worst", "drawdown"))))
    rows = con.execute(outcomes.composite(DUCK, "SELECT * FROM t")).fetchall()
    # a and b are best in every criterion that is measured, c the worst; without a win it has no loss ratio, average win, or reward
    assert [r[0] for r in rows] == ["a", "b", "c"] and rows[0][1:] == ((8 * 1_000_000 + 3 * 500_000) // 11, 0) and rows[2][1:] == (3 * 500_000 // 11, 3)
    only = con.execute(outcomes.composite(DUCK, "SELECT * FROM t", {"profit": 1})).fetchall()
    assert [r[1] for r in only] == [1_000_000, 1_000_000, 0]
    with pytest.raises(ValueError):
        outcomes.composite(DUCK, "SELECT * FROM t", {"none": 1})


def test_set_edges_by_hand(spark):
    near = lambda *b: {"bits": list(b[:-1]), "ret": b[-1]}
    rows = [([0, 1], 10, 2, 12, [near(0, 20)]), ([0], 20, 1, 25, [near(0, 1, -30)]), ([0, 1], -30, 40, 5, [None]), ([1], 7, 1, 9, [near(0, 5)]), ([0, 1], None, None, None, [None])]
    table = spark.createDataFrame(rows, "bits array<int>, ret long, adverse long, favourable long, ahead array<struct<bits:array<int>,ret:long>>")
    got = {r.condition: r for r in mining.set_edges(table, ["a", "b"], [("a",), ("a", "b")], 2).collect()}
    assert (got["a"].n, got["a"].total, got["a"].wins, got["a"].losses, got["a"].best, got["a"].worst, got["a"].worst_adverse) == (3, 0, 2, 1, 20, -30, 40)
    assert (got["a,b"].n, got["a,b"].total) == (2, -20)
    x = np.array([10.0, 20.0, -30.0])
    both = 0.5 * (x[0] * x[1] + x[1] * x[2])  # neighbours are half an horizon apart
    var = ((x**2).sum() + 2 * both) / 2
    assert got["a"].t is None or abs(got["a"].t - 0.0 / math.sqrt(max(var, 1e-9) / 3)) < 1e-6


def test_counts_of_sets(spark):
    rng = np.random.default_rng(7)
    held = rng.random((500, 9)) < 0.5
    table = spark.createDataFrame([([int(i) for i in np.flatnonzero(r)],) for r in held], "bits array<int>").repartition(3)
    sets = [(0, 1), (0, 2), (1, 8), (3, 4)]
    assert mining.count_sets(table, 9, sets) == [int(held[:, list(s)].all(axis=1).sum()) for s in sets]


def test_ladder_account_adds_up(spark):
    rows = [(b, i) for b in range(60) for k, i in enumerate("abcdef") if b % (k + 2)]
    _, accounts = mining.ladder(spark.createDataFrame(rows, "bar long, item string"), 10, 60)
    for a in accounts[1:]:
        assert a["generated"] == a["pruned"] + a["infrequent"] + a["survivors"]
    _, accounts = mining.ladder(spark.createDataFrame(rows, "bar long, item string"), 1, 60, ceiling=3)
    assert accounts[-1]["halted"] and accounts[-1]["candidates"] > 3


def test_implied_volatility_round_trip(spark):
    rows = [(k, 100.0, 80.0 + k, 0.5, 0.05, 0.02, 0.1 + 0.02 * (k % 20), k % 2 == 0) for k in range(40)]
    price = [float(finance.price_one(*(np.array([v]) for v in r[1:5]), np.array([r[6]]), np.array([r[7]]), np.array([r[5]]))[0]) for r in rows]
    quotes = spark.createDataFrame([(*r, p) for r, p in zip(rows, price, strict=True)] + [(90, 100.0, 100.0, 0.5, 0.05, 0.0, 0.2, True, 150.0), (91, None, 100.0, 0.5, 0.05, 0.0, 0.2, True, 5.0)], "option_id long, spot double, strike double, years double, rate double, carry double, vol double, call boolean, price double")
    got = {r.option_id: r for r in finance.implied_volatility(quotes, tick=1e-6).collect()}
    assert all(abs(got[r[0]].implied - r[6]) < 1e-8 for r in rows if not got[r[0]].refused)
    assert sum(got[r[0]].refused for r in rows) < 10 and got[90].refused and got[91].refused
    wide = {r.option_id: r.refused for r in finance.implied_volatility(quotes, tick=50.0).collect()}
    assert all(wide.values())  # a quote that may be off by 25 says nothing


def test_carry_keeps_parity():
    x = [np.array([v]) for v in (100.0, 95.0, 0.75, 0.05, 0.03)]
    call, put = (float(finance.price_one(*x[:4], np.array([0.3]), np.array([c]), x[4])[0]) for c in (True, False))
    assert abs(call - put - (100 * math.exp(-0.03 * 0.75) - 95 * math.exp(-0.05 * 0.75))) < 1e-9


def test_every_minute_is_held_or_in_one_run(spark):
    from candlewright.plans.dialect import run

    folder = "/root/testdata/sf0.001"
    runs = run(spark, folder, f"SELECT sum(minutes) AS n FROM ({market.minute_ledger(SPARK)}) l").first().n
    days = run(spark, folder, f"SELECT count(*) AS n FROM ({market.calendar(SPARK)}) c").first().n
    held = run(spark, folder, f"SELECT count(*) AS n, count(DISTINCT series) AS s FROM ({bars.bars(SPARK, 1)}) b").first()
    assert runs + held.n == days * held.s * 1440


def test_effective_trials_of_a_ladder():
    assert statistics.effective_trials([{"k": 1, "survivors": 5}, {"k": 2, "generated": 10, "pruned": 2, "infrequent": 3, "survivors": 5}], 4) == 9


def test_ladder_over_rows_of_names(spark):
    rng = np.random.default_rng(19)
    rows = [(b, [n for n in "abcdefg" if rng.random() < 0.6] + ["a"] * (b % 3)) for b in range(80)]
    wide = spark.createDataFrame(rows, "bar long, names array<string>")
    long = wide.selectExpr("bar", "explode(names) AS item")
    read = lambda sets: sorted((tuple(r["items"]), r["hits"]) for r in sets.collect())
    assert read(mining.ladder(wide, 12, 80)[0]) == read(mining.ladder(long, 12, 80)[0]) != []

"""Folds, mining, expressions, statistics, finance and readers against plain restatements."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candlewright.functions import finance, statistics
from candlewright.functions.expression import enumerate_trees, parse, to_sql
from candlewright.operators import conditions, mining, trend
from candlewright.plans.dialect import DUCK
from candlewright.sources import files
from candlewright.streaming import bars as stream


def test_ladder_equals_all_subsets(spark):
    rng = random.Random(3)
    held = {b: [i for i in "abcdefg" if rng.random() < 0.5] for b in range(60)}
    rows = [(b, i) for b, s in held.items() for i in s]
    got, accounts = mining.ladder(spark.createDataFrame(rows, "bar long, item string"), 12, universe=60)
    found = {tuple(r["items"]): r["hits"] for r in got.collect()}
    want = {}
    for k in range(1, 8):
        for s in itertools.combinations("abcdefg", k):
            n = sum(set(s) <= set(h) for h in held.values())
            if n >= 12:
                want[s] = n
    assert found == want
    assert accounts[-1]["survivors"] == 0
    closed = {tuple(r["items"]) for r in mining.closed(got).collect()}
    assert closed == {s for s, n in want.items() if not any(set(s) < set(t) and len(t) == len(s) + 1 and m == n for t, m in want.items())}


def test_ladder_drops_constant_and_identical_items(spark):
    rows = [(b, i) for b in range(10) for i in "abc" if i == "a" or b < 5]
    got, _ = mining.ladder(spark.createDataFrame(rows, "bar long, item string"), 1, universe=10)
    assert [(r["items"], r["hits"]) for r in got.collect()] == [(["b"], 5)]
    dead = spark.createDataFrame([("c", "b")], "a string, b string")
    some, _ = mining.ladder(spark.createDataFrame([(b, i) for b in range(10) for k, i in enumerate("abc") if b > k], "bar long, item string"), 1, dead=dead)
    assert sorted(tuple(r["items"]) for r in some.collect()) == [("a",), ("a", "b"), ("a", "c"), ("b",), ("c",)]
    empty, accounts = mining.ladder(spark.createDataFrame([], "bar long, item string"), 1)
    assert empty.count() == 0 and accounts == [{"k": 1, "survivors": 0}]


def test_ladder_resumes(spark, tmp_path):
    rows = [(b, i) for b in range(30) for k, i in enumerate("abcde") if b % (k + 2)]
    items = spark.createDataFrame(rows, "bar long, item string")
    read = lambda sets: sorted((tuple(r["items"]), r["hits"]) for r in sets.collect())
    plain = read(mining.ladder(items, 8, 30)[0])
    folder = str(tmp_path / "ladder")
    assert read(mining.ladder(items, 8, 30, store=folder)[0]) == plain
    import shutil

    shutil.rmtree(f"{folder}/level-3")
    assert read(mining.ladder(items, 8, 30, store=folder)[0]) == plain
    with pytest.raises(ValueError):
        mining.ladder(items, 9, 30, store=folder)


def test_auto_threshold(spark):
    rows = [(b, i) for b in range(16) for k, i in enumerate("abcd") if b % (k + 2) == 0]
    items = spark.createDataFrame(rows, "bar long, item string")
    least = mining.auto_threshold(items, 16, 4)
    assert mining.ladder(items, least, 16)[0].count() <= 4
    assert least == 1 or mining.ladder(items, least - 1, 16)[0].count() > 4


def test_expression_precedence_and_errors():
    names = ["a", "b", "c"]
    assert to_sql(parse("a OR b AND NOT c", names)) == to_sql(parse("(NOT 2 AND b) or a", names))
    for bad in ("", "a b", "(a", "a AND", "d", "NOT", ")"):
        with pytest.raises(ValueError):
            parse(bad, names)
    assert len(list(enumerate_trees(["a", "b"], 3))) == 2


def test_trend_fold_by_hand():
    n = 260
    rng = np.random.default_rng(1)
    c = 10_000 + rng.integers(-50, 51, n).cumsum()
    bars = pd.DataFrame({"series": "s", "us": np.arange(n), "day": 0, "rn": np.arange(n) + 1, "h": c + 20, "l": c - 20, "c": c})
    out = trend.fold(bars.sample(frac=1, random_state=1))
    ema = int(c[0]) * trend.SCALE
    for k in range(1, 30):
        ema += (int(c[k]) * trend.SCALE - ema) * 2 // 21
    assert out.ema20[30] == ema and out.ema20[:20].isna().all() and out.ema200[:200].isna().all()
    k = int(np.flatnonzero(out.swing_high.notna())[0])
    window = c[k - 5 : k] + 20
    assert out.swing_high[k] == window[2] == window.max()


def test_every_condition_has_one_name():
    names = [n for f in (*conditions.FAMILIES, "crossings") for n in conditions.names(DUCK, f)] + list(trend.trend_conditions()) + conditions.names_of_crossings(trend.TREND_SIDES)
    assert len(names) == len(set(names)) == 328
    assert {n for p in conditions.implied_pairs() for n in p} <= set(names)


def test_implications_hold(spark):
    from candlewright.plans.dialect import SPARK, run

    for family in ("day_levels", "patterns", "bar_shape"):
        known = conditions.names(SPARK, family)
        pairs = [(a, b) for a, b in conditions.implied_pairs() if a in known and b in known]
        broken = " + ".join(f"count_if({a} AND NOT {b})" for a, b in pairs)
        assert run(spark, "/root/testdata/sf0.001", f"SELECT {broken} AS n FROM ({conditions.wide(SPARK, family)}) w").first().n == 0


def test_statistics():
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (120, 6))
    x[:, 2] += 1.0
    idx = statistics.draws(120, 99, 10, 4)
    p = statistics.stepdown(x, idx)
    assert p[2] == p.min() <= 0.02 and statistics.reality_check(x, idx) <= 0.05 and statistics.superior_predictive_ability(x, idx) <= 0.05
    assert statistics.reality_check(x, idx[:0]) == 1.0
    with pytest.raises(ValueError):
        statistics.stepdown(np.ones((5, 2)), idx[:, :5] % 5)
    assert statistics.SplitMix64(0).next() == 0xE220A8397B1DCDAF
    for test, train in statistics.purged_folds(100, 4, 5):
        assert all(min(abs(i - test.start), abs(i - test.stop + 1)) >= 5 for r in train for i in r)


def test_overlap_corrected_t(spark):
    from candlewright.operators import outcomes
    from candlewright.plans.dialect import SPARK, run

    sf, h, step = "/root/testdata/sf0.01", 4, 3_600_000_000
    chosen = ["close_above_pdh", "gap_up_day"]
    got = {r.condition: r for r in run(spark, sf, outcomes.edges(SPARK, "day_levels", chosen, 60, h)).collect()}
    hit = run(spark, sf, f"SELECT x.condition, x.series, x.us, f.ret FROM ({outcomes.hits(SPARK, 'day_levels', chosen)}) x JOIN ({outcomes.forward(SPARK, 60, h)}) f ON x.series = f.series AND x.us = f.us WHERE f.ret IS NOT NULL").toPandas()
    for name, rows in hit.groupby("condition"):
        x, us, series = rows.ret.to_numpy(float), rows.us.to_numpy(), rows.series.to_numpy()
        mean, total = x.mean(), ((x - x.mean()) ** 2).sum()
        for i in range(len(x)):
            near = (series == series[i]) & (us > us[i]) & (us < us[i] + h * step)
            total += 2 * ((1 - (us[near] - us[i]) / (h * step)) * (x[near] - mean) * (x[i] - mean)).sum()
        want = mean / np.sqrt(total / (len(x) - 1) / len(x)) if total > 1e-9 else None
        assert got[name].n == len(x) and (want is None or abs(got[name].t - want) < 1e-5)


def test_scalar_statistics():
    assert abs(statistics.two_sided_p(1.959963985) - 0.05) < 1e-8
    assert abs(statistics.upper_quantile(0.025) - 1.959963985) < 1e-6
    draws = np.random.default_rng(5).normal(size=(4000, 100)).max(axis=1).mean()
    assert abs(statistics.expected_max(100) - draws) < 0.05 and statistics.expected_max(1) == 0.0
    assert statistics.bonferroni_t(1) < statistics.bonferroni_t(1000)
    assert statistics.effective_trials([{"k": 1, "survivors": 5, "candidates": 10}, {"k": 2, "survivors": 0}], 4) == 11
    assert statistics.anchored_splits(20, 10, 4, 2) == [(range(0, 10), range(12, 16)), (range(0, 14), range(16, 20))]
    assert statistics.rolling_splits(20, 10, 4, 2)[1] == (range(4, 14), range(16, 20))
    assert statistics.alpha_share(1, 0) == (1, 48)


def test_implied_volatility_round_trip(spark):
    spot, vols = 100.0, [0.1, 0.35, 1.2]
    rows = [(spot, k, 0.5, 0.05, float(finance.price_one(np.array([spot]), np.array([k]), np.array([0.5]), np.array([0.05]), np.array([v]), np.array([c]))[0]), c, v) for k in (80.0, 100.0, 120.0) for v in vols for c in (True, False)]
    rows += [(spot, 100.0, 0.5, 0.05, 200.0, True, None), (None, 100.0, 0.5, 0.05, 5.0, True, None)]
    out = finance.implied_volatility(spark.createDataFrame(rows, "spot double, strike double, years double, rate double, price double, call boolean, want double")).toPandas()
    good = out[out.want.notna() & ~out.refused]
    assert (abs(good.implied - good.want) < 1e-3).all() and len(good) >= 16 and out[out.want.isna()].refused.all()


def test_readers(spark, tmp_path):
    df = spark.createDataFrame([("US0378331005",), ("US0378331006",), ("bad",)], "i string")
    assert [r.ok for r in df.select(files.isin_ok(F.col("i")).alias("ok")).collect()] == [True, False, False]
    c = spark.createDataFrame([("NSE-NIFTY-20240627-22000-CE",), ("NSE-NIFTY",), ("x",)], "n string").select(files.contract_of(F.col("n")).alias("c")).select("c.*").collect()
    assert (c[0].kind, c[0].strike, c[0].side, c[1].kind, c[2].kind) == ("option", 22000, "CE", "cash", None)
    p = tmp_path / "a.csv"
    p.write_text("20221003,09:15:01,0.95,1,518600\n20221003,09:15:02,x,1,5\n")
    rows = files.read_csv(spark, str(p), "quote").collect()
    assert rows[0].price == 0.95 and rows[0].rejected is None and rows[1].rejected
    arrays = spark.createDataFrame([("s", [1, 2], [1.0, 2.0], [1.0, 2.0], [1.0, 2.0], [1.0, 2.0], [5, 6]), ("t", [1], [1.0, 2.0], [1.0], [1.0], [1.0], [5])], "series string, timestamp array<long>, open array<double>, high array<double>, low array<double>, close array<double>, volume array<long>")
    assert sorted((r.series, r.refused) for r in files.parallel_arrays(arrays).collect()) == [("s", False), ("s", False), ("t", True)]
    with pytest.raises(ValueError):
        files.layout(df.schema)
    prices = spark.createDataFrame([(1.005,), (float("nan"),), (float("inf"),)], "x double").select(files.paisa(F.col("x")).alias("p")).collect()
    assert [r.p for r in prices] == [100, None, None] or [r.p for r in prices] == [101, None, None]


def test_streams(spark, tmp_path):
    rows = [("s", 1_000_000 * k * 60, k, 100 + k) for k in range(300)]
    ticks = spark.createDataFrame(rows, "series string, us long, event_id long, px long").withColumn("ts", F.timestamp_micros("us"))
    ticks.write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in"))
    q = stream.stream_bars(live).writeStream.outputMode("append").format("memory").queryName("bars_out").start()
    q.processAllAvailable()
    q.stop()
    out = spark.table("bars_out").collect()
    assert out and all(r.h == r.c and r.l == r.o for r in out)
    late = spark.createDataFrame([("s", 5, 1, 1), ("s", 4, 2, 1), ("s", 9, 3, 1)], "series string, us long, event_id long, px long")
    late.write.parquet(str(tmp_path / "late"))
    q = stream.refuse_late(spark.readStream.schema(late.schema).parquet(str(tmp_path / "late"))).writeStream.outputMode("update").format("memory").queryName("late_out").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.offered, r.refused) for r in spark.table("late_out").collect()] == [(3, 1)]


def test_halted_ladder_is_refused():
    import pytest

    from candlewright.operators import mining

    assert mining.finished(("sets", [{"k": 1, "survivors": 3}])) == "sets"
    with pytest.raises(RuntimeError):
        mining.finished(("sets", [{"k": 1, "survivors": 3}, {"k": 2, "halted": True, "candidates": 9}]))

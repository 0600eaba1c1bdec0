"""Every query of the library by name, with the SQL it is compared with."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from candlewright.functions import finance, statistics
from candlewright.operators import conditions, expressions, market, mining, outcomes, portfolio, research, series, stores, trades, trend
from candlewright.plans.dialect import DUCK, SPARK, Dialect, duck, run
from candlewright.sources import bars
from candlewright.streaming import bars as streams


def plans() -> dict[str, Callable[[Dialect], str]]:
    """Queries that are plain SQL: the text in either dialect."""
    out: dict[str, Callable[[Dialect], str]] = {}
    for m in (1, 5, 15, 60, 1440):
        out[f"bars_{m}m"] = lambda d, m=m: bars.bars(d, m)
    for f in (*conditions.FAMILIES, "crossings"):
        out[f"conditions_{f}"] = lambda d, f=f: conditions.bits(d, f)
        out[f"support_{f}"] = lambda d, f=f: conditions.support(d, f)
    out |= {
        "bar_census": series.census, "events_out_of_order": series.out_of_order, "bar_gaps": series.gaps, "complete_buckets": series.complete, "refold_audit": series.refold_audit, "resample_midnight": series.resample_midnight,
        "page_by_high": series.page, "page_by_time": lambda d: series.page(d, "us", False), "extremes": series.extremes, "coverage": series.coverage, "sessions": series.sessions, "as_of_levels": series.as_of_levels, "price_series": series.price_series, "bar_digests": series.digests, "without_gap_days": series.without_gap_days,
    }
    edge = lambda d: outcomes.edges(d, *CHOSEN)
    out |= {"forward": outcomes.forward, "mine_edges": edge, "lenses": lambda d: outcomes.lenses(d, edge(d)), "composite": lambda d: outcomes.composite(d, trades.totals(d, *CHOSEN)), "significance": lambda d: outcomes.significance(d, edge(d))}
    out["excursion_ladder"] = lambda d: outcomes.excursion_ladder(d, *CHOSEN)
    for k in (1, 2, 3):
        out[f"mine_sets_{k}"] = lambda d, k=k: mining.sets_sql(d, *CHOSEN, k, 40)
    for n, f in (("candle_stop", trades.candle_stop), ("exit_grid", trades.exit_grid), ("drawdown", trades.drawdown), ("streaks", trades.streaks), ("stability", trades.stability), ("trade_periods", trades.trade_periods), ("pooled", trades.pooled), ("consistency", trades.consistency), ("trade_signals", trades.signals)):
        out[n] = lambda d, f=f: f(d, *CHOSEN)
    for n in ("summary", "verdicts", "pool_order", "comparison", "placement", "trailing", "stamped"):
        out[f"strategy_{n}"] = lambda d, n=n: getattr(portfolio, n)(d, *CHOSEN)
    out |= {"square_off": bars.square_off, "forward_minutes": lambda d: outcomes.forward(d, 1, 3)}
    out |= {n: getattr(market, n) for n in ("calendar", "observed_calendar", "months_short", "minute_ledger", "landed", "land_census", "overlay", "vocabulary", "tenor_work", "constituents", "scrubbed", "as_json", "gaps_page", "synthetic", "open_interest", "repair", "vendor_membership", "page_census", "implications", "alpha_shares")}
    out |= {n: lambda d, n=n: getattr(market, n)(d, *CHOSEN) for n in ("masks", "mask_sets", "union_of_tops")}
    out |= {n: lambda d, n=n: getattr(research, n)(d, *CHOSEN) for n in ("walk_forward", "purged", "admission", "report", "frontier_page", "candidate_trades_page", "trades_page")}
    out |= {f"page_by_{n}": lambda d, n=n, c=c: series.page(d, c, n not in ("open", "low")) for n, c in (("open", "o"), ("low", "l"), ("close", "c"), ("volume", "v"), ("change", "change"))}
    out |= {"aligned": portfolio.aligned, "resolved_names": portfolio.resolved_names}
    out |= {"trip_charges": lambda d: finance.charges(d, finance.trips(d)), "greeks": lambda d: finance.greeks(d, finance.options(d)), "strikes": finance.strikes, "contracts": finance.contracts}
    out |= reference_queries()
    out["expressions"] = lambda d: expressions.summary(d, "day_levels", EXPRESSIONS)
    out["expression_search"] = lambda d: expressions.search(d, *CHOSEN, 3, 60)
    out["mine_closed_pairs"] = lambda d: mining.closed_sql(d, *CHOSEN, 40)
    return out


#: The family and the conditions that the mining queries run over.
CHOSEN = ("day_levels", ["close_above_pdh", "close_below_pdl", "gap_up_day", "gap_down_day", "inside_cpr", "above_cpr_tc", "below_cpr_bc", "close_above_pivot_r1_band", "close_below_pivot_s1_band", "inside_day"])


def reference_queries() -> dict[str, Callable[[Dialect], str]]:
    """Dimension joins, catalogue pages and page parsing over the driver's tables."""
    link = "href=\"([^\"]+)\""
    links = lambda d: f"regexp_extract_all(html, '{link}', 1)"
    return {
        "link_census": lambda d: f"SELECT page_id, CAST({'size' if d.spark else 'len'}({links(d)}) AS BIGINT) AS links, CAST(length(html) AS BIGINT) AS chars FROM {{pages}}",
        "catalog_search": lambda d: "SELECT p_partkey, p_name FROM {part} WHERE p_name LIKE '%a%' ORDER BY p_name, p_partkey LIMIT 50 OFFSET 10",
        "coverage_of_targets": lambda d: "SELECT n.n_name, r.r_name, count(c.c_custkey) AS held, count(CASE WHEN c.c_acctbal < 0 THEN 1 END) AS short FROM {nation} n JOIN {region} r ON n.n_regionkey = r.r_regionkey LEFT JOIN {customer} c ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name, r.r_name",
        "work_list": lambda d: "SELECT p_partkey FROM {part} EXCEPT SELECT l_partkey FROM {lineitem} WHERE l_quantity > 40 AND l_discount < 0.05",
        "event_props": lambda d: "SELECT event_type, count(*) AS n, CAST(sum(CAST(" + ("get_json_object(props, '$.k')" if d.spark else "json_extract_string(props, '$.k')") + " AS BIGINT)) AS BIGINT) AS k FROM {events} GROUP BY event_type",
        "run_identity": lambda d: "SELECT event_type, " + ("sha2(concat_ws('|', event_type, CAST(count(*) AS STRING), CAST(min(event_id) AS STRING)), 256)" if d.spark else "sha256(concat_ws('|', event_type, CAST(count(*) AS VARCHAR), CAST(min(event_id) AS VARCHAR)))") + " AS identity FROM {events} GROUP BY event_type",
    }


#: Expressions of the summary query.
EXPRESSIONS = {
    "breakout": "close_above_pdh AND NOT gap_up_day",
    "either": "inside_cpr OR (close_above_pdh AND close_above_pivot_r1_band)",
    "unknowable": "NOT (close_above_pdh OR close_below_pdh) AND NOT NOT gap_down_day",
}


def frequent(spark: SparkSession, sf_dir: str, least: int = 40) -> DataFrame:
    """All frequent sets of the chosen conditions; an error if the ladder halts."""
    return mining.finished(mining.ladder(run(spark, sf_dir, f"SELECT concat_ws('/', series, us) AS bar, condition AS item FROM ({outcomes.hits(SPARK, *CHOSEN)}) h"), least))


def folds() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    """Queries with ordered folds in them, and their SQL where a recursive query can say the same."""
    bits = "concat(" + ", ".join(f"CASE WHEN {e} THEN '1' WHEN NOT {e} THEN '0' ELSE '-' END" for e in trend.trend_conditions().values()) + ") AS bits"
    crossed = conditions.crossings(SPARK, "{states}", "series, us, day", trend.TREND_SIDES)
    return {
        "ema20": (lambda s, d: trend.states(s, d).selectExpr("series", "us", "ema20 AS ema"), trend.ema_sql(DUCK)),
        "ema200": (lambda s, d: trend.states(s, d).selectExpr("series", "us", "ema200 AS ema"), trend.ema_sql(DUCK, 200)),
        "conditions_trend": (lambda s, d: trend.states(s, d).selectExpr("series", "us", bits), f"SELECT series, us, {bits} FROM ({trend.states_sql()}) s"),
        "crossings_trend": (lambda s, d: s.sql(crossed.replace("({states})", "{states}"), states=trend.states(s, d)), conditions.crossings(DUCK, trend.states_sql(), "series, us, day", trend.TREND_SIDES)),
        "resampling_tests": (lambda s, d: statistics.resampling_tests(run(s, d, f"SELECT condition AS strategy, day AS period, CAST(sum(pnl) AS DOUBLE) AS ret FROM ({trades.priced(SPARK, *CHOSEN)}) p GROUP BY condition, day")).selectExpr("strategy", "round(adjusted_p, 9) AS adjusted_p", "round(reality_p, 9) AS reality_p", "round(superior_p, 9) AS superior_p"), statistics.resampling_sql(f"SELECT condition AS strategy, day AS period, CAST(sum(pnl) AS DOUBLE) AS ret FROM ({trades.priced(DUCK, *CHOSEN)}) p GROUP BY condition, day")),
        "implied_volatility": (lambda s, d: finance.implied_volatility(run(s, d, f"SELECT o.*, g.price FROM ({finance.options(SPARK)}) o JOIN ({finance.greeks(SPARK, finance.options(SPARK))}) g ON o.option_id = g.option_id")).selectExpr("option_id", "vol", "round(implied, 4) AS implied", "refused"), finance.implied_sql(DUCK, f"SELECT o.*, g.price FROM ({finance.options(DUCK)}) o JOIN ({finance.greeks(DUCK, finance.options(DUCK))}) g ON o.option_id = g.option_id")),
        "mine_ladder": (lambda s, d: frequent(s, d).selectExpr("k", "array_join(items, ',') AS items", "hits"), f"WITH {mining.subsets_sql(*CHOSEN, 40)} SELECT k, items, hits FROM sets"),
        "mine_all": (mining.mine_all, mining.mine_all_sql()),
        "best_by_hits": (lambda s, d: mining.best_by_hits(frequent(s, d), 12), f"WITH {mining.subsets_sql(*CHOSEN, 40)} SELECT k, items, hits FROM sets ORDER BY hits DESC, items DESC LIMIT 12"),
        "closed_sets": (lambda s, d: mining.closed(frequent(s, d)).selectExpr("k", "array_join(items, ',') AS items", "hits"), f"WITH {mining.subsets_sql(*CHOSEN, 40)} SELECT k, items, hits FROM sets a WHERE NOT EXISTS (SELECT 1 FROM sets b WHERE b.k = a.k + 1 AND b.hits = a.hits AND (a.mask & b.mask) = a.mask)"),
        "set_edges": (lambda s, d: mining.edges_of_sets(s, d, *CHOSEN, 40)[1], f"WITH {mining.subsets_sql(*CHOSEN, 40)} SELECT * FROM ({outcomes.edges_of(DUCK, 'SELECT s.items AS condition, x.series, x.us FROM sets s JOIN x ON (x.mask & s.mask) = s.mask')}) e"),
        "rank_sets": (lambda s, d: mining.ranked_sets(s, d, *CHOSEN, 40), mining.ranked_sql(*CHOSEN, 40)),
        "ladder_account": (lambda s, d: research.account(s, d, *CHOSEN, 40), research.account_sql(*CHOSEN, 40)),
        "trials": (lambda s, d: research.trials(s, d, *CHOSEN, 40), research.trials_sql(*CHOSEN, 40)),
        "expression_walk": (lambda s, d: research.expression_walk(s, d, "day_levels", EXPRESSIONS), research.expression_walk_sql(DUCK, "day_levels", EXPRESSIONS)),
        "option_pricing": (market.option_pricing, market.option_pricing_sql()),
        "archive_round_trip": (stores.archive_round_trip, stores.archive_sql()),
        "archive_report": (stores.archive_report, stores.archive_report_sql()),
        "vendor_files": (stores.vendor_files, stores.vendor_files_sql()),
        "broker_arrays": (stores.broker_arrays, stores.broker_arrays_sql()),
        "store_walk": (stores.store_walk, stores.store_walk_sql()),
        "manifest": (stores.manifest, stores.MANIFEST_SQL),
        "masters": (stores.masters, stores.MASTERS_SQL),
        "contract_names": (stores.contract_names, stores.CONTRACTS_SQL),
        "codes": (stores.codes, stores.CODES_SQL),
        "result_sink": (stores.result_sink, stores.result_sink_sql()),
        "stream_bars": (streams.replay, streams.replay_sql(DUCK)),
        "stream_sessions": (streams.evaluated, streams.evaluated_sql(DUCK)),
        "stream_progress": (streams.progress, streams.progress_sql(DUCK)),
        "scheduled": (lambda s, d: portfolio.scheduled(s, d, *CHOSEN), portfolio.scheduled_sql(DUCK, *CHOSEN)),
        "trade_walk": (lambda s, d: trades.walk(s, d, *CHOSEN), trades.walk_sql(DUCK, *CHOSEN)),
    }


def _query(make: Callable[[Dialect], str], spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, make(SPARK))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: partial(_query, make) for name, make in plans().items()} | {name: q for name, (q, _) in folds().items()}


def separate() -> dict[str, str]:
    """SQL of plans that is written apart from them, in another form."""
    return {"forward": outcomes.forward_sql(), "forward_minutes": outcomes.forward_sql(1, 3), "minute_ledger": market.minute_ledger_sql(), "land_census": market.land_census_sql(), "mask_sets": market.mask_sets_sql(*CHOSEN), "open_interest": market.open_interest_sql(), "repair": market.repair_sql(), "vendor_membership": market.VENDORS_SQL, "alpha_shares": market.alpha_sql(), "drawdown": trades.drawdown_sql(DUCK, *CHOSEN), "streaks": trades.streaks_sql(DUCK, *CHOSEN), "excursion_ladder": outcomes.excursion_sql(*CHOSEN)}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars from events, ten conditions, their edge over forward outcomes. The run is warm after five sessions here: the
    smallest scale has fewer than two hundred bars a series."""
    return run(spark, sf_dir, outcomes.edges(SPARK, *CHOSEN, warm="session > 5"))


def oracle_sql() -> dict[str, str]:
    return {name: duck(make(DUCK)) for name, make in plans().items()} | {name: duck(text) for name, text in separate().items()} | {name: duck(text) for name, (_, text) in folds().items() if text}

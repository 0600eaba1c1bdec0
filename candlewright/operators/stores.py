"""Archives, vendor files, stores, manifests, masters and result tables: written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlewright.plans.dialect import DUCK, SPARK, run
from candlewright.plans.storage import shared
from candlewright.sources import files
from candlewright.sources.bars import bars, ticks


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that executors share; whoever reads its rows last may delete it."""
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def archive_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars in rupees as a cash archive, read back as whole paisa, with a damaged row for every hundredth bar: what
    it is refused for."""
    path = folder(spark, "archive")
    rupees = lambda c: (F.col(c) / 100.0).alias({"o": "open", "h": "high", "l": "low", "c": "close"}[c])
    rows = run(spark, sf_dir, bars(SPARK, 60))
    spoilt = F.expr("us div 3600000000 % 100 = 0")
    high = F.when(spoilt, F.lit(float("nan"))).otherwise(F.col("h") / 100.0).alias("high")
    stamped = rows.select(F.timestamp_micros("us").alias("timestamp"), rupees("o"), high, rupees("l"), rupees("c"), F.col("v").alias("volume"), F.lit(None).cast("long").alias("open_interest"))
    stamped.write.mode("overwrite").parquet(path)
    return files.read_archive(spark, path).select(F.unix_micros("timestamp").alias("us"), "open", "high", "low", "close", "volume", "reason")


def archive_sql() -> str:
    bad = "us // 3600000000 % 100 = 0"
    return f"SELECT us, o AS open, CASE WHEN NOT ({bad}) THEN h END AS high, l AS low, c AS close, v AS volume, CASE WHEN {bad} THEN 'price' ELSE 'ok' END AS reason FROM ({bars(DUCK, 60)}) b"


def archive_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an archive directory by what became of them, and in all."""
    read = archive_round_trip(spark, sf_dir)
    counts = read.groupBy("reason").agg(F.count("*").alias("n"))
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0))))  # a handful of rows


def archive_report_sql() -> str:
    return f"SELECT reason, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM ({archive_sql()}) a GROUP BY reason"


def vendor_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as text files in each vendor's layout, read back: rows and sums of prices by layout, and rows refused."""
    rows = run(spark, sf_dir, ticks(SPARK))
    at = F.timestamp_micros("us")
    compact, slashed, time = F.date_format(at, "yyyyMMdd"), F.date_format(at, "dd/MM/yyyy"), F.date_format(at, "HH:mm:ss")
    price, name = (F.col("px") / 100.0).cast("decimal(18,2)").cast("string"), F.col("series")
    bad = F.when(F.pmod("event_id", F.lit(97)) == 0, F.lit("n/a"))
    text = lambda *cols: rows.select(F.concat_ws(",", *cols).alias("value"))
    made = {
        "quote": text(compact, time, F.coalesce(bad, price), F.lit("1"), F.lit("0")), "contract": text(compact, time, F.coalesce(bad, price), F.lit("1"), F.lit("0")),
        "bar9": text(name, compact, time, price, price, price, F.coalesce(bad, price), F.lit("1"), F.lit("0")), "depth10": text(name, slashed, time, F.coalesce(bad, price), price, F.lit("1"), price, F.lit("1"), F.lit("1"), F.lit("0")),
    }
    out = None
    for kind, lines in made.items():
        path = folder(spark, kind)
        lines.write.mode("overwrite").text(path)
        column = {"bar9": "close", "depth10": "ltp"}.get(kind, "price")
        day = F.to_date("date", "dd/MM/yyyy" if kind == "depth10" else "yyyyMMdd")
        read = files.read_csv(spark, path, kind).select(F.lit(kind).alias("layout"), F.col("rejected").isNotNull().alias("refused"), files.paisa(F.col(column)).alias("px"), day.alias("day"))
        out = read if out is None else out.unionByName(read)
    return out.groupBy("layout", "refused").agg(F.count("*").alias("n"), F.sum(F.when(~F.col("refused"), F.col("px"))).alias("paisa"), F.count_distinct("day").alias("days"))


def vendor_files_sql() -> str:
    layouts = " UNION ALL ".join(f"SELECT '{k}' AS layout" for k in ("quote", "contract", "bar9", "depth10"))
    return f"""SELECT layout, event_id % 97 = 0 AS refused, count(*) AS n, CAST(sum(CASE WHEN event_id % 97 <> 0 THEN px END) AS BIGINT) AS paisa, count(DISTINCT us // 86400000000) AS days
FROM ({ticks(DUCK)}) t JOIN ({layouts}) l ON 1 = 1 GROUP BY ALL"""


def broker_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars as a broker's parallel arrays by day, some of them a value short: rows by series, and days refused."""
    rows = run(spark, sf_dir, f"SELECT series, us, o, h, l, c, v, us div 86400000000 AS day FROM ({bars(SPARK, 60)}) b")
    made = rows.groupBy("series", "day").agg(F.array_sort(F.collect_list(F.struct("us", "o", "h", "l", "c", "v"))).alias("b"))
    of = lambda c: F.transform("b", lambda x: x[c])
    short = F.when(F.pmod("day", F.lit(7)) == 0, F.slice(of("c"), F.lit(2), F.size("b"))).otherwise(of("c"))
    arrays = made.select("series", of("us").alias("timestamp"), of("o").alias("open"), of("h").alias("high"), of("l").alias("low"), short.alias("close"), of("v").alias("volume"))
    return files.parallel_arrays(arrays).groupBy("series", "refused").agg(F.count("*").alias("n"), F.sum("close").alias("closes"))


def broker_arrays_sql() -> str:
    b = f"SELECT series, us // 86400000000 AS day, c FROM ({bars(DUCK, 60)}) b"
    return f"SELECT series, false AS refused, count(*) AS n, CAST(sum(c) AS BIGINT) AS closes FROM ({b}) x WHERE day % 7 <> 0 GROUP BY series UNION ALL SELECT series, true, count(DISTINCT day), NULL FROM ({b}) x WHERE day % 7 = 0 GROUP BY series"


def store_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars appended to a partitioned store in two parts, and what a walk of the store finds in each partition."""
    path = folder(spark, "store")
    keys = {"vendor": F.lit("sim"), "exchange": F.lit("NSE"), "segment": F.lit("cash"), "symbol": F.col("series"), "timeframe": F.lit("60m")}
    rows = run(spark, sf_dir, bars(SPARK, 60)).select(F.timestamp_micros("us").alias("timestamp"), "o", "h", "l", "c", "v", *[v.alias(k) for k, v in keys.items()])
    for part in (0, 1):
        files.write_bars(rows.where(F.pmod(F.unix_micros("timestamp") / 3_600_000_000, F.lit(2)).cast("int") == part), path)
    store = spark.read.parquet(path)
    return store.groupBy("symbol", "timeframe", F.col("month").cast("string").alias("month")).agg(F.count("*").alias("bars"), F.min(F.unix_micros("timestamp")).alias("first_us"), F.max(F.unix_micros("timestamp")).alias("last_us"), F.sum("v").alias("volume"))


def store_walk_sql() -> str:
    return f"SELECT series AS symbol, '60m' AS timeframe, strftime(make_timestamp(us), '%Y-%m') AS month, count(*) AS bars, min(us) AS first_us, max(us) AS last_us, CAST(sum(v) AS BIGINT) AS volume FROM ({bars(DUCK, 60)}) b GROUP BY ALL"


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as entries of an append-only manifest by status and customer: the newest of each."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    entries = orders.select(F.col("o_orderstatus").alias("vendor"), F.col("o_custkey").alias("key"), F.round("o_totalprice").cast("long").alias("rows"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("recorded_at"), F.col("o_orderkey").alias("sequence"))
    return files.latest_entries(entries)


MANIFEST_SQL = """SELECT vendor, key, rows, recorded_at, sequence FROM (SELECT o_orderstatus AS vendor, o_custkey AS key, CAST(round(o_totalprice) AS BIGINT) AS rows, strftime(o_orderdate, '%Y-%m-%d') AS recorded_at, o_orderkey AS sequence,
  row_number() OVER (PARTITION BY o_orderstatus, o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders) r WHERE place = 1"""


def masters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two vendors' masters made of the suppliers, merged by exchange and code, with what they disagree on."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    code = F.format_string("INE%09d", "s_suppkey")
    entry = lambda tick, symbol: (F.lit("NSE").alias("exchange"), code.alias("isin"), symbol.alias("symbol"), tick.alias("tick"))
    tick = F.lit(5)
    left = s.where("s_suppkey % 5 <> 0").select(*entry(tick, F.col("s_name")))
    right = s.where("s_suppkey % 7 <> 0").select(*entry(F.when(F.col("s_suppkey") % 11 == 0, 1).otherwise(tick), F.when(F.col("s_suppkey") % 13 == 0, F.lower("s_name")).otherwise(F.col("s_name"))))
    return files.merge_masters(left, right).select("isin", "verdict")


MASTERS_SQL = """SELECT 'INE' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS isin, CASE WHEN s_suppkey % 7 = 0 THEN 'only_a' WHEN s_suppkey % 5 = 0 THEN 'only_b' WHEN s_suppkey % 11 = 0 THEN 'tick' WHEN s_suppkey % 13 = 0 THEN 'symbol' ELSE 'agree' END AS verdict
FROM supplier WHERE NOT (s_suppkey % 5 = 0 AND s_suppkey % 7 = 0)"""


def contract_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of contracts made of the parts, taken apart again."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("key"))
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("key") % 300).cast("int")), "yyyyMMdd")
    kind = F.col("key") % 4
    name = F.when(kind == 0, F.lit("NSE-NIFTY")).when(kind == 1, F.concat(F.lit("NSE-BANKNIFTY-"), day)).when(kind == 2, F.concat(F.lit("NSE-M&M-"), day, F.lit("-"), (F.col("key") * 50).cast("string"), F.lit("-CE"))).otherwise(F.concat(F.lit("nse_"), F.col("key").cast("string")))
    c = files.contract_of(name)
    return parts.select("key", c["underlying"].alias("underlying"), c["expiry"].cast("string").alias("expiry"), c["strike"].alias("strike"), c["side"].alias("side"), c["kind"].alias("kind"))


CONTRACTS_SQL = """SELECT p_partkey AS key, CASE k WHEN 0 THEN 'NIFTY' WHEN 1 THEN 'BANKNIFTY' WHEN 2 THEN 'M&M' END AS underlying, CASE WHEN k IN (1, 2) THEN CAST(DATE '2024-01-01' + CAST(p_partkey % 300 AS INTEGER) AS VARCHAR)[1:10] END AS expiry,
  CASE WHEN k = 2 THEN p_partkey * 50 END AS strike, CASE WHEN k = 2 THEN 'CE' END AS side, CASE k WHEN 0 THEN 'cash' WHEN 1 THEN 'future' WHEN 2 THEN 'option' END AS kind FROM (SELECT *, p_partkey % 4 AS k FROM part) p"""


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Security codes made of the suppliers with check digits from 0 to 9: which are right; and prices from text."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    code = F.concat(F.format_string("INE%08d", "s_suppkey"), (F.col("s_suppkey") % 10).cast("string"))
    text = F.when(F.col("s_suppkey") % 9 == 0, F.lit("1,2x")).otherwise(F.format_string("%.2f", "s_acctbal"))
    return s.select("s_suppkey", files.isin_ok(code).alias("ok"), files.paisa_of_text(text).alias("paisa"))


CODES_SQL = """WITH c AS (SELECT s_suppkey, s_acctbal, '181423' || substr('0' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0'), 2) || CAST(s_suppkey % 10 AS VARCHAR) AS t FROM supplier),
e AS (SELECT s_suppkey, s_acctbal, list_transform(range(1, length(t) + 1), lambda i: CASE WHEN (length(t) - i) % 2 = 0 THEN CAST(substr(t, i, 1) AS INTEGER) WHEN 2 * CAST(substr(t, i, 1) AS INTEGER) > 9 THEN 2 * CAST(substr(t, i, 1) AS INTEGER) - 9 ELSE 2 * CAST(substr(t, i, 1) AS INTEGER) END) AS v FROM c)
SELECT s_suppkey, list_sum(v) % 10 = 0 AS ok, CASE WHEN s_suppkey % 9 <> 0 THEN CAST(round(s_acctbal * 100) AS BIGINT) END AS paisa FROM e"""


def write_results(rows: DataFrame, path: str, run_id: str) -> None:
    """Append a run's rows under its identity. Rows without the run's own mark in `_done` were never committed."""
    rows.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(f"{path}/rows")
    rows.sparkSession.createDataFrame([(run_id,)], "run_id string").write.mode("append").parquet(f"{path}/done")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Rows of committed runs."""
    done = spark.read.parquet(f"{path}/done").distinct()
    return spark.read.parquet(f"{path}/rows").join(F.broadcast(done), "run_id")


def result_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supports of two families written as two runs, a third that fails before its commit, and what is read back."""
    from candlewright.operators import conditions

    path = folder(spark, "results")
    for family in ("bar_shape", "day_levels"):
        write_results(run(spark, sf_dir, conditions.support(SPARK, family)), path, family)
    run(spark, sf_dir, conditions.support(SPARK, "patterns")).withColumn("run_id", F.lit("broken")).write.mode("append").partitionBy("run_id").parquet(f"{path}/rows")
    return read_results(spark, path).select("run_id", "condition", "hits", "misses", "unknown")


def result_sink_sql() -> str:
    from candlewright.operators import conditions

    return " UNION ALL ".join(f"SELECT '{f}' AS run_id, condition, hits, misses, unknown FROM ({conditions.support(DUCK, f)}) s" for f in ("bar_shape", "day_levels"))

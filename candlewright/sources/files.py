"""Readers of archives, vendor files and pages: typed scans with refusals counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of the archive's two layouts.
CASH = (("timestamp", "timestamp"), ("open", "double"), ("high", "double"), ("low", "double"), ("close", "double"), ("volume", "bigint"), ("open_interest", "bigint"))
DERIVATIVE = CASH + tuple((n, "double") for n in ("iv", "delta", "gamma", "theta", "vega", "rho", "spot_at_bar", "t_years_used", "rate_used")) + (("greeks_provenance_id", "int"),)


def layout(schema: T.StructType) -> str:
    """cash or derivative, by name and type of every column; anything else is refused."""
    found = [(f.name, f.dataType.simpleString().removesuffix("_ntz")) for f in schema.fields]
    for name, wanted in (("cash", CASH), ("derivative", DERIVATIVE)):
        if found == list(wanted):
            return name
    raise ValueError(f"neither layout: {found}")


def paisa(x: Column) -> Column:
    """Rupees as whole paisa, half up; null for NaN, infinite or out-of-range values."""
    ok = ~F.isnan(x) & (F.abs(x) < 9e16)
    return F.when(ok, F.floor(x * 100 + 0.5).cast("long"))


def paisa_of_text(text: Column) -> Column:
    """Rupees written out, with a sign, commas between thousands and at most two decimals, as whole paisa; else null."""
    bare = F.regexp_replace(F.trim(text), ",", "")
    ok = F.trim(text).rlike(r"^[+-]?(?:[0-9]+|[0-9]{1,3}(?:,[0-9]{2,3})+)(?:[.][0-9]{1,2})?$")
    return F.when(ok, F.round(F.when(ok, bare).cast("decimal(20,2)") * 100).cast("long"))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Canonical bars of a parquet archive, with `reason` for rows that can't be used."""
    raw = spark.read.parquet(path)
    layout(raw.schema)
    out = raw.select("timestamp", *[paisa(F.col(c)).alias(c) for c in ("open", "high", "low", "close")], "volume", "open_interest")
    return out.withColumn("reason", F.when(F.col("timestamp").isNull(), "time").when(F.greatest(*[F.col(c).isNull() for c in ("open", "high", "low", "close")]), "price").when(F.col("high") < F.col("low"), "inverted").otherwise("ok"))


#: Columns of the vendors' text layouts.
CSV_LAYOUTS = {
    "quote": "date string, time string, price double, quantity long, open_interest long",
    "contract": "date string, time string, price double, quantity long, open_interest long",
    "bar9": "symbol string, date string, time string, open double, high double, low double, close double, volume long, open_interest long",
    "depth10": "ticker string, date string, time string, ltp double, buy_price double, buy_quantity long, sell_price double, sell_quantity long, quantity long, open_interest long",
}


def read_csv(spark: SparkSession, path: str, kind: str, header: bool = False) -> DataFrame:
    """A vendor's text file; rows that don't fit the layout keep their text in `rejected`."""
    schema = T._parse_datatype_string(CSV_LAYOUTS[kind]).add("rejected", "string")
    return spark.read.schema(schema).option("header", header).option("columnNameOfCorruptRecord", "rejected").option("mode", "PERMISSIVE").csv(path)


def parallel_arrays(rows: DataFrame) -> DataFrame:
    """Bars from a broker's parallel arrays (timestamp, open, high, low, close, volume); arrays of unequal length are one refused row."""
    names = ("timestamp", "open", "high", "low", "close", "volume")
    same = F.size(F.array_distinct(F.array(*[F.size(n) for n in names]))) == 1
    good = rows.where(same).select("series", F.explode(F.arrays_zip(*names)).alias("b")).select("series", *[F.col(f"b.{n}").alias(n) for n in names], F.lit(False).alias("refused"))
    bad = rows.where(~same | same.isNull()).select("series", *[F.lit(None).cast(good.schema[n].dataType).alias(n) for n in names], F.lit(True).alias("refused"))
    return good.unionByName(bad)


def write_bars(bars: DataFrame, path: str) -> None:
    """Append bars under vendor, exchange, segment, symbol, timeframe and month."""
    keys = ["vendor", "exchange", "segment", "symbol", "timeframe", "month"]
    bars.withColumn("month", F.date_format("timestamp", "yyyy-MM")).write.mode("append").partitionBy(*keys).parquet(path)


def contract_of(name: Column) -> Column:
    """Exchange, underlying, expiry, strike and side from a contract's file name, like NSE-NIFTY-20240627-22000-CE."""
    p = r"^([A-Z]+)-([A-Z0-9&]+)(?:-(\d{8})(?:-(\d+)-(CE|PE))?)?$"
    g = lambda i: F.nullif(F.regexp_extract(name, p, i), F.lit(""))
    kind = F.when(g(5).isNotNull(), "option").when(g(3).isNotNull(), "future").when(g(2).isNotNull(), "cash")
    return F.struct(g(1).alias("exchange"), g(2).alias("underlying"), F.to_date(g(3), "yyyyMMdd").alias("expiry"), g(4).cast("long").alias("strike"), g(5).alias("side"), kind.alias("kind"))


def isin_ok(code: Column) -> Column:
    """Whether an ISIN has its shape and check digit."""
    digits = F.array_join(F.transform(F.split(code, ""), lambda x: F.when(x.rlike("[0-9]"), x).otherwise((F.ascii(x) - 55).cast("string"))), "")
    return code.rlike("^[A-Z]{2}[A-Z0-9]{9}[0-9]$") & F.call_function("luhn_check", F.when(code.rlike("^[A-Z]{2}[A-Z0-9]{9}[0-9]$"), digits).otherwise(F.lit("1")))


def latest_entries(entries: DataFrame) -> DataFrame:
    """The newest entry of each (vendor, key) in an append-only manifest; ties by sequence."""
    return entries.groupBy("vendor", "key").agg(F.max_by(F.struct("rows", "recorded_at", "sequence"), F.struct("recorded_at", "sequence")).alias("e")).select("vendor", "key", "e.*")


def merge_masters(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two vendors' masters (exchange, isin, symbol, tick) by (exchange, isin), with a verdict on what disagrees."""
    a, b = (df.select("exchange", "isin", F.col("symbol").alias(f"symbol_{n}"), F.col("tick").alias(f"tick_{n}")) for df, n in ((left, "a"), (right, "b")))
    both = a.join(b, ["exchange", "isin"], "full_outer")
    verdict = F.when(F.col("symbol_b").isNull(), "only_a").when(F.col("symbol_a").isNull(), "only_b").when(F.col("tick_a") != F.col("tick_b"), "tick").when(F.col("symbol_a") != F.col("symbol_b"), "symbol").otherwise("agree")
    return both.withColumn("verdict", verdict)

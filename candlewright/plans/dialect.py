"""The few spots where Spark SQL and the comparison SQL differ, so that a plan is written once as text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")


@dataclass(frozen=True)
class Dialect:
    """Floor and truncating division, epoch time, ordered picks and a few functions in one of the two languages."""

    spark: bool

    def fdiv(self, a: str, b: str) -> str:
        """Division of whole numbers toward minus infinity."""
        if self.spark:
            return f"((({a}) - pmod({a}, {b})) div ({b}))"
        return f"((({a}) - (((({a}) % ({b})) + ({b})) % ({b}))) // ({b}))"

    def tdiv(self, a: str, b: str) -> str:
        """Division of whole numbers toward zero."""
        return f"(({a}) div ({b}))" if self.spark else f"(({a}) // ({b}))"

    def pmod(self, a: str, b: str) -> str:
        return f"pmod({a}, {b})" if self.spark else f"(((({a}) % ({b})) + ({b})) % ({b}))"

    def micros(self, ts: str) -> str:
        """Microseconds since 1970 of a timestamp without zone."""
        return f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})" if self.spark else f"epoch_us({ts})"

    def first(self, x: str, *by: str) -> str:
        return f"min_by({x}, struct({', '.join(by)}))" if self.spark else f"arg_min({x}, row({', '.join(by)}))"

    def last(self, x: str, *by: str) -> str:
        return f"max_by({x}, struct({', '.join(by)}))" if self.spark else f"arg_max({x}, row({', '.join(by)}))"

    def last_known(self, x: str, over: str) -> str:
        return f"last({x}, true) OVER ({over})" if self.spark else f"last_value({x} IGNORE NULLS) OVER ({over})"

    def wide(self, x: str) -> str:
        """A whole number of up to 38 digits."""
        return f"CAST({x} AS DECIMAL(38, 0))" if self.spark else f"CAST({x} AS HUGEINT)"

    def isqrt(self, x: str) -> str:
        """Whole square root of a number up to 2^100 or so: the double's root, corrected by one either way."""
        r = f"CAST(floor(sqrt(CAST({x} AS DOUBLE))) AS {'DECIMAL(19, 0)' if self.spark else 'HUGEINT'})"
        return f"(CASE WHEN {r} * {r} > {x} THEN {r} - 1 WHEN ({r} + 1) * ({r} + 1) <= {x} THEN {r} + 1 ELSE {r} END)"

    def wdiv(self, a: str, b: str) -> str:
        """Floor division of wide numbers that aren't negative."""
        return f"(({a}) div ({b}))" if self.spark else f"(({a}) // ({b}))"

    def joined(self, x: str, order: str) -> str:
        if self.spark:
            return f"array_join(transform(array_sort(collect_list(struct({order}, {x} AS x))), s -> s.x), ',')"
        return f"string_agg({x}, ',' ORDER BY {order})"

    def date_of(self, day: str) -> str:
        """The date of a day number since 1970."""
        return f"date_add(DATE'1970-01-01', CAST({day} AS INT))" if self.spark else f"(DATE '1970-01-01' + CAST({day} AS INTEGER))"

    def day_number(self, date: str) -> str:
        return f"datediff({date}, DATE'1970-01-01')" if self.spark else f"date_diff('day', DATE '1970-01-01', {date})"

    def plus_days(self, date: str, days: str) -> str:
        return f"date_add({date}, CAST({days} AS INT))" if self.spark else f"CAST({date} + CAST({days} AS INTEGER) AS DATE)"

    def last_day(self, date: str) -> str:
        return f"last_day({date})"

    def each(self, first: str, last: str) -> str:
        """A row for each whole number from first to last, as a column of a SELECT."""
        return f"explode(sequence(CAST({first} AS BIGINT), CAST({last} AS BIGINT)))" if self.spark else f"unnest(range(CAST({first} AS BIGINT), CAST({last} AS BIGINT) + 1))"

    def text(self, x: str) -> str:
        return f"CAST({x} AS {'STRING' if self.spark else 'VARCHAR'})"

    def greatest0(self, x: str) -> str:
        return f"greatest({x}, 0)"


SPARK, DUCK = Dialect(True), Dialect(False)


def run(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A plan's text over the tables that it names in braces."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def duck(text: str) -> str:
    return text.format(**{t: t for t in TABLES})

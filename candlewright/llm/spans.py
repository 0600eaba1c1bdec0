"""Spans of regular expressions as DataFrame columns: code-point starts and ends of leftmost matches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,bstart:int,bend:int,hit:string,left:string,right:string>>"
#: Arrays up to this length are folded in one go; longer ones in chunks of their length's square root.
SHORT = 256
CONTEXT = 40


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def running(items: Column, zero: Column, value: Callable[[Column], Column], combine: Callable[[Column, Column], Column], kind: str) -> Column:
    """For each item, what the values of all items before it combine to; zero for the first.

    combine is associative. An array can only grow in a fold by being copied, so a long array is folded in chunks of
    its length's square root, and then the chunks' totals: n items cost some n * sqrt(n) copies of a pointer.
    """

    def short(part: Column, of: Callable[[Column], Column]) -> Column:
        start = F.struct(zero.alias("sum"), F.array().cast(f"array<{kind}>").alias("out"))
        step = lambda acc, x: F.struct(combine(acc["sum"], of(x)).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out"))
        return F.aggregate(part, start, step, lambda acc: acc["out"])

    def long(whole: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(whole))).cast("int")
        chunks = F.transform(F.sequence(F.lit(1), F.size(whole), step), lambda at: F.slice(whole, at, step))

        def joined(parts: Column) -> Column:
            totals = F.transform(parts, lambda p: F.aggregate(p, zero, lambda acc, x: combine(acc, value(x))))
            return F.flatten(F.zip_with(parts, short(totals, lambda t: t), lambda p, before: F.transform(short(p, value), lambda x: combine(before, x))))

        return bind(chunks, joined)

    return F.when(F.size(items) <= SHORT, short(items, value)).otherwise(long(items))


def spans(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None, context: bool = False) -> Column:
    """All leftmost non-overlapping matches of a Java pattern: start and end in code points, bstart and bend in bytes
    of UTF-8, ends exclusive, and the hit; with `context` what stands to its left (up to CONTEXT characters, as far as
    the match before) and the character to its right.

    The pieces between matches (split) and the matches themselves (regexp_extract_all) come from the same search, so
    running lengths give positions, and nothing is cut out of the text anew. `keep` drops matches; a dropped match still
    uses up its characters. A text without a match costs one search. Null text gives null.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    size = "struct<c:int,b:int>"
    of = lambda x: F.struct(F.length(x).alias("c"), F.octet_length(x).alias("b"))
    plus = lambda a, b: F.struct((a["c"] + b["c"]).alias("c"), (a["b"] + b["b"]).alias("b"))

    def placed(both: Column) -> Column:
        before = running(both, of(F.lit("")), lambda s: plus(of(s["gap"]), of(s["hit"])), plus, size)

        def one(s: Column, at: Column) -> Column:
            start, byte = at["c"] + F.length(s["gap"]), at["b"] + F.octet_length(s["gap"])
            sides = (F.right(s["gap"], F.lit(CONTEXT)), F.left(s["next"], F.lit(1))) if context else (F.lit(None), F.lit(None))
            return F.struct(start.alias("start"), (start + F.length(s["hit"])).alias("end"), byte.alias("bstart"), (byte + F.octet_length(s["hit"])).alias("bend"), s["hit"].alias("hit"), sides[0].alias("left"), sides[1].alias("right"))

        return F.zip_with(both, before, one).cast(SPAN)

    def pieces(found: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            n = F.size(found)
            sides = F.zip_with(F.slice(gaps, F.lit(1), n), F.slice(gaps, F.lit(2), n), lambda a, b: F.struct(a.alias("gap"), b.alias("next")))
            return F.zip_with(sides, found, lambda s, hit: F.struct(s["gap"].alias("gap"), s["next"].alias("next"), hit.alias("hit")))

        return bind(bind(F.split(text, pattern, -1), with_gaps), placed)

    out = F.when(text.rlike(pattern), bind(hits, pieces)).otherwise(F.when(text.isNotNull(), F.array().cast(SPAN)))
    return F.filter(out, lambda s: keep(s["hit"])) if keep else out


def named(kind: str, order: int, found: Column) -> Column:
    """Spans with their kind and its place in the list of kinds."""
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["bstart"].alias("bstart"), s["bend"].alias("bend")))


def joined(found: Column) -> Column:
    """kind:start:end of each span, comma-joined in the order given."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def replaced(text: Column, found: Column) -> Column:
    """The text with each span of `found` (in order of start) given as [kind]; spans that overlap are one, by the first
    one's kind. Pieces are cut by byte, so a cut doesn't walk the text."""

    def cut(raw: Column) -> Column:
        upto = running(found, F.lit(0), lambda s: s["bend"], lambda a, b: F.greatest(a, b), "int")
        heads = F.filter(F.zip_with(found, upto, lambda s, at: F.struct(s["kind"].alias("kind"), s["bstart"].alias("bstart"), at.alias("at"))), lambda s: s["bstart"] >= s["at"])
        pieces = F.transform(heads, lambda s: F.concat(F.substring(raw, s["at"] + 1, s["bstart"] - s["at"]).cast("string"), F.lit("["), s["kind"], F.lit("]")))
        end = F.array_max(F.transform(found, lambda s: s["bend"]))
        return F.concat(F.array_join(pieces, ""), F.substring(raw, end + 1, F.length(raw)).cast("string"))

    return F.when(F.size(found) > 0, bind(text.cast("binary"), cut)).otherwise(text)

"""Secret scans by a trigram inverted index, in DataFrame functions alone (operator 2)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewright.llm.common import Stash
from candlewright.llm.spans import joined, named, replaced, spans
from candlewright.llm.trigrams import ALL, query_of


@dataclass(frozen=True)
class Rule:
    """A kind of secret. `shortest` is the least length of group `group` of a match; shorter matches are dropped."""

    kind: str
    pattern: str
    group: int = 0
    shortest: int = 0
    base: bool = False


#: The kinds in their order; the first three are the base.
#: A run of 20 or 24 characters is asked for in the pattern itself where a shorter match could hide no longer one.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, base=True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)


KEY = ("doc_id", "__text")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, and the text: rows that agree in all of them hold the same trigrams."""
    return docs.select("doc_id", F.xxhash64("text").alias("__text"), "text")


def index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, doc_id, hash of the text) of the trigrams that some query asks for, over lower-cased whole
    texts. No other trigram is ever looked up, so no other is posted."""
    low = _keyed(docs).select(*KEY, F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.col("low").contains(t), F.lit(t)) for t in trigrams]))
    return low.select(*KEY, F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame | None:
    """doc_id, hash of the text, and the rules whose trigram query they meet; None if no rule has a query.

    The clauses of all queries are a table of at most a few hundred rows; postings meet them by trigram, and a clause
    holds for a document that is posted under all its trigrams. Texts that share a hash share postings: at worst that
    makes one a candidate too many.
    """
    clauses = [(r.kind, k, t, len(c)) for r in rules if (q := query_of(r.pattern)) != ALL for k, c in enumerate(sorted(q, key=sorted)) for t in sorted(c)]
    if not clauses:
        return None
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    table = docs.sparkSession.sql("SELECT * FROM VALUES " + ", ".join(f"({quote(r)}, {k}, {quote(t)}, {n})" for r, k, t, n in clauses) + " AS c(rule, clause, trigram, wants)")
    posts = index(docs, sorted({t for _, _, t, _ in clauses}))
    met = posts.join(F.broadcast(table), "trigram").groupBy(*KEY, "rule", "clause", "wants").agg(F.size(F.collect_set("trigram")).alias("n")).where("n >= wants")
    return met.groupBy(*KEY).agg(F.collect_set("rule").alias("rules"))


def scan(docs: DataFrame, stash: Stash, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with column `found`: spans of all rules as (start, order, end, kind, bstart, bend), by start and then by
    order.

    docs: doc_id, text and any other columns, which stay, whatever their names; only a column named `found` itself is
    replaced. A rule with a trigram query runs on its candidates alone, the others on every text. Candidates are a table
    of one row for each, so Spark broadcasts it where it is small, and splits a hot key's texts where it isn't. Null or
    empty text has no spans. Rows that repeat a doc_id, or have none, each have their own text verified; ties of start
    go by the rules' order. An empty table gives no rows.
    """
    posted = candidates(docs, rules)
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.xxhash64("text").alias("__text"), "text")
    if posted is None:
        rows = rows.withColumn("rules", F.lit(None).cast("array<string>"))
    else:
        posted = stash.put(posted, "candidates").withColumnsRenamed({"doc_id": "key", "__text": "hash"})
        rows = rows.join(posted, F.col("doc_id").eqNullSafe(F.col("key")) & (F.col("__text") == F.col("hash")), "left")
    text, parts = F.coalesce("text", F.lit("")), []
    for k, r in enumerate(rules):
        keep = (lambda hit, r=r: F.length(F.regexp_extract(hit, r.pattern, r.group)) >= r.shortest) if r.shortest else None
        found = named(r.kind, k, spans(text, r.pattern, keep))
        if query_of(r.pattern) != ALL:
            found = F.when(F.array_contains("rules", r.kind), found)
        parts.append(F.coalesce(found, F.array().cast("array<struct<start:int,order:int,end:int,kind:string,bstart:int,bend:int>>")))
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() != "found"]
    return rows.select(*kept, F.sort_array(F.concat(*parts)).alias("found"))


def redact(docs: DataFrame, stash: Stash, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every found secret replaced by [kind] in its text, and n_chars, if there, counted anew.

    Spans that overlap are one. Every row and column stays, whatever its name; texts without secrets stay as they are,
    null texts too.
    """
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    out = scan(rows, stash, rules).select("row", replaced(F.col("text"), F.col("found")).alias("text"))
    kinds = dict(docs.dtypes)
    of = {"text": F.col("text"), "n_chars": F.coalesce(F.length("text"), F.lit(0)).cast(kinds.get("n_chars", "long"))}
    return out.select(*[of.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, as counts, digest and spans."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), Stash(spark, "op2"))
    base = [r.kind for r in RULES if r.base]
    of = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    own = F.filter("found", lambda s: s["kind"].isin(base))
    return found.select("doc_id", *[of(k) for k in base], F.sha2(joined(own), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def _sql() -> str:
    """DuckDB SQL of op2_secrets."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for k, r in enumerate(RULES):
        test = f"length(regexp_extract(m[i], {quote(r.pattern)}, {r.group})) >= {r.shortest}" if r.shortest else "true"
        parts.append(
            f"SELECT id, doc_id, {k} AS ord, '{r.kind}' AS kind, CAST(coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS start, length(m[i]) AS len "
            f"FROM (SELECT id, doc_id, m, p, unnest(range(1, len(m) + 1)) AS i FROM (SELECT id, doc_id, regexp_extract_all(t, {quote(r.pattern)}, 0) AS m, string_split_regex(t, {quote(r.pattern)}) AS p FROM d)) WHERE {test}"
        )
    base = [r.kind for r in RULES if r.base]
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in base)
    each = "kind || ':' || start || ':' || (start + len)"
    listed = ", ".join(f"'{k}'" for k in base)
    return (
        "WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents), s AS (" + " UNION ALL ".join(parts) + "), "
        f"g AS (SELECT id, {counts}, sha256(coalesce(string_agg({each}, ',' ORDER BY start, ord) FILTER (kind IN ({listed})), '')) AS base_sha256, string_agg({each}, ',' ORDER BY start, ord) AS spans FROM s GROUP BY id) "
        "SELECT d.doc_id, " + ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in base) + ", coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (id)"
    )


SQL = _sql()

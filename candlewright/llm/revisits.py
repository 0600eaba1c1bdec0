"""Not-modified revisits of web captures, resolved by an as-of join (operator 8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlewright.llm.common import Stash

#: Headers that a not-modified answer may replace in the stored response (names in lower case).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "age", "warning", "set-cookie")
#: Query parameters that name no resource.
TRACKING = ("utm_[^=&]*", "ref", "fbclid", "gclid", "sessionid")


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, default port, fragment, tracking parameters, index page and trailing slash gone,
    http taken as https and parameters in order. Null stays null; what isn't an http address is only trimmed."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"^[A-Za-z]+://([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_extract(bare, r"^[A-Za-z]+://[^/?]*([^?]*)", 1)
    path = F.regexp_replace(F.regexp_replace(path, r"/index\.html?$", "/"), r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(?:" + "|".join(TRACKING) + ")(?:=|$)"))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(kept), "&"))).otherwise("")
    return F.when(bare.rlike(r"^(?i:https?)://"), F.concat(F.lit("https://"), host, path, query)).otherwise(bare)


def resolve(captures: DataFrame, stash: Stash) -> DataFrame:
    """Give each not-modified capture the body of the latest earlier full response of its canonical URL.

    captures: capture_id long, url, seen_at long (time), status int, etag, last_modified, headers map<string,string>;
    other columns are ignored, whatever their names. Returns capture_id, canonical, seen_at, status, response_id (the
    capture itself if full), outcome and headers:
      full        status 200, a full response;
      resolved    status 304, a revisit whose validators agree: an etag that both have must be equal (weak marks aside),
                  else a last_modified that both have;
      unvalidated a revisit where neither validator is on both sides; the latest response is given all the same;
      mismatch    a revisit of which a validator differs: no response_id;
      orphan      a revisit without an earlier full response, or with a null URL or time: no response_id;
      other       any other status or none: neither a response nor a revisit; no response_id.
    A resolved or unvalidated revisit's headers are the response's with the permitted ones replaced by its own; any other
    capture keeps its own headers.

    The as-of join has two steps, so that no URL gathers in one task: rows are ranged by (canonical URL, time,
    capture_id); the last full response of each range is carried to the URL's later ranges, of which there are at most
    as many as ranges, and stands there as a first row; within a range each row takes the last full response before it.
    Nothing is joined, and nothing broadcast. Ties of time go by capture_id: a smaller id is earlier. Repeated rows are
    kept. Null headers are taken as empty; an empty table gives no rows.
    """
    fields = ("capture_id", "etag", "last_modified", "headers")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    rows = captures.select("capture_id", canonical_url(F.col("url")).alias("canonical"), "seen_at", "status", "etag", "last_modified", F.coalesce("headers", none).alias("headers"))
    ranged = stash.put(rows.repartitionByRange("canonical", "seen_at", "capture_id").withColumn("part", F.spark_partition_id()), "ranged")
    full = (F.col("status") == 200) & F.col("canonical").isNotNull() & F.col("seen_at").isNotNull()
    own = ranged.select("*", F.when(full, F.struct(*fields)).alias("whole"), F.lit(1).alias("turn"))
    ends = own.groupBy("canonical", "part").agg(F.max_by("whole", F.when(full, F.struct("seen_at", "capture_id"))).alias("end"))
    before = F.last("end", ignorenulls=True).over(Window.partitionBy("canonical").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.where("canonical is not null").select("canonical", "part", before.alias("whole")).where("whole is not null").withColumn("turn", F.lit(0))
    near = Window.partitionBy("part", "canonical").orderBy("turn", "seen_at", "capture_id", F.desc("status")).rowsBetween(Window.unboundedPreceding, -1)
    found = own.unionByName(carried, allowMissingColumns=True).withColumn("full", F.last("whole", ignorenulls=True).over(near)).where("turn = 1")
    strong = lambda c: F.regexp_replace(c, "^W/", "")
    tags = strong(F.col("etag")) == strong(F.col("full.etag"))
    dates = F.col("last_modified") == F.col("full.last_modified")
    orphan = F.col("canonical").isNull() | F.col("seen_at").isNull() | F.col("full").isNull()
    outcome = F.when(F.col("status") == 200, "full").when(F.coalesce(F.col("status") != 304, F.lit(True)), "other").when(orphan, "orphan")
    outcome = outcome.when(tags.isNotNull(), F.when(tags, "resolved").otherwise("mismatch")).when(dates.isNotNull(), F.when(dates, "resolved").otherwise("mismatch")).otherwise("unvalidated")
    sent = F.map_filter("headers", lambda k, v: F.lower(k).isin(*PERMITTED))
    merged = F.map_concat(F.map_filter("full.headers", lambda k, v: ~F.array_contains(F.transform(F.map_keys(sent), F.lower), F.lower(k))), sent)
    taken = F.col("outcome").isin("resolved", "unvalidated")
    return found.withColumn("outcome", outcome).select(
        "capture_id", "canonical", "seen_at", "status", F.when(F.col("outcome") == "full", F.col("capture_id")).when(taken, F.col("full.capture_id")).alias("response_id"), "outcome", F.when(taken, merged).otherwise(F.col("headers")).alias("headers")
    )


def captures_of(pages: DataFrame) -> DataFrame:
    """Captures of the pages table, crawled in order of page_id: each page in full, and again by its canonical address.

    A page's own capture_id is 2 * page_id, at time page_id; the second one's is 2 * page_id + 1, 1,000,000 ticks later.
    The etag is the page's digest, the date its length. What the second capture is goes by page_id mod 9: 0 and 8 send
    the etag marked weak, 1 another etag, 2 the date alone, 3 another date alone, 4 no validator, 5 no time, 6 isn't
    found (404), and 7 comes before every page. Each sends a date, an expiry and a length of its own.
    """
    text = F.coalesce("html", F.lit(""))
    etag = F.concat(F.lit('"'), F.substring(F.md5(text), 1, 16), F.lit('"'))
    changed = F.length(text).cast("string")
    head = lambda *kv: F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in kv])
    page, kind = F.col("page_id"), F.pmod(F.col("page_id"), F.lit(9))
    full = pages.select((page * 2).alias("capture_id"), "url", page.alias("seen_at"), F.lit(200).alias("status"), etag.alias("etag"), changed.alias("last_modified"), head("Content-Type", "text/html", "Content-Length", changed, "Date", page.cast("string")).alias("headers"))
    time = F.when(kind == 5, None).when(kind == 7, -1 - page).otherwise(page + 1_000_000)
    tag = F.when(kind == 1, F.lit('"other"')).when(kind.isin(2, 3, 4), None).otherwise(F.concat(F.lit("W/"), etag))
    date = F.when(kind == 2, changed).when(kind == 3, F.lit("never"))
    again = pages.select((page * 2 + 1).alias("capture_id"), canonical_url(F.col("url")).alias("url"), time.alias("seen_at"), F.when(kind == 6, 404).otherwise(304).alias("status"), tag.alias("etag"), date.alias("last_modified"), head("Date", (page + 1_000_000).cast("string"), "Expires", "never", "Content-Length", "0").alias("headers"))
    return full.unionByName(again)


def op8_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of all pages with their revisits resolved."""
    out = resolve(captures_of(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")), Stash(spark, "op8"))
    sent = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws("=", F.lower(e["key"]), e["value"]))), ";")
    return out.select("capture_id", "canonical", "seen_at", "status", "response_id", "outcome", sent.alias("headers"))


#: DuckDB SQL of op8_revisits, by an as-of join.
SQL = r"""
WITH c AS (
  SELECT page_id, html, regexp_replace(trim(url), '#.*$', '') AS u FROM pages
), k AS (
  SELECT page_id, html, CASE WHEN regexp_matches(u, '^(?i:https?)://') THEN 'https://'
    || regexp_replace(regexp_replace(lower(regexp_extract(u, '^[A-Za-z]+://([^/?]*)', 1)), ':(80|443)$', ''), '^www\.', '')
    || regexp_replace(regexp_replace(regexp_extract(u, '^[A-Za-z]+://[^/?]*([^?]*)', 1), '/index\.html?$', '/'), '/+$', '')
    || (CASE WHEN len(q) > 0 THEN '?' || array_to_string(list_sort(q), '&') ELSE '' END) ELSE u END AS canonical
  FROM (SELECT *, list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(?:utm_[^=&]*|ref|fbclid|gclid|sessionid)(?:=|$)')) AS q FROM c)
), f AS (
  SELECT page_id, 2 * page_id AS capture_id, canonical, page_id AS seen_at, '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS etag, CAST(length(coalesce(html, '')) AS VARCHAR) AS n FROM k
), g AS (
  SELECT page_id % 9 AS kind, capture_id + 1 AS capture_id, canonical, CASE page_id % 9 WHEN 5 THEN NULL WHEN 7 THEN -1 - page_id ELSE seen_at + 1000000 END AS seen_at, seen_at + 1000000 AS sent, etag, n FROM f
), r AS (
  SELECT g.*, p.capture_id AS response_id, p.etag AS found, p.n AS length, p.seen_at AS day, CASE
    WHEN kind = 6 THEN 'other' WHEN g.canonical IS NULL OR g.seen_at IS NULL OR p.capture_id IS NULL THEN 'orphan'
    WHEN kind = 1 THEN 'mismatch' WHEN kind = 2 THEN CASE WHEN g.n = p.n THEN 'resolved' ELSE 'mismatch' END WHEN kind = 3 THEN 'mismatch' WHEN kind = 4 THEN 'unvalidated'
    WHEN g.etag = p.etag THEN 'resolved' ELSE 'mismatch' END AS outcome
  FROM g ASOF LEFT JOIN f p ON g.canonical = p.canonical AND g.seen_at > p.seen_at
)
SELECT capture_id, canonical, seen_at, 200 AS status, capture_id AS response_id, 'full' AS outcome, 'content-length=' || n || ';content-type=text/html;date=' || seen_at AS headers FROM f
UNION ALL
SELECT capture_id, canonical, seen_at, CASE kind WHEN 6 THEN 404 ELSE 304 END, CASE WHEN outcome IN ('resolved', 'unvalidated') THEN response_id END, outcome,
  CASE WHEN outcome IN ('resolved', 'unvalidated') THEN 'content-length=' || length || ';content-type=text/html;date=' || sent || ';expires=never' ELSE 'content-length=0;date=' || sent || ';expires=never' END FROM r
"""

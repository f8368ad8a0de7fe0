"""Operator 9, WARC: resolving not-modified revisits.

A revisit record says that a page has not changed since an earlier capture. It is joined, as of its time, to the latest earlier
full response of the same canonical URL; the validators of both are compared, and the headers that a 304 response may renew
are merged into those stored.

The as-of join is made of windows with bounded frames of keys: within (URL, time bucket) the last response before each
revisit, and across buckets the last response of each earlier bucket, which partial aggregation has reduced to one row a URL
and bucket. A URL that holds a third of all captures is thus spread over its buckets. Bodies never move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import only, stored, table

#: Fixed values of HTTP: headers that a 304 response does not renew - they describe the body or the connection.
KEPT_HEADERS = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate",
    "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade",
)
BUCKET_SECONDS = 3600


def canonical_url(url: Column) -> Column:
    """Scheme, user, default port, www., fragment, tracking parameters and a final slash go; the host is lower-cased."""
    host = F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    host = F.regexp_replace(host, r"^www\.", "")
    port = F.regexp_replace(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?[^/?#:]*(:[0-9]*)?", 1), r"^:(80|443)?$", "")
    path = F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(ref|utm_[a-z]+|gclid|fbclid)(=|$)")))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.when(host != "", F.concat(host, port, F.regexp_replace(path, r"/+$", ""), tail))


def resolve_revisits(records: DataFrame, *, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """records(record_id long, kind, url, at long (seconds), etag, last_modified long, headers map<string,string> with
    lower-case names) -> a row for each revisit: record_id, canonical, response_id, status, headers.

    status: resolved; no_response (no earlier full response, or the revisit has no url or time); mismatch (a validator of both
    differs: the entity tag without W/, else the modification time); unchecked (no validator in common). headers are merged
    where resolved, null otherwise: the revisit's values replace the stored ones, except those of KEPT_HEADERS. Earlier means
    at a smaller time; of responses at one time the one with the largest id counts, and
    of responses with one id the latest. Repeated revisit rows give repeated rows;
    records of other kinds are ignored, and so are responses without id, url or time."""
    r = only(records, "record_id", "kind", "url", "at", "etag", "last_modified", "headers").withColumn("canonical", canonical_url(F.col("url")))
    asks = r.filter("kind = 'revisit'")
    timed = r.filter("canonical is not null and at is not null").withColumn("bucket", F.floor(F.col("at") / bucket_seconds))
    given = timed.filter("kind = 'response' and record_id is not null").select("canonical", "bucket", F.struct("at", "record_id").alias("full"))

    lasts = given.groupBy("canonical", "bucket").agg(F.max("full").alias("full"))
    wanted = timed.filter("kind = 'revisit'").select("canonical", "bucket").distinct()
    steps = lasts.join(wanted.hint("shuffle_merge"), ["canonical", "bucket"], "full")
    earlier = F.last("full", ignorenulls=True).over(W.partitionBy("canonical").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    carried = steps.select("canonical", "bucket", earlier.alias("carried"))

    points = timed.filter("kind = 'revisit'").select("canonical", "bucket", "at", F.lit(None).cast(given.schema["full"].dataType).alias("full")).distinct()
    points = points.unionByName(given.select("canonical", "bucket", F.col("full.at").alias("at"), "full"))
    inside = W.partitionBy("canonical", "bucket").orderBy(F.col("at"), F.col("full.record_id").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    found = points.withColumn("inside", F.last("full", ignorenulls=True).over(inside)).filter("full is null")
    asof = found.join(carried.hint("shuffle_merge"), ["canonical", "bucket"], "left").select("canonical", "at", F.coalesce("inside", "carried").getField("record_id").alias("response_id"))

    entries = F.array_sort(F.map_entries(F.coalesce("headers", F.create_map().cast("map<string,string>"))))
    latest = r.filter("kind = 'response' and record_id is not null").groupBy("record_id").agg(F.max(F.struct("at", "etag", "last_modified", entries.alias("headers"))).alias("old"))
    stored_side = latest.select(F.col("record_id").alias("response_id"), F.col("old.etag").alias("old_etag"), F.col("old.last_modified").alias("old_modified"), F.map_from_entries("old.headers").alias("old_headers"))
    # Revisits without a time or an earlier response meet nothing, and so are in no join on what they lack.
    placed = asks.filter("canonical is not null and at is not null").join(asof.hint("shuffle_merge"), ["canonical", "at"])
    met = placed.filter("response_id is not null").join(stored_side.hint("shuffle_merge"), "response_id")
    alone = placed.filter("response_id is null").unionByName(asks.filter("canonical is null or at is null"), allowMissingColumns=True)
    joined = met.unionByName(alone, allowMissingColumns=True)
    strong = lambda c: F.regexp_replace(c, "^W/", "")
    status = (
        F.when(F.col("response_id").isNull(), "no_response")
        .when(F.col("etag").isNotNull() & F.col("old_etag").isNotNull(), F.when(strong("etag") == strong("old_etag"), "resolved").otherwise("mismatch"))
        .when(F.col("last_modified").isNotNull() & F.col("old_modified").isNotNull(), F.when(F.col("last_modified") == F.col("old_modified"), "resolved").otherwise("mismatch"))
        .otherwise("unchecked")
    )
    none = F.create_map().cast("map<string,string>")
    new = F.map_filter(F.coalesce("headers", none), lambda k, v: ~k.isin(*KEPT_HEADERS))
    old = F.coalesce("old_headers", none)
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k)), new)
    return joined.withColumn("status", status).select("record_id", "canonical", "response_id", "status", F.when(F.col("status") == "resolved", merged).alias("headers"))


def header_text(headers: Column) -> Column:
    """name: value lines in the order of names."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Capture records of crawled pages: each page gives a full response and, at another time, a revisit, with validators
    taken from its content and times from its id. Every fourth revisit has no entity tag, every fifth an outdated one."""
    p = only(pages, "page_id", "url", "html").withColumn("tag", F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16), F.lit('"')))
    start, days = 1_700_000_000, 864_000
    at = (F.lit(start) + (F.col("page_id") * 7919) % days).cast("long")
    again = (F.lit(start) + (F.col("page_id") * 104_729 + 4321) % days).cast("long")
    day = (at - at % 86_400).cast("long")
    size = F.coalesce(F.octet_length("html"), F.lit(0)).cast("string")
    full = p.select(
        (F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("kind"), "url", at.alias("at"), F.col("tag").alias("etag"), day.alias("last_modified"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), size, F.lit("etag"), F.col("tag"), F.lit("date"), at.cast("string"), F.lit("server"), F.lit("a")).alias("headers"),
    )
    tag = F.when(F.col("page_id") % 4 == 0, None).when(F.col("page_id") % 5 == 0, F.lit('"old"')).otherwise(F.concat(F.lit("W/"), F.col("tag")))
    revisit = p.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), "url", again.alias("at"), tag.alias("etag"), day.alias("last_modified"),
        F.create_map(F.lit("content-length"), F.lit("0"), F.lit("date"), again.cast("string"), F.lit("cache-control"), F.lit("max-age=60")).alias("headers"),
    )
    return full.unionByName(revisit)


def op9_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = stored(records_of_pages(table(spark, sf_dir, "pages")))
    return resolve_revisits(records).select("record_id", "canonical", "response_id", "status", header_text(F.col("headers")).alias("headers"))


OP9_SQL = r"""
WITH p AS (SELECT page_id, url, '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag, strlen(coalesce(html, '')) AS size,
             1700000000 + (page_id * 7919) % 864000 AS t0, 1700000000 + (page_id * 104729 + 4321) % 864000 AS again,
             regexp_replace(lower(regexp_extract(url, '^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\.', '') AS host,
             regexp_replace(regexp_extract(url, '^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?[^/?#:]*(:[0-9]*)?', 1), '^:(80|443)?$', '') AS port,
             regexp_replace(regexp_extract(url, '^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
             list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(ref|utm_[a-z]+|gclid|fbclid)(=|$)'))) AS q
           FROM pages),
c AS (SELECT *, t0 - t0 % 86400 AS modified, CASE WHEN host <> '' THEN host || port || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS canonical FROM p),
full_ AS (SELECT canonical, t0, max(page_id) AS page_id FROM c WHERE canonical IS NOT NULL GROUP BY canonical, t0),
a AS (SELECT v.*, f.page_id AS of_page FROM c v ASOF LEFT JOIN full_ f ON v.canonical = f.canonical AND v.again > f.t0),
j AS (SELECT a.*, r.tag AS old_tag, r.modified AS old_modified, r.size AS old_size, CASE WHEN a.page_id % 4 = 0 THEN NULL WHEN a.page_id % 5 = 0 THEN '"old"' ELSE a.tag END AS new_tag FROM a LEFT JOIN c r ON a.of_page = r.page_id),
s AS (SELECT *, CASE WHEN of_page IS NULL THEN 'no_response' WHEN new_tag IS NOT NULL THEN CASE WHEN new_tag = old_tag THEN 'resolved' ELSE 'mismatch' END
                     WHEN modified = old_modified THEN 'resolved' ELSE 'mismatch' END AS status FROM j)
SELECT page_id * 2 + 1 AS record_id, canonical, of_page * 2 AS response_id, status,
  CASE WHEN status = 'resolved' THEN 'cache-control: max-age=60' || chr(10) || 'content-length: ' || old_size || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || again || chr(10) || 'etag: ' || old_tag || chr(10) || 'server: a' END AS headers
FROM s
"""

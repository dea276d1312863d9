"""WARC not-modified revisits, resolved by an as-of join.

A revisit stands for a response that the server said had not changed.  It takes
its payload from the latest earlier full response of the same canonical URL,
provided that the validators it carries (entity tag, last-modified date) agree;
its own headers replace the response's only where a 304 may send them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkslab.plans.stage import stage

#: Time units in a bucket of a URL: no task has more of one URL than it was captured in so much time.
BUCKET = 4_096
# Header fields a 304 response may send (RFC 9110, 15.4.5), and query parameters that don't tell pages apart.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
TRACKING = r"(?i)(?:utm_[a-z]+|gclid|fbclid|ref|sessionid|sid)"


def canonical_url(url: Column) -> Column:
    """Scheme, www., fragment, tracking parameters and a final slash go; host and scheme are lower case."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(bare, r"^(?i)(?:[a-z][a-z0-9+.-]*://)?([^/?]*)", 1), r"^www\.", ""))
    path = F.regexp_replace(F.regexp_extract(bare, r"^(?i)(?:[a-z][a-z0-9+.-]*://)?[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda q: (q != "") & ~F.regexp_like(q, F.lit(f"^{TRACKING}(?:=.*)?$")))), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def resolve(records: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """record_id, base_id, status, headers for each revisit.

    ``records`` has record_id, url, ts (long), kind ('response' or 'revisit'),
    etag, last_modified and headers (map of lower-case names).  Status is 'ok',
    'etag_mismatch', 'date_mismatch' or 'no_response'; only 'ok' has merged
    headers, the others keep the revisit's own.  A response at a revisit's very
    time counts as earlier if its record_id is not larger; of responses alike in
    both, a hash of the validators decides.  A null url or time
    never finds a response; a validator that either side lacks is not checked.

    The latest response is carried forward in two steps: between a URL's time
    buckets by their last responses, and inside a bucket by a window, so a hot
    URL is spread over its buckets.  Payloads are not moved.
    """
    base = F.struct(F.col("record_id").alias("id"), "etag", "last_modified", "headers")
    rows = records.select(F.col("record_id").cast("long").alias("record_id"), canonical_url(F.col("url")).alias("key"), F.col("ts").cast("long").alias("ts"), (F.col("kind") == "revisit").alias("revisit"), "etag", "last_modified", "headers")
    rows = stage(rows.select("*", F.floor(F.col("ts") / bucket).alias("bucket"), F.when(~F.col("revisit") & F.col("ts").isNotNull() & F.col("key").isNotNull(), base).alias("full")), "warc-records")
    known = rows.where("key is not null and ts is not null")
    lasts = known.where("full is not null").groupBy("key", "bucket").agg(F.max_by("full", F.struct("ts", "record_id", F.xxhash64("etag", "last_modified"))).alias("last"))
    marks = known.select("key", "bucket").distinct().join(lasts, ["key", "bucket"], "left")
    carried = marks.select("key", "bucket", F.last("last", ignorenulls=True).over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    upto = Window.partitionBy("key", "bucket").orderBy("ts", "record_id", "revisit", F.xxhash64("etag", "last_modified")).rowsBetween(Window.unboundedPreceding, -1)
    near = known.withColumn("near", F.last("full", ignorenulls=True).over(upto)).where("revisit")
    found = near.join(carried, ["key", "bucket"], "left").select("record_id", "etag", "last_modified", "headers", F.coalesce("near", "carry").alias("base"))
    lost = rows.where("revisit and (key is null or ts is null)").select("record_id", "etag", "last_modified", "headers", F.lit(None).cast(found.schema["base"].dataType).alias("base"))
    differ = lambda c: F.coalesce(F.col(c) != F.col(f"base.{c}"), F.lit(False))
    status = F.when(F.col("base").isNull(), "no_response").when(differ("etag"), "etag_mismatch").when(differ("last_modified"), "date_mismatch").otherwise("ok")
    own = F.coalesce("headers", F.create_map().cast("map<string,string>"))
    theirs = F.coalesce("base.headers", F.create_map().cast("map<string,string>"))
    sent = F.map_filter(own, lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(theirs, lambda k, _: ~F.array_contains(F.map_keys(sent), k)), sent)
    out = found.unionByName(lost).withColumn("status", status)
    return out.select("record_id", F.when(F.col("status") == "ok", F.col("base.id")).alias("base_id"), "status", F.when(F.col("status") == "ok", merged).otherwise(own).alias("headers"))


def records_of(pages: DataFrame) -> DataFrame:
    """Each page as a full response at its id, and a revisit of its URL 1,000 ids later with its validators.

    The entity tag is the payload's digest; where a later page has the same
    canonical URL, a revisit that comes after it no longer agrees.
    """
    digest = F.md5(F.coalesce(F.col("html"), F.lit("")))
    page = F.col("page_id").cast("long")
    names = ("record_id", "url", "ts", "kind", "etag", "last_modified", "headers")
    response = [page * 2, F.col("url"), page * 2, F.lit("response"), digest, page, F.create_map(F.lit("etag"), digest, F.lit("date"), page.cast("string"), F.lit("content-type"), F.lit("text/html"))]
    revisit = [page * 2 + 1, F.col("url"), page * 2 + 2001, F.lit("revisit"), digest, page, F.create_map(F.lit("etag"), digest, F.lit("date"), (page + 1000).cast("string"), F.lit("content-type"), F.lit("text/plain"))]
    one = pages.select(*[c.alias(n) for c, n in zip(response, names, strict=True)])
    return one.union(pages.select(*[c.alias(n) for c, n in zip(revisit, names, strict=True)]))


def revisits(pages: DataFrame) -> DataFrame:
    """Resolved revisits of ``records_of(pages)``, with the headers written out in the order of their names."""
    text = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "; ")
    return resolve(records_of(pages)).select("record_id", "base_id", "status", text.alias("headers"))


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, md5(coalesce(html, '')) AS d, regexp_replace(trim(url), '#.*$', '') AS bare FROM pages),
q AS (SELECT page_id, d, regexp_replace(regexp_extract(bare, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?([^/?]*)', 1).lower(), '^www\.', '') AS host,
  regexp_replace(regexp_extract(bare, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?[^/?]*([^?]*)', 1), '/+$', '') AS path,
  array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(?:utm_[a-z]+|gclid|fbclid|ref|sessionid|sid)(?:=.*)?$'))), '&') AS query FROM p),
k AS (SELECT page_id, d, host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS key FROM q),
j AS (SELECT r.page_id, r.d, b.page_id AS base, b.d AS bd FROM k r ASOF LEFT JOIN k b ON r.key = b.key AND r.page_id + 1000 >= b.page_id)
SELECT page_id * 2 + 1 AS record_id, CASE WHEN d = bd AND page_id = base THEN base * 2 END AS base_id,
  CASE WHEN base IS NULL THEN 'no_response' WHEN d <> bd THEN 'etag_mismatch' WHEN page_id <> base THEN 'date_mismatch' ELSE 'ok' END AS status,
  CASE WHEN d = bd AND page_id = base THEN 'content-type: text/html; date: ' ELSE 'content-type: text/plain; date: ' END || (page_id + 1000) || '; etag: ' || d AS headers FROM j"""

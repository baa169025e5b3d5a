"""Not-modified revisit resolution for web captures.

A revisit record (HTTP 304) has no body: it stands for the latest earlier full response of the same
canonical URL. The as-of join runs in two steps so that one URL with a third of all captures is no
single task: captures fall in buckets of ``width`` time units; within a bucket a window finds the
latest earlier response; the last response of each bucket, one row for each URL and bucket, carries
over to the buckets after it.

The validators decide: equal entity tags (weak comparison), else equal Last-Modified, make the
revisit ``resolved``; different ones ``mismatch``; where neither side has a comparable validator it
is ``unverified``; without an earlier response ``missing``. Headers of a resolved or unverified
revisit are the response's, with those that a 304 may update taken from the revisit.

Canonical URLs have no scheme, ``www.``, fragment, trailing slash or tracking parameters, a
lower-case host and sorted parameters. Null or malformed URLs are null, and such revisits missing.
Only strictly earlier responses count; of several at one time the one with the greatest id. Repeated
revisits come back repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Header fields that a 304 response may update (fixed values).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"
_URL = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)([^?#]*)(\?[^#]*)?"


def canonical_url(url: Column) -> Column:
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _URL, 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(url, _URL, 2), "/+$", "")
    query = F.regexp_replace(F.regexp_extract(url, _URL, 3), r"^\?", "")
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.when(host != "", F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def resolve_revisits(records: DataFrame, width: int = 86_400) -> DataFrame:
    """One row for each revisit of ``records`` (record_id long, url, ts long, kind, headers map).

    ``kind`` is response or revisit; rows of other kinds are ignored. Header names are lower case.
    """
    rows = records.where(F.col("kind").isin("response", "revisit")).select("record_id", canonical_url(F.col("url")).alias("canonical"), "ts", "kind", "headers")
    rows = rows.withColumn("bucket", F.floor(F.col("ts") / width))
    found = F.struct("ts", "record_id", F.map_entries("headers").alias("headers"))
    rows = rows.withColumn("full", F.when((F.col("kind") == "response") & F.col("ts").isNotNull(), found))
    known = rows.where("canonical is not null")
    inside = Window.partitionBy("canonical", "bucket").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    near = known.withColumn("near", F.max("full").over(inside)).where("kind = 'revisit'").drop("full")
    ends = known.where("full is not null").groupBy("canonical", "bucket").agg(F.max("full").alias("full"))
    marks = known.where("kind = 'revisit'").select("canonical", "bucket").distinct().join(ends, ["canonical", "bucket"], "full")
    before = Window.partitionBy("canonical").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.select(F.col("canonical").alias("c"), F.col("bucket").alias("b"), F.max("full").over(before).alias("far"))
    joined = near.join(marks, (F.col("canonical") == F.col("c")) & F.col("bucket").eqNullSafe(F.col("b")), "left").select("record_id", "canonical", "ts", "headers", F.coalesce("near", "far").alias("base"))
    lost = rows.where("canonical is null and kind = 'revisit'").select("record_id", "canonical", "ts", "headers", F.lit(None).cast(joined.schema["base"].dataType).alias("base"))
    out = joined.unionByName(lost).withColumn("old", F.map_from_entries("base.headers"))
    tag = lambda m: F.regexp_replace(F.col(m)["etag"], "^W/", "")
    same_tag, same_date = tag("headers") == tag("old"), F.col("headers")["last-modified"] == F.col("old")["last-modified"]
    agree = F.coalesce(same_tag, same_date)
    status = F.when(F.col("base").isNull(), "missing").when(agree.isNull(), "unverified").when(agree, "resolved").otherwise("mismatch")
    update = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    merged = F.map_concat(F.map_filter("old", lambda k, _: ~F.array_contains(F.map_keys(update), k)), update)
    out = out.withColumn("status", status)
    return out.select("record_id", F.col("canonical").alias("canonical_url"), "ts", F.col("base.record_id").alias("response_id"), (F.col("ts") - F.col("base.ts")).alias("age"), "status", F.when(F.col("status").isin("resolved", "unverified"), merged).alias("headers"))


def page_records(pages: DataFrame, delay: int = 5000) -> DataFrame:
    """Capture records of ``pages``, which have no capture metadata of their own, by rule.

    Every page is a full response at the time of its id, and is asked for again ``delay`` later, when
    the server answers 304 with the entity tag of the page asked about.
    """
    tag = F.md5(F.col("html").cast("binary"))
    key = F.col("page_id").cast("long")
    full = F.map_from_arrays(F.array(*map(F.lit, ("content-type", "content-length", "etag", "date"))), F.array(F.lit("text/html"), F.length("html").cast("string"), tag, key.cast("string")))
    again = F.map_from_arrays(F.array(*map(F.lit, ("content-length", "etag", "date", "cache-control"))), F.array(F.lit("0"), tag, (key + delay).cast("string"), F.lit("max-age=60")))
    both = F.array(F.struct(F.lit("response").alias("kind"), key.alias("ts"), full.alias("headers")), F.struct(F.lit("revisit").alias("kind"), (key + delay).alias("ts"), again.alias("headers")))
    return pages.select(key.alias("record_id"), F.col("url").cast("string").alias("url"), F.explode(both).alias("r")).select("record_id", "url", "r.kind", "r.ts", "r.headers")


def revisit_table(pages: DataFrame, delay: int = 5000, width: int = 4096) -> DataFrame:
    """The resolution of every page's revisit, headers as sorted text."""
    out = resolve_revisits(page_records(pages, delay), width)
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))), ";")
    return out.select("record_id", "canonical_url", "response_id", "age", "status", shown.alias("headers"))


ORACLE = r"""
WITH p AS (
  SELECT page_id, md5(html) AS tag, length(html) AS size,
    regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)), '^www\.', '') AS host,
    regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) AS args
  FROM pages
), c AS (
  SELECT page_id, tag, size, CASE WHEN host <> '' THEN host || path || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END END AS canonical_url FROM p
), j AS (
  SELECT v.page_id AS record_id, v.canonical_url, v.tag, r.page_id AS response_id, r.tag AS old_tag, r.size,
    row_number() OVER (PARTITION BY v.page_id ORDER BY r.page_id DESC NULLS LAST) AS k
  FROM c v LEFT JOIN c r ON v.canonical_url = r.canonical_url AND r.page_id < v.page_id + 5000
)
SELECT record_id, canonical_url, response_id, record_id + 5000 - response_id AS age,
  CASE WHEN response_id IS NULL THEN 'missing' WHEN tag IS NULL OR old_tag IS NULL THEN 'unverified' WHEN tag = old_tag THEN 'resolved' ELSE 'mismatch' END AS status,
  CASE WHEN response_id IS NOT NULL AND (tag = old_tag OR tag IS NULL OR old_tag IS NULL)
    THEN 'cache-control=max-age=60;content-length=' || size || ';content-type=text/html;date=' || (record_id + 5000) || ';etag=' || coalesce(tag, old_tag) END AS headers
FROM j WHERE k = 1
"""

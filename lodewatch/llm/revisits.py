"""Revisit records of web archives, resolved to the response that they repeat.

A "not modified" record (status 304) has no body. It stands for the latest earlier full response (status 200) of its
canonical URL, provided that the validators agree: equal entity tags where both have one, else equal modification times.
The resolved record takes body, status and headers of that response; of its own headers it takes the ones that a
"not modified" answer may renew, and never those that describe a body. Header names are compared in lower case.

The as-of join runs over slices of time that hold about equally many records: inside a slice a window carries the last
full response on, and what a slice starts with comes from the slices before, one row for each URL and slice. So a URL
with many captures is spread over slices. Bodies stay out of it; they are fetched by a digest of the record's other
fields, so that repeated rows and repeated ids meet their own row alone.

Defined cases: records of any other status, or of none, are ``other``: they are no base and stay as they are; revisits
without URL or time, and without an earlier response, are ``orphan``; disagreeing validators give ``mismatch`` (nothing
is looked for further back) and no validators on either side ``unverified``; records of one time are ordered by id, full
ones first; repeated rows are resolved one by one; an empty table gives no rows; extra columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, staged

# fixed values: headers that a "not modified" answer may renew (RFC 9110, 15.4.5)
RENEWED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
# fixed values: query parameters that only track where a visit comes from
TRACKING = "utm_[^=&]*|gclid|fbclid"
SLICES = 64


#: What tells records apart.
FIELDS = ("record_id", "url", "at", "status", "etag", "modified")


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and the scheme's default port, path without closing slash, sorted query without tracking parameters; no scheme (none is http), no fragment."""
    whole = F.regexp_replace(url, r"#.*$", "")
    bare = F.regexp_replace(whole, r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/?]*", 0)), r"^www\.", "")
    host = F.when(F.lower(whole).startswith("https://"), F.regexp_replace(host, ":443$", "")).otherwise(F.regexp_replace(host, ":80$", ""))
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.filter(F.split(F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.regexp_like(p, F.lit(f"^({TRACKING})(=|$)")))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(query), "&"))).otherwise(F.lit("")))


def with_key(records: DataFrame, *more: str) -> DataFrame:
    """The fields of ``records``, ``more`` of its columns and ``row_key``, equal for equal fields alone."""
    return pick(records, *FIELDS, *more).withColumn("row_key", F.md5(F.to_json(F.struct(*FIELDS), {"ignoreNullFields": "false"}).cast("binary")))


def earlier_responses(records: DataFrame) -> DataFrame:
    """``records`` (record_id, row_key, canonical, at, full, revisit, etag, modified) with ``base``, the struct of the latest earlier full response, or null.

    ``records`` must have been written: it is read several times.
    """
    found = records.agg(F.percentile_approx("at", [k / SLICES for k in range(1, SLICES)], 10_000)).first()[0]
    bounds = F.array(*[F.lit(b) for b in sorted(set(found or []))]).cast("array<long>")
    rows = records.withColumn("slice", F.size(F.filter(bounds, lambda b: b < F.col("at"))))
    own = F.struct(F.col("record_id").alias("record_id"), F.col("row_key").alias("row_key"), F.col("at").alias("at"), F.col("etag").alias("etag"), F.col("modified").alias("modified"))
    order = ["at", F.desc("full"), "record_id", "row_key"]
    inside = Window.partitionBy("canonical", "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("near", F.last(F.when(F.col("full"), own), ignorenulls=True).over(inside))
    last = F.max_by(own, F.struct("at", ~F.col("full"), "record_id", "row_key")).alias("last")
    ends = rows.filter("full").groupBy("canonical", "slice").agg(last)
    before = Window.partitionBy("canonical").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = rows.select("canonical", "slice").distinct().join(ends, ["canonical", "slice"], "left")
    starts = slices.select("canonical", "slice", F.last("last", ignorenulls=True).over(before).alias("far"))
    rows = rows.join(starts, ["canonical", "slice"])
    return rows.withColumn("base", F.coalesce("near", "far")).drop("near", "far", "slice")


def resolve(records: DataFrame) -> DataFrame:
    """(record_id, row_key, canonical, full, outcome, base_id, base_key) of each row of ``records`` (record_id, url, at, status, etag, modified)."""
    rows = with_key(records)
    rows = staged(rows.select("record_id", "row_key", canonical_url(F.col("url")).alias("canonical"), F.col("at").cast("long").alias("at"), F.col("status").eqNullSafe(200).alias("full"), F.col("status").eqNullSafe(304).alias("revisit"), "etag", "modified"), "captures")
    placed = "canonical IS NOT NULL AND at IS NOT NULL"
    done = earlier_responses(rows.filter(placed))
    tags = F.when(F.col("etag").isNotNull() & F.col("base.etag").isNotNull(), F.col("etag") == F.col("base.etag"))
    times = F.when(F.col("modified").isNotNull() & F.col("base.modified").isNotNull(), F.col("modified") == F.col("base.modified"))
    agree = F.coalesce(tags, times)
    outcome = F.when(F.col("full"), "full").when(~F.col("revisit"), "other").when(F.col("base").isNull(), "orphan").when(agree.isNull(), "unverified").when(agree, "resolved").otherwise("mismatch")
    base = lambda field, name: F.when(F.col("revisit"), F.col(f"base.{field}")).alias(name)
    done = done.select("record_id", "row_key", "canonical", "full", outcome.alias("outcome"), base("record_id", "base_id"), base("row_key", "base_key"))
    none = lambda name: F.lit(None).cast(dict(done.dtypes)[name]).alias(name)
    alone = F.when(F.col("full"), "full").when(~F.col("revisit"), "other").otherwise("orphan")
    rest = rows.filter(f"NOT ({placed})").select("record_id", "row_key", "canonical", "full", alone.alias("outcome"), none("base_id"), none("base_key"))
    return done.unionByName(rest)


def lower_names(headers: Column) -> Column:
    """A map with its keys in lower case; of keys that become equal the first stays. Null is an empty map."""
    headers = F.coalesce(headers, F.map_from_arrays(F.array(), F.array()).cast("map<string,string>"))
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.transform(entries, lambda e: e["key"])
    return F.map_from_entries(F.filter(entries, lambda e, i: F.array_position(names, e["key"]) == i + 1))


def merged_headers(own: Column, base: Column) -> Column:
    """Headers of the base response, renewed by the permitted ones of the revisit, names in lower case."""
    permitted = F.map_filter(lower_names(own), lambda k, _: k.isin(*RENEWED))
    kept = F.map_filter(lower_names(base), lambda k, _: ~F.map_contains_key(permitted, k))
    return F.map_concat(kept, permitted)


def materialise(records: DataFrame, resolved: DataFrame) -> DataFrame:
    """(record_id, url, at, canonical, full, status, headers, body, outcome, base_id): resolved revisits as full responses, the rest as they are.

    ``records`` has the columns that ``resolve`` takes, headers (map) and body. Of full responses that agree in all
    fields but the body one is used. ``resolved`` should have been written: it is read twice.
    """
    found = resolved.select("row_key", "canonical", "full", "outcome", "base_id", "base_key").dropDuplicates(["row_key"])
    rows = with_key(records, "headers", "body")
    names = ["record_id", "url", "at", "canonical", "full", "status", "headers", "body", "outcome", "base_id"]
    # what is no revisit stays as it is, so its body needn't move
    full = F.col("status").eqNullSafe(200)
    none = F.lit(None).cast(dict(found.dtypes)["base_id"]).alias("base_id")
    plain = rows.filter(~F.col("status").eqNullSafe(304)).withColumns({"canonical": canonical_url(F.col("url")), "full": full, "outcome": F.when(full, "full").otherwise("other")})
    plain = plain.select(*names[:-1], none)
    visits = rows.filter("status = 304")
    kept = visits.join(found.filter("outcome <> 'resolved'"), "row_key").select(*names)
    # a revisit has no body of its own
    own = visits.drop("body").join(found.filter("outcome = 'resolved'"), "row_key")
    wanted = found.filter("outcome = 'resolved'").select(F.col("base_key").alias("row_key")).distinct()
    base = rows.filter("status = 200").join(wanted, "row_key", "left_semi").dropDuplicates(["row_key"])
    base = base.select(F.col("row_key").alias("base_key"), F.col("status").alias("base_status"), F.col("headers").alias("base_headers"), F.col("body").alias("base_body"))
    done = own.join(base, "base_key").select("record_id", "url", "at", "canonical", "full", F.col("base_status").alias("status"), merged_headers(F.col("headers"), F.col("base_headers")).alias("headers"), F.col("base_body").alias("body"), "outcome", "base_id")
    return plain.unionByName(kept).unionByName(done)


def headers_digest(headers: Column) -> Column:
    """MD5 of the sorted lines ``name=value``, names in lower case."""
    return F.md5(F.array_join(F.array_sort(F.transform(F.map_entries(lower_names(headers)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "\n").cast("binary"))


#: Pages in a row, by id, that share a version of the site, and so the validators.
PAGES_A_VERSION = 20_000


def page_captures(pages: DataFrame) -> DataFrame:
    """Captures from the table of pages: each page is a response, followed by a visit of its URL that was answered "not modified".

    The visit sends the validators of its URL's version at that time, so it agrees with the page unless a later full
    response of the same canonical URL came between. By remainder of the page id: a fifth have no entity tag, and are
    compared by modification time; half of these visits send no time either; a seventh of the visits send an old tag; an
    eleventh of the pages were not found, so their visits have no response to stand for.
    """
    rows = pick(pages, "page_id", "url", "html")
    page = F.col("page_id")
    version = F.floor(page / PAGES_A_VERSION)
    digest = F.md5(F.concat_ws(":", F.coalesce("url", F.lit("")), version).cast("binary"))
    etag = F.when(page % 5 != 3, digest)
    modified = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    status = F.when(page % 11 == 7, 404).otherwise(200)
    # half of all visits come much later than their page
    later = page + F.when(page % 2 == 0, F.lit(0)).otherwise(F.lit(PAGES_A_VERSION))

    def captures(record_id: Column, at: Column, status: Column, body: Column, etag: Column, modified: Column, **headers: Column) -> DataFrame:
        pairs = {"Date": at.cast("string"), "ETag": etag, "Last-Modified": modified.cast("string")} | {k.replace("_", "-"): v for k, v in headers.items()}
        known = F.map_filter(F.create_map(*[c for k, v in pairs.items() for c in (F.lit(k), v)]), lambda _, v: v.isNotNull())
        return rows.select(record_id.alias("record_id"), "page_id", "url", at.alias("at"), status.alias("status"), etag.alias("etag"), modified.alias("modified"), known.alias("headers"), body.alias("body"))

    full = captures(2 * page, page, status, F.col("html"), etag, modified, Content_Type=F.lit("text/html"), content_length=F.octet_length("html").cast("string"), server=F.lit("origin"), Cache_Control=F.lit("no-cache"))
    renewed = F.when(page % 7 > 0, F.concat(F.lit("max-age="), (page % 7).cast("string")))
    sent = F.when(page % 7 == 2, F.reverse(etag)).otherwise(etag), F.when(page % 10 != 3, modified)
    visit = captures(2 * page + 1, later, F.lit(304), F.lit(None).cast("string"), *sent, content_length=F.lit("0"), Server=F.lit("edge"), cache_control=renewed)
    return full.unionByName(visit)


def op4_revisit_resolution(spark, sf_dir: str) -> DataFrame:
    """All captures, resolved and materialised; headers and bodies, the merged ones of resolved revisits, as digests."""
    records = page_captures(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    done = materialise(records, staged(resolve(records), "resolved"))
    return done.select("record_id", "canonical", "full", "outcome", "base_id", "status", headers_digest(F.col("headers")).alias("headers_md5"), F.md5(F.col("body").cast("binary")).alias("body_md5"))


OP4_SQL = r"""
WITH p AS (
  SELECT *, md5(concat_ws(':', coalesce(url, ''), floor(page_id / 20000.0)::BIGINT)) AS digest, regexp_replace(url, '#.*$', '') AS whole FROM pages
), c AS (
  SELECT *, CASE WHEN page_id % 5 <> 3 THEN digest END AS etag, ('0x' || digest[1:15])::BIGINT AS modified, regexp_replace(whole, '^[A-Za-z][A-Za-z0-9+.\-]*://', '') AS bare FROM p
), q AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^www\.', ''), CASE WHEN starts_with(lower(whole), 'https://') THEN ':443$' ELSE ':80$' END, '') AS host,
         regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
         list_sort(list_filter(string_split(regexp_extract(bare, '^[^?]*\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=&]*|gclid|fbclid)(=|$)'))) AS query FROM c
), u AS (
  SELECT *, host || path || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END AS canonical FROM q
), r AS (
  SELECT 2 * page_id AS record_id, canonical, page_id AS t, CASE WHEN page_id % 11 = 7 THEN 404 ELSE 200 END AS status, etag, modified, html AS body,
         ['content-type=text/html', 'content-length=' || strlen(html), 'server=origin', 'cache-control=no-cache', 'date=' || page_id, 'etag=' || etag, 'last-modified=' || modified] AS lines FROM u
  UNION ALL
  SELECT 2 * page_id + 1, canonical, page_id + CASE WHEN page_id % 2 = 0 THEN 0 ELSE 20000 END AS t, 304, CASE WHEN page_id % 7 = 2 THEN reverse(etag) ELSE etag END AS etag,
         CASE WHEN page_id % 10 <> 3 THEN modified END AS modified, NULL,
         ['content-length=0', 'server=edge', CASE WHEN page_id % 7 > 0 THEN 'cache-control=max-age=' || (page_id % 7) END, 'date=' || (page_id + CASE WHEN page_id % 2 = 0 THEN 0 ELSE 20000 END),
          'etag=' || CASE WHEN page_id % 7 = 2 THEN reverse(etag) ELSE etag END, CASE WHEN page_id % 10 <> 3 THEN 'last-modified=' || modified END] FROM u
), records AS (SELECT * EXCLUDE (lines), list_filter(lines, lambda x: x IS NOT NULL) AS headers, status = 200 AS "full" FROM r
), w AS (
  SELECT *, last_value(CASE WHEN "full" THEN {'id': record_id, 'etag': etag, 'modified': modified, 'headers': headers, 'body': body} END IGNORE NULLS)
    OVER (PARTITION BY canonical ORDER BY t, "full" DESC, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base FROM records
), o AS (
  SELECT *, CASE WHEN "full" THEN 'full' WHEN status <> 304 THEN 'other' WHEN base IS NULL OR canonical IS NULL THEN 'orphan'
    WHEN etag IS NOT NULL AND base.etag IS NOT NULL THEN CASE WHEN etag = base.etag THEN 'resolved' ELSE 'mismatch' END
    WHEN modified IS NOT NULL AND base.modified IS NOT NULL THEN CASE WHEN modified = base.modified THEN 'resolved' ELSE 'mismatch' END ELSE 'unverified' END AS outcome,
    list_filter(headers, lambda x: split_part(x, '=', 1) IN ('cache-control', 'content-location', 'date', 'etag', 'expires', 'vary')) AS renewed FROM w
), merged AS (
  SELECT *, CASE WHEN outcome = 'resolved' THEN list_filter(base.headers, lambda x: NOT list_contains(list_transform(renewed, lambda y: split_part(y, '=', 1)), split_part(x, '=', 1))) || renewed ELSE headers END AS lines FROM o
)
SELECT record_id::BIGINT AS record_id, canonical, "full", outcome, (CASE WHEN status = 304 THEN base.id END)::BIGINT AS base_id, (CASE WHEN outcome = 'resolved' THEN 200 ELSE status END)::INTEGER AS status,
       md5(array_to_string(list_sort(lines), chr(10))) AS headers_md5, md5(CASE WHEN outcome = 'resolved' THEN base.body ELSE body END) AS body_md5 FROM merged
"""

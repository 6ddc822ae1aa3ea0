"""Revisits: outcomes of the query, header names, ports, repeated rows and empty tables."""

import collections
import hashlib
from pathlib import Path

import pytest

from lodewatch.llm import revisits

SF = Path("/root/testdata/sf0.001")
SCHEMA = "record_id long, url string, at long, status int, etag string, modified long, headers map<string,string>, body string"


@pytest.mark.skipif(not SF.exists(), reason="the driver's tables are not here")
def test_query_reaches_every_outcome_and_resolves_bodies(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = {r.record_id: r for r in revisits.op4_revisit_resolution(spark, str(SF)).collect()}
    assert len(rows) == 2 * len(pages)
    counts = collections.Counter(r.outcome for r in rows.values())
    assert all(counts[x] for x in ("full", "resolved", "mismatch", "orphan", "unverified", "other")), counts
    for r in rows.values():
        if r.outcome == "resolved":
            assert (r.status, r.body_md5) == (200, hashlib.md5(pages[r.base_id // 2].html.encode()).hexdigest())
        elif r.outcome in ("mismatch", "orphan", "unverified"):
            assert (r.status, r.body_md5) == (304, None)


def test_header_names_are_compared_in_lower_case(spark):
    rows = [(1, "a.com/x", 1, 200, "e", None, {"ETag": "e", "Date": "1", "Content-Length": "4", "X-Own": "a"}, "page"), (2, "a.com/x", 2, 304, "e", None, {"DATE": "2", "content-length": "0", "Expires": "9", "date": "3"}, None)]
    records = spark.createDataFrame(rows, SCHEMA)
    done = {r.record_id: r for r in revisits.materialise(records, revisits.resolve(records)).collect()}
    assert done[2].headers.pop("date") in ("2", "3")  # a map has no order that would tell which comes first
    assert done[2].headers == {"etag": "e", "content-length": "4", "x-own": "a", "expires": "9"} and done[2].body == "page"
    assert done[1].headers == rows[0][6]


def test_repeated_rows_and_ids_meet_their_own_row(spark):
    full, visit = (1, "a.com/x", 1, 200, "e", None, {"k": "v"}, "page"), (2, "a.com/x", 2, 304, "e", None, None, None)
    other = (1, "b.com/", 1, 200, "f", 7, None, "other page")
    rows = [full, full, visit, visit, other, (2, "b.com", 3, 304, None, 7, None, None), (None, "b.com", 4, 304, "f", None, None, None), (None, None, None, None, None, None, None, None)]
    records = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", `outcome` string")
    resolved = revisits.resolve(records)
    assert resolved.count() == len(rows)
    done = [(r.record_id, r.url, r.outcome, r.body) for r in revisits.materialise(records, resolved).collect()]
    wanted = [(1, "a.com/x", "full", "page")] * 2 + [(2, "a.com/x", "resolved", "page")] * 2 + [(1, "b.com/", "full", "other page"), (2, "b.com", "resolved", "other page"), (None, "b.com", "resolved", "other page"), (None, None, "other", None)]
    assert sorted(map(repr, done)) == sorted(map(repr, wanted))
    none = spark.createDataFrame([], SCHEMA)
    assert revisits.materialise(none, revisits.resolve(none)).count() == 0


def test_canonical_urls(spark):
    cases = {"http://www.A.com:80/x/?b=2&a=1#f": "a.com/x?a=1&b=2", "https://a.com:443/x?utm_source=1": "a.com/x", "http://a.com:443/": "a.com:443", "https://a.com:80": "a.com:80", "a.com/x?ref=main": "a.com/x?ref=main", "HTTPS://A.com:443": "a.com"}
    rows = spark.createDataFrame(list(cases.items()), "url string, wanted string")
    assert all(r.wanted == r.got for r in rows.select("wanted", revisits.canonical_url(rows["url"]).alias("got")).collect())

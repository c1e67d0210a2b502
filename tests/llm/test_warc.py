from __future__ import annotations

import random

from llm_fixtures import documents, shipped  # noqa: F401
from cliplake.llm import warc as W

SCHEMA = "record_id bigint, url string, at bigint, kind string, headers map<string,string>, status string, canonical int"


def resolve(spark, rows, block=10):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    return {r.record_id: (r.status, r.response_id, r.headers) for r in W.resolve_revisits(df, block).collect()}


def test_canonical_urls(spark):
    pairs = {
        "HTTP://WWW.Ex.com:80/a/?b=2&a=1&utm_source=x#f": "ex.com/a?a=1&b=2", "https://ex.com": "ex.com", "ex.com/": "ex.com",
        "https://EX.com/A//": "ex.com/A", "http://ex.com:8080?q": "ex.com:8080?q", "": "", "http://é.org/ü?x#y#z": "é.org/ü?x",
    }
    df = spark.createDataFrame([(u,) for u in pairs] + [(None,)], "url string")
    got = {r[0]: r[1] for r in df.select("url", W.canonical_url(df.url)).collect()}
    assert got == pairs | {None: None}


def test_status_and_headers(spark):
    u = "http://a.org/x"
    rows = [
        (1, u, 5, "response", {"ETag": '"1"', "Content-Type": "t", "VARY": "old"}),
        (2, u, 5, "revisit", {"etag": 'W/"1"', "vary": "new", "content-type": "no"}),
        (3, u, 40, "revisit", {"etag": '"2"'}),
        (4, u, 41, "revisit", {"date": "d"}),
        (5, u, 1, "revisit", {"etag": '"1"'}),
        (6, u, 50, "response", {"Last-Modified": "n"}),
        (7, "https://www.A.org/x/#f", 99, "revisit", {"last-modified": "n", "date": "d"}),
        (8, u, 99, "revisit", None),
        (9, None, 99, "revisit", {"etag": '"1"'}),
        (10, u, None, "revisit", {"etag": '"1"'}),
        (11, u, 60, "metadata", {"etag": '"1"'}),
        (None, u, 99, "revisit", {"last-modified": "x"}),
    ]
    got = resolve(spark, rows)
    assert got[2] == ("resolved", 1, {"etag": 'W/"1"', "content-type": "t", "vary": "new"})
    assert got[3][0] == "changed" and got[4][0] == "unverified" and got[5][0] == "missing"
    assert got[7] == ("resolved", 6, {"last-modified": "n", "date": "d"})
    assert got[8][0] == "unverified" and got[9][0] == got[10][0] == "missing" and got[None][0] == "changed"
    assert set(got) == {2, 3, 4, 5, 7, 8, 9, 10, None}
    assert resolve(spark, []) == {}


def test_against_a_loop(spark):
    rng = random.Random(7)
    rows = [(i, f"http://h/{rng.randint(0, 3)}", rng.randint(0, 300), rng.choice(["response", "revisit"]), {"etag": str(rng.randint(0, 1))}) for i in range(300)]
    want = {}
    for r in rows:
        if r[3] == "revisit":
            before = [x for x in rows if x[3] == "response" and x[1] == r[1] and (x[2], x[0]) < (r[2], r[0])]
            last = max(before, key=lambda x: (x[2], x[0]), default=None)
            want[r[0]] = ("missing", None) if last is None else ("resolved", last[0]) if last[4] == r[4] else ("changed", None)
    for block in (1, 7, 10_000):
        assert {k: v[:2] for k, v in resolve(spark, rows, block).items()} == want

import json
import random
import re

import pytest

from millrace.llm import queries
from millrace.llm.warc import PERMITTED, resolve_revisits

SCHEMA = "record_id bigint, url string, ts bigint, kind string, etag string, last_modified string, headers map<string,string>, _url string"


def plain(url):
    bare = url.strip(" ").split("#")[0]
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*://)([^/?]*@)?([^/?]*)(.*)", bare, re.S)
    if not m:
        return bare
    scheme, user, host, rest = m[1].lower(), m[2] or "", m[3].lower(), m[4]
    host = host.removesuffix({"http://": ":80", "https://": ":443"}.get(scheme, "\0"))
    return scheme + user + host + ("" if rest.startswith("/") else "/") + rest


def least(v):
    return (v is not None, v)


def brute(records):
    """(response, resolved, checked, headers) by record; records are (record_id, url, ts, kind, etag, last_modified, headers)."""
    want = {}
    for rid, url, ts, kind, etag, modified, headers in records:
        if kind != "revisit":
            continue
        before = [x for x in records if x[3] == "response" and None not in (x[1], url, x[2], ts) and (x[2], x[0]) < (ts, rid) and plain(x[1]) == plain(url)]
        x = max(before, key=lambda x: (x[2], x[0], least(x[4]), least(x[5]), len(x[6] or {})), default=None)
        pairs = [] if x is None else [p for p in ((etag, x[4]), (modified, x[5])) if None not in p]
        ok = bool(pairs) and pairs[0][0] == pairs[0][1]
        merged = {**(x[6] or {}), **{k: v for k, v in (headers or {}).items() if k in PERMITTED}} if ok else None
        want[rid] = (x and x[0], ok, bool(pairs), merged)
    return want


def run(spark, records, parts=3):
    found = resolve_revisits(spark.createDataFrame([(*r, "z") for r in records], SCHEMA).repartition(parts)).collect()
    assert len(found) == sum(r[3] == "revisit" for r in records)
    return {r.record_id: (r.response_id, r.resolved, r.checked, r.headers) for r in found}


def test_revisits(spark):
    rows = [
        (1, "HTTP://A.org:80/x", 1, "response", "e1", None, {"etag": "e1", "content-type": "t"}),
        (2, "http://a.org/x", 2, "response", "e2", "m", {"etag": "e2", "content-type": "u"}),
        (3, "http://a.org/x#f", 3, "revisit", "e2", None, {"date": "d", "content-type": "no"}),
        (4, "http://a.org/x", 1, "revisit", None, None, None),
        (5, "http://a.org/x", 4, "revisit", "other", "m", None),
        (6, "http://b.org/", 4, "revisit", None, None, None),
        (7, None, 4, "revisit", None, None, None),
        (8, "http://a.org/x", None, "revisit", None, None, None),
        (9, "http://a.org/x/", 9, "revisit", "e2", None, None),
        (10, "http://a.org/x", 9, "revisit", None, "m", None),
        (11, "http://a.org/x", 9, "other", None, "m", None),
    ]
    got = run(spark, rows)
    assert got == brute(rows)
    assert got[3] == (2, True, True, {"etag": "e2", "content-type": "u", "date": "d"})
    assert got[4] == (1, False, False, None)  # nothing to compare
    assert got[5] == (2, False, True, None)  # the etag decides
    assert [got[i] for i in (6, 7, 8, 9)] == [(None, False, False, None)] * 4
    assert got[10][:3] == (2, True, True)
    assert run(spark, []) == {}


def test_ties(spark):
    """A response of the revisit's own (ts, record_id) isn't earlier, in whatever order rows come."""
    rows = [(1, "http://a.org/", 5, "revisit", "e", None, None), (1, "http://a.org/", 5, "response", "e", None, None), (0, "http://a.org", 5, "response", "f", None, {"vary": "x"}), (0, "http://a.org", 5, "response", "e", None, None)]
    for some in (rows, rows[::-1]):
        assert run(spark, some) == {1: (0, False, True, None)} == brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_a_hot_url_over_many_tasks(spark, seed):
    rnd = random.Random(seed)
    urls = ["http://hot.org/p"] * 8 + ["http://Hot.org:80/p#x", "http://u:P@b.org/?p=1/", "http://U:p@b.org?p=1/", "http://c.org", "no scheme", "https://c.org:443/", None]
    rows = []
    for i in range(1500):
        headers = rnd.choice([None, {}, {"date": str(i), "x": "y"}, {"etag": "q", "vary": "w", "content-type": str(i)}])
        rows.append((i, rnd.choice(urls), rnd.choice([None, *range(60)]), rnd.choice(["response", "revisit", "revisit"]), rnd.choice([None, "a", "b"]), rnd.choice([None, "m"]), headers))
    rnd.shuffle(rows)
    got = run(spark, rows, 7)
    assert got == brute(rows)
    assert {(a is None, b, c) for a, b, c, _ in got.values()} == {(True, False, False), (False, False, False), (False, False, True), (False, True, True)}


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    records = queries.capture_records(spark.read.parquet(f"{d}/pages.parquet")).collect()
    by_page = {}
    for r in records:
        by_page.setdefault(r.record_id // 8, []).append(tuple(r))
    assert len({plain(r.url) for r in records}) == len(by_page)  # so pages can be resolved apart
    want = {k: v for rows in by_page.values() for k, v in brute(rows).items()}
    got = {r.record_id: (r.response_id, r.resolved, r.checked, r.headers and json.loads(r.headers)) for r in queries.op3_revisits(spark, d).collect()}
    assert got == want
    assert {(a is None, b, c) for a, b, c, _ in want.values()} == {(True, False, False), (False, False, False), (False, False, True), (False, True, True)}
    assert any(a and a != r - 1 for r, (a, *_) in want.items()) and any(len(h or ()) > 2 for *_, h in want.values())
    assert len({r.url for r in records}) > len(by_page)

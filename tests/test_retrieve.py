"""The whole way of a batch on odd rows."""

from __future__ import annotations

import datetime

from lakeweave.plans.retrieve import retrieve
from lakeweave.sources import io, policy

LOG = "url string, method string, ts timestamp, content string, error_class string, error_message string, elapsed double"
BLOBS = "url string, kind string, media_id string, width int, height int"


def at(hour):
    return datetime.datetime(2024, 1, 1, hour)


def test_a_batch_of_all_sorts(spark):
    rows = [
        (0, "https://e.org/a%20b", None, "markdown", True), (1, "https://e.org/a b", ["decodo"], "markdown", False), (2, "https://e.org/a%20b", None, "html", True), (3, "https://e.org/none", None, None, None),
        (4, "https://e.org/empty", ["firecrawl", "decodo"], None, None), (5, "https://e.org/x.jpg", None, "markdown", True), (6, "https://e.org/y.jpg", ["decodo"], "markdown", True), (7, "https://e.org/bad", ["teleport"], None, None), (8, "https://e.org/a b", ["decodo"], "markdown", False),
    ]
    requests = spark.createDataFrame([(p, u, m, f, i, None, None) for p, u, m, f, i in rows], io.REQUESTS)
    log = spark.createDataFrame([
        ("https://e.org/a b", "decodo", at(1), "<p>old</p>", None, None, 1.0), ("https://e.org/a b", "decodo", at(2), "<p>new</p><img src='/i.png'>", None, None, 2.0), ("https://e.org/a b", "firecrawl", at(1), None, "RateLimit", "slow down", 0.5),
        ("https://e.org/empty", "firecrawl", at(1), "", None, None, 0.1), ("https://e.org/empty", "decodo", at(1), "<p>x</p>", None, None, 0.1), ("https://e.org/y.jpg", "decodo", at(1), None, None, None, 0.1),
    ], LOG)
    blobs = spark.createDataFrame([("https://e.org/x.jpg", "image", "m" * 40, 300, 300), ("https://e.org/y.jpg", "video", "v" * 40, None, None), ("https://e.org/i.png", "image", "i" * 40, 300, 300)], BLOBS)
    got = {r.pos: r for r in retrieve(requests, log, policy.load_domain_policy(spark), blobs).collect()}
    token = "<image:" + "i" * 32 + ">"
    assert sorted(got) == list(range(9))
    # the last request of an address decides for all that repeat it; two spellings stay two requests
    assert [(got[k].method, got[k].text) for k in (0, 2)] == [("decodo", "<p>new</p><img src='/i.png'>")] * 2 and {k: e.cls for k, e in got[0].errors.items()} == {"firecrawl": "RateLimit"}
    assert [(got[k].text, len(got[k]["items"])) for k in (1, 8)] == [("new\n\n![](/i.png)", 0)] * 2 and got[1].retrieval_time == 2.0
    assert not got[3].successful and {m for m in got[3].errors} == {"firecrawl", "decodo"} and got[3].errors["decodo"].message == "Method decodo returned no content."
    assert (got[4].method, got[4].text, got[4].successful) == ("firecrawl", "", True)
    assert (got[5].method, got[5].text, got[5]["items"][0].token) == ("Direct download", "<image:" + "m" * 32 + ">", "<image:" + "m" * 32 + ">")
    assert not got[6].successful and list(got[6].errors) == ["decodo"]
    assert {k: e.message for k, e in got[7].errors.items()} == {"plan": "unknown_method"}
    again = retrieve(spark.createDataFrame([(0, "https://e.org/a b", ["firecrawl", "decodo"], None, None, None, None)], io.REQUESTS), log, policy.load_domain_policy(spark), blobs).first()
    assert (again.method, again.text, again.errors["firecrawl"].cls) == ("decodo", "new\n\n" + token, "RateLimit")
    assert retrieve(requests.limit(0), log, policy.load_domain_policy(spark)).count() == 0
    assert {r.pos: r.successful for r in retrieve(requests, log.limit(0), policy.load_domain_policy(spark)).collect()} == dict.fromkeys(range(9), False)

"""URL filters against a rule-by-rule test of every url."""

import random

import pytest

from sievelake.llm.url_filter import judged

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
         ("Example.org", "", "block"), ("example.org", "/a", "allow"), ("example.org", "/a", "block"), (None, "/", "block"), ("x.net", None, "allow")]
URLS = [None, "", "no scheme", "https://", "http://WWW.Example.COM/en/1?q#f", "https://example.com/en", "https://example.com/en/",
        "https://notexample.com/en/x", "https://a.b.net/es/?x", "https://net/es/1", "http://example.org", "http://sub.example.org/ab#c",
        "ftp://x.net?y=/es/", "a://b://example.com/en/", "https://é.com/😀/", "https://example.com\n/en/", "https://www.example.com/en/x" * 50]


def expected(url, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0] or [len(rest)])
        host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    found = []
    for h, p, v in RULES:
        h, p = (h or "").lower(), p or ""
        if h and (host == h or host.endswith("." + h)) and path.startswith(p):
            found.append((len(h) + len(p), len(h), h + p, v))
    best = max(found, default=(0, 0, None, default))
    return host, path, best[2], best[3]


@pytest.mark.parametrize("limit", [1000, 0])
def test_every_url(spark, limit):
    labels = ["com", "example", "www", "net", "es", "org", "x"]
    rng = random.Random(3)
    urls = URLS + ["http://" + ".".join(rng.choices(labels, k=rng.randint(1, 4))) + rng.choice(["", "/", "/en/", "/es/a", "/a", "/en"]) for _ in range(300)]
    rows = spark.createDataFrame([(i, u, "kept", 7) for i, u in enumerate(urls)] * 2, "page_id long, url string, prefix string, host int")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = judged(rows, rules, broadcast_rules=limit).collect()
    assert len(got) == 2 * len(urls)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == expected(urls[r["page_id"]]), urls[r["page_id"]]
        assert r["prefix"] == "kept"


def test_without_rules_or_urls(spark):
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    rows = spark.createDataFrame([("https://a.com/x",)], "url string")
    assert [tuple(r) for r in judged(rows, rules, default="block").collect()] == [("https://a.com/x", "a.com", "/x", None, "block")]
    assert judged(rows.limit(0), spark.createDataFrame(RULES, rules.schema)).collect() == []

import random

import pytest
from pyspark.sql import functions as F

from geoloom.llm import url_filter

RULES = [*url_filter.RULES, ("b.example.org", "/", "block"), ("org", "/es/long/path", "block"), ("tie.org", "/a", "allow"), ("tie.org", "/a", "block"), (None, "/", "block"), ("x", None, "block"), ("Upper.COM", "/", "block")]
URLS = [
    "http://a.org/es/1", "http://example.org/es/1", "https://WWW.Example.ORG/es/", "http://notexample.org/es/", "http://example.org/en/123?x=/es/", "http://example.org/en/2", "http://x.com/fr/a#b", "http://com/de/",
    "http://x.net/fr/", "no scheme", "", None, "http://", "://h.org/", "http://org", "http://tie.org/abc", "http://b.example.org/es/x", "http://c.b.example.org/q", "http://a..org/", "http://.org/", "http://upper.com/", "http://h.org?/es/",
    "a://b://c.org/", "http://" + "a." * 500 + "example.org/es/" + "p" * 5000, "http://user@example.org:80/es/", "http://é.org/es/long/path/1",
]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for h, p, action in RULES:
        if h is None or p is None:
            continue
        h = h.lower()
        if host and (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (-1,), (len(h) + len(p), len(h), h + p, action == "block"))
    return host, path, best[2] if best else None, "block" if best and best[3] else "allow"


@pytest.mark.parametrize("broadcast", [True, False])
def test_against_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(url_filter, "BROADCAST_RULES", 0)
    rng = random.Random(3)
    urls = URLS + [f"http://{rng.choice(['a.', 'b.', ''])}{rng.choice(['example', 'tie', 'x'])}.{rng.choice(['org', 'com'])}{rng.choice(['/es/', '/en/1', '/fr/', '/de/', '/a', ''])}{rng.randint(0, 99)}" for _ in range(300)]
    pages = spark.createDataFrame([(i, u, "r", "v") for i, u in enumerate(urls)], "page_id long, url string, rule string, verdict string").repartition(3)
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, rules).collect()}
    assert got == {i: brute(u) for i, u in enumerate(urls)}


def test_rows_stay(spark):
    pages = spark.createDataFrame([(1, "http://a.org/"), (1, "http://a.org/"), (None, None)], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    assert url_filter.judge(pages, rules).count() == 3
    assert url_filter.judge(pages.limit(0), rules).isEmpty()
    rows = url_filter.judge(pages, rules.limit(0)).collect()
    assert len(rows) == 3 and all(r["rule"] is None and r["verdict"] == "allow" for r in rows)


def test_kept_columns_may_have_any_name(spark):
    names = ["digest", "short", "salt", "best", "row", "kept", "none", "r_short", "block"]
    pages = spark.createDataFrame([(*range(len(names)), "http://a.org/")], ", ".join(f"{n} long" for n in names) + ", url string")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    row = url_filter.judge(pages, rules, keep=tuple(names)).first()
    assert [row[n] for n in names] == list(range(len(names))) and row["rule"] == "org/"
    assert url_filter.judge(pages, rules, keep=()).columns == ["host", "path", "rule", "verdict"]
    with pytest.raises(ValueError, match="rule"):
        url_filter.judge(pages.withColumnRenamed("best", "rule"), rules, keep=("rule",))


def test_digests_decide(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    rules = spark.createDataFrame([("org", "/", "block")], "host string, path string, action string")
    real = url_filter.prepare_rules(rules)
    fake = real.withColumn("digest", F.concat(F.substring("digest", 1, 8), F.lit("0" * 56)))
    url_filter_prepare, url_filter.prepare_rules = url_filter.prepare_rules, lambda _: fake
    try:
        assert url_filter.judge(pages, rules).first()["rule"] is None
    finally:
        url_filter.prepare_rules = url_filter_prepare

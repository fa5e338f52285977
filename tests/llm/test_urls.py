"""URL lists against a loop over all entries."""

import datetime as dt
import random

from sonarrow.llm import url_lists

DAY = dt.date(2024, 1, 1)


def listed(entries, key, day):
    best = {}
    for k, d, on in entries:
        if k == key and d is not None and d <= day:
            best[d] = best.get(d, False) or on
    return max(best) if best and best[max(best)] else None


def test_against_loop(spark):
    rng = random.Random(3)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org", "lone"]
    entries = [(rng.choice([*hosts, "a.com/p", "b.org/q"]), DAY + dt.timedelta(rng.randrange(400)), rng.random() < 0.6) for _ in range(60)]
    entries += [(None, DAY, True), ("b.org", None, True)]
    urls = [f"https://{rng.choice(hosts)}{rng.choice(['', '/', '/p', '/p/1?x=2', '/q#f'])}" for _ in range(300)]
    captures = [(i, u, DAY + dt.timedelta(rng.randrange(500)), "k") for i, u in enumerate(urls)]
    captures += [(900, None, DAY, "k"), (901, "no url", DAY, "k"), (902, "http://A.com/p", None, "k"), (1, urls[1], captures[1][2], "k")]
    c = spark.createDataFrame(captures, "page_id long, url string, fetched date, key string")
    e = spark.createDataFrame(entries, "key string, day date, listed boolean")
    got = url_lists.evaluate(c, e).collect()
    assert len(got) == len(captures)
    for r in got:
        host = (r.url or "").split("://")[-1].split("/")[0].split("#")[0].lower() if "://" in (r.url or "") else ""
        path = "/" + r.url.split("/", 3)[3].split("/")[0].split("?")[0].split("#")[0] if host and r.url.count("/") > 2 else ""
        labels = host.split(".")
        keys = [".".join(labels[i:]) for i in range(max(1, len(labels) - 1))] if host else []
        keys += [host + path] if len(path) > 1 else []
        on = {k: listed(entries, k, r.fetched) for k in keys} if r.fetched else {}
        on = {k: v for k, v in on.items() if v}
        assert (r.host, r.n_active) == (host, len(on)), r
        if on:
            top = max(on, key=lambda k: (len(k), k))
            assert (r.entry_key, r.entry_from) == (top, on[top])
        else:
            assert r.entry_key is None and r.entry_from is None


def test_empty(spark):
    c = spark.createDataFrame([], "page_id long, url string, fetched date")
    e = spark.createDataFrame([], "key string, day date, listed boolean")
    assert url_lists.evaluate(c, e).count() == 0
    one = spark.createDataFrame([(1, "http://a.com/", DAY)], "page_id long, url string, fetched date")
    assert [r.n_active for r in url_lists.evaluate(one, e).collect()] == [0]
    assert url_lists.evaluate(c, spark.createDataFrame([("a.com", DAY, True)], e.schema)).count() == 0


def test_clashing_columns_and_addresses(spark):
    c = spark.createDataFrame([(1, "http://10.1.2.3/p", DAY, 7, 7, 7), (2, "http://a.b.com/", DAY, 7, 7, 7)], "page_id long, url string, fetched date, HOST int, entry_key int, _day int")
    e = spark.createDataFrame([("2.3", DAY, True), ("10.1.2.3/p", DAY, True), ("b.com", DAY, True)], "key string, day date, listed boolean")
    got = url_lists.evaluate(c, e)
    assert got.columns == ["page_id", "url", "fetched", "_day", "host", "n_active", "entry_key", "entry_from"]
    assert {r.page_id: (r.host, r.n_active, r.entry_key) for r in got.collect()} == {1: ("10.1.2.3", 1, "10.1.2.3/p"), 2: ("a.b.com", 1, "b.com")}
    assert url_lists.evaluate(c.where("page_id < 0"), e).count() == 0 and url_lists.evaluate(c, e.where("key = ''")).where("n_active > 0").count() == 0


def test_hosts(spark):
    """Addresses in brackets are hosts of their own, and the dot that ends a full name is no part of it."""
    from pyspark.sql import functions as F

    rows = [
        ("http://[::1]/x", "[::1]", ["[::1]", "[::1]/x"]),
        ("http://u@[FE80::1.2.3.4]:80/", "[fe80::1.2.3.4]", ["[fe80::1.2.3.4]"]),
        ("https://a.b.Example.com./p/q", "a.b.example.com", ["a.b.example.com", "a.b.example.com/p", "b.example.com", "example.com"]),
        ("http://10.0.0.1/", "10.0.0.1", ["10.0.0.1"]),
        ("http://[broken/x", "[broken", ["[broken", "[broken/x"]),
        ("http://./x", "", []),
    ]
    d = spark.createDataFrame([r[:2] for r in rows], "url string, want string")
    got = d.select(url_lists.host_of(F.col("url")).alias("h"), url_lists.path_of(F.col("url")).alias("p")).select("h", url_lists.keys_of(F.col("h"), F.col("p")).alias("k")).collect()
    assert [(r.h, sorted(r.k)) for r in got] == [(h, sorted(k)) for _, h, k in rows]
    c = spark.createDataFrame([("http://[::1]/x", DAY), ("http://[::2]/x", DAY), ("http://a.b.example.com.", DAY)], "url string, fetched date")
    e = spark.createDataFrame([("[::1]", DAY, True), ("example.com", DAY, True)], "key string, day date, listed boolean")
    assert [(r.url, r.n_active) for r in url_lists.evaluate(c, e).orderBy("url").collect()] == [("http://[::1]/x", 1), ("http://[::2]/x", 0), ("http://a.b.example.com.", 1)]

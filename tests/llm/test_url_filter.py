"""URL filters: exact membership of the cascade, rules against brute force."""

import random

from pathlens.llm import url_filter
from pyspark.sql import functions as F


def test_cascade_is_exact_over_its_universe(spark):
    rng = random.Random(3)
    universe = [f"{rng.randrange(10**9)}.example/{i}" for i in range(3000)]
    listed = universe[:40]
    frame = spark.createDataFrame([(k,) for k in universe], "key string")
    levels = url_filter.build_cascade(frame, listed)
    assert len(levels) >= 2                     # false positives of level 1 had to be encoded
    got = {r["key"] for r in frame.where(url_filter.in_cascade(F.col("key"), levels)).collect()}
    assert got == set(listed)


def brute(url, rules, default):
    at = url.find("://") if url is not None else -1
    rest = url[at + 3:] if at >= 0 else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = tail[:min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, default))
    return host, path, best[1], best[2]


def test_rules_against_brute_force(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.NET/x", "http://net", "http://net/", "http://xnet/", "http://a.net?x=/",
            "https://b.example.net/en/1?x#y", "https://example.net/en", "https://example.net/EN/", "http://x.example.com/de/#t",
            "http://example.com/de/", "ftp://a.b.org/fr/x", "http://org/fr/", "a://b://c.net/", "http://é.net/ü?", "http://a.net:80/",
            "http://a.net/x", "http://a.net/x"]
    frame = spark.createDataFrame([(i, u, 1, 2) for i, u in enumerate(urls)], "page_id int, url string, host int, key int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(frame).collect()}
    assert got == {i: brute(u, url_filter.RULES, "allow") for i, u in enumerate(urls)}


def test_block_wins_and_empty_inputs(spark):
    rules = (("a.org", "/", "allow"), ("a.org", "/", "block"))
    frame = spark.createDataFrame([("http://a.org/",)], "url string")
    assert url_filter.judge(frame, rules).first()["verdict"] == "block"
    assert url_filter.judge(frame, (("b.org", "/", "allow"),), "block").first()["verdict"] == "block"
    assert url_filter.judge(frame.limit(0)).count() == 0


def test_long_lists_of_many_shapes(spark):
    rng = random.Random(4)
    rules = []
    for i in range(100_000):
        labels, length = rng.randrange(1, 7), rng.randrange(1, 6)
        rules.append((".".join(f"h{rng.randrange(2000)}" for _ in range(labels)), "/" + "".join(rng.choices("abc", k=length - 1)), rng.choice(["block", "allow"])))
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values())
    assert len({(h.count("."), len(p)) for h, p, _ in rules}) == 30
    urls = []
    for i in range(3000):
        h, p, _ = rng.choice(rules)
        urls.append(f"http://{rng.choice(['', 'www.', 'x'])}{h}{p}{rng.choice(['', 'a', '/b'])}")
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    by_key = {h + p: v for h, p, v in rules}

    def want(url):
        host, path, _, _ = brute(url, (), "allow")
        parts = host.split(".")
        keys = [".".join(parts[-n:]) + path[:k] for n in range(1, min(6, len(parts)) + 1) for k in range(1, 6) if k <= len(path)]
        best = max(((len(k), k, by_key[k]) for k in keys if k in by_key), default=(0, None, "allow"))
        return best[1], best[2]

    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(frame, rules).collect()}
    assert got == {i: want(u) for i, u in enumerate(urls)}
    assert sum(v == "block" for _, v in got.values()) > 500

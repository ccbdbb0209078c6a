import math
import random
import re
import time
from itertools import combinations

from loamspark.llm import urls

SMALL = "/root/testdata/sf0.01"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path):
    fits = [r for r in urls.FIXED if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.rule), default=None)


def test_whole_table(spark):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    out = {r["page_id"]: r for r in urls.op4_urls(spark, SMALL).collect()}
    assert out.keys() == pages.keys()
    for i, u in pages.items():
        r = rule_of(*parts(u))
        assert (out[i]["host"], out[i]["path"]) == parts(u)
        assert out[i]["rule"] == (r.rule if r else None)
        assert out[i]["verdict"] in ("allow", "block")
        assert not r or out[i]["verdict"] == r.verdict


ODD = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.org/es/1?x#y", "a://b://c/d", "http://xexample.org/es/1", "https://www.example.com/de/5#a?b", "https://example.com?/de/", "http://Ä.com/fr/\n/x", "x\n://sub.org/q", "https://org/es/", "http://example.org:80/es/"]


def test_odd_urls(spark):
    pages = spark.createDataFrame([(k, u, "own", 5) for k, u in enumerate(ODD * 2)], "page_id long, url string, host string, verdict int")
    out = urls.filtered(pages)
    assert sorted(out.columns) == sorted(["page_id", "url", "host", "path", "rule", "verdict"])
    rows = out.collect()
    assert len(rows) == 2 * len(ODD)
    for r in rows:
        rule = rule_of(*parts(r["url"]))
        assert (r["host"], r["path"]) == parts(r["url"])
        assert r["rule"] == (rule.rule if rule else None)


def test_mined_rules_decide_what_fixed_rules_do_not(spark):
    rows = [(f"http://shop.spam{k % 3}.com/de/casino/{k}",) for k in range(60)] + [(f"http://good{k % 3}.com/fr/news/{k}",) for k in range(60)]
    rows += [("http://other.net/de/casino/7",), ("http://other.net/fr/news/7",), ("http://other.net/zzz",)]
    out = {r["url"]: r for r in urls.filtered(spark.createDataFrame(rows, "url string")).collect()}
    assert out["http://other.net/de/casino/7"]["verdict"] == "block" and out["http://other.net/de/casino/7"]["rule"] is None
    assert out["http://other.net/fr/news/7"]["verdict"] == "allow"
    assert out["http://other.net/zzz"]["verdict"] == urls.DEFAULT


def test_empty(spark):
    assert urls.filtered(spark.createDataFrame([], "page_id long, url string")).collect() == []


def brute_verdicts(rows, asked, support, confidence):
    """For tests: every one, two or three of a URL's tokens are a candidate; rules of least length; the best that fires."""
    n = len(rows)
    least = max(1, math.ceil(support * n - 1e-9))
    subsets = {c for t, _ in rows for k in (1, 2, 3) for c in combinations(sorted(t), k)}
    rules = {}
    for c in sorted(subsets, key=lambda c: (len(c), c)):
        seen = [v for t, v in rows if set(c) <= t]
        for v in ("allow", "block"):
            k = seen.count(v)
            if k >= least and k / len(seen) >= confidence and not any((p, v) in rules for j in range(1, len(c)) for p in combinations(c, j)):
                rules[c, v] = (-k / len(seen), -k, v != "block")
    return [min(((rank, v) for (c, v), rank in rules.items() if set(c) <= t), default=(0, None))[1] for t in asked]


def test_mined_verdicts_equal_a_brute_force_miner(spark):
    for seed in range(4):
        rng = random.Random(seed)
        draw = lambda: {x for x in "abcdefg" if rng.random() < 0.45} | ({"s", "t", "u"} if rng.random() < 0.3 else set())
        rows = [(t, rng.choice(("allow", "block")) if rng.random() < 0.3 else "block" if {"a", "b"} <= t or "c" in t and "s" in t else "allow") for t in (draw() for _ in range(120))]
        asked = [draw() for _ in range(60)]
        labelled = spark.createDataFrame([(sorted(t), v) for t, v in rows], "tokens array<string>, verdict string")
        mined = urls.mine(labelled, 0.04, 0.75)
        frame = spark.createDataFrame([(k, sorted(t)) for k, t in enumerate(asked)], "k int, tokens array<string>")
        got = {r["k"]: r["v"] for r in frame.select("k", urls.fires(frame["tokens"], mined).alias("v")).collect()}
        assert [got[k] for k in range(60)] == brute_verdicts(rows, asked, 0.04, 0.75)
        assert any(len(a) > 1 for a, _ in mined.rules)


def test_shared_tokens_cost_nothing(spark):
    """URLs that share 30 tokens, all or all but one of them, and of both verdicts: their combinations are bounded."""
    words = [f"w{chr(97 + k // 5)}{chr(97 + k % 5)}" for k in range(30)]
    rows = [(f"http://site.example.com/de/{'/'.join(words)}/{k}",) for k in range(50)] + [(f"http://other.com/de/{'/'.join(w for w in words if w != words[k % 30])}",) for k in range(60)]
    rows += [(f"http://news.com/fr/{'/'.join(words[:20])}/x{k}",) for k in range(50)]
    pages = spark.createDataFrame(rows, "url string")
    began = time.time()
    out = urls.filtered(pages).collect()
    assert len(out) == len(rows) and time.time() - began < 60


def test_long_urls(spark):
    rows = [(1, "http://a.com/de/" + "x/" * 200_000), (2, "http://" + "h." * 50_000 + "com/fr/?" + "q" * 100_000), (3, "://" * 50_000)]
    out = {r["page_id"]: r for r in urls.filtered(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert all((out[i]["host"], out[i]["path"]) == parts(u) for i, u in rows)
    assert out[1]["verdict"] == "block" and out[2]["verdict"] == "allow"

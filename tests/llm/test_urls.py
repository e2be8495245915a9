from collections import Counter
from math import log

from airlattice.llm import urls


def rule(host, path):
    fits = [(r, v) for r, v in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[:end]


ODD = [None, "", "nope", "http://", "https://A.Example.COM/en/7?x", "ftp://com/en/", "http://com/en/1", "x://net/de/#", "http://example.net/de/8", "http://sub.example.net/de/81", "http://xcom/en/", "a://b://c/d", "http://org/es/é\nz", "http://ORG?/es/", "http://É.org/es/1"]


def test_hosts_and_rules(spark, sf):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(ODD)], "page_id long, url string, host string").unionByName(spark.read.parquet(f"{sf}/pages.parquet").selectExpr("page_id + 1000 as page_id", "url", "'y' as host"))
    out = urls.judge(pages).collect()
    assert len(out) == pages.count()
    for r in out:
        assert (r.host, r.path) == parts(r.url)
        name, verdict = rule(r.host, r.path)
        assert r.rule == name and (verdict is None or r.verdict == verdict) and r.verdict in ("allow", "block")


def test_scores_match_brute_force(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    k = len(urls.ALPHABET)
    fold = lambda s: "".join("0" if c.isdigit() else c if c in urls.ALPHABET[3:] or c == "0" else "*" for c in s.lower())
    grams = lambda s: [tuple(("^^" + fold(s) + "$")[i : i + 3]) for i in range(len(s) + 1)]
    import zlib

    counts = {"allow": Counter(), "block": Counter()}
    rows = [(p.page_id, *parts(p.url)) for p in pages.collect()]
    for _, h, p in rows:
        v = rule(h, p)[1]
        if v and zlib.crc32((h + p).encode()) % 2 == 0:
            counts[v].update(grams(h + p))

    def prob(c, g):
        n1, n2, n3 = Counter(), Counter(), Counter()
        for x, n in c.items():
            n3[x] += n
            n2[x[1:]] += n
            n1[x[2:]] += n
        p = 1 / k
        for order, ctx in ((n1, ()), (n2, g[1:2]), (n3, g[:2])):
            mine = {x: n for x, n in order.items() if x[:-1] == ctx}
            total = sum(mine.values())
            if total >= (urls.MIN_CONTEXT if ctx else 1):
                p = (mine.get((*ctx, g[2]), 0) + len(mine) * p) / (total + len(mine))
        return p

    got = {r.page_id: r.score for r in urls.judge(pages).collect()}
    for page, h, p in rows[:8]:
        g = grams(h + p)
        if counts["allow"] and counts["block"]:
            want = sum(round(1e6 * (log(prob(counts["allow"], x)) - log(prob(counts["block"], x)))) for x in g) / len(g) / 1e6
            assert abs(got[page] - want) < 1e-9


def test_empty(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_verdicts_of_the_calibrated_cut(spark, sf):
    import zlib

    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    out = urls.judge(pages).collect()
    known = [(r.score * urls.MICRO, rule(r.host, r.path)[1]) for r in out if rule(r.host, r.path)[1] and zlib.crc32((r.host + r.path).encode()) % 2]
    assert known

    def loss(least):
        good, bad = ([s for s, v in known if v == kind] for kind in ("allow", "block"))
        return sum(s < least for s in good) / len(good) + sum(s >= least for s in bad) / len(bad)

    least = out[0].threshold * urls.MICRO
    assert loss(least) <= min(loss(urls.STEP * (s // urls.STEP)) for s, _ in known) + 1e-9
    for r in out:
        if rule(r.host, r.path)[1] is None and r.host + r.path:
            assert r.verdict == ("allow" if r.score * urls.MICRO >= least - 1e-6 else "block")


def test_cut():
    assert urls.cut({}, {1: 2}) == 0
    assert urls.cut({10: 4, 12: 1}, {2: 3}) == 6 + 1
    assert urls.cut({10: 9, 1: 1}, {2: 3, 1: 1}) in (6, 7)

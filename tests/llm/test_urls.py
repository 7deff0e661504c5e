from leafledger.llm import url_rules

URLS = [
    "http://x.com/a", "http://x.com", "HTTP://WWW.Example.COM/en/1?q#z", "http://a.www.example.com/en/", "http://blog.example.com/en/x", "http://example.com/en",
    "https://shop.net/es/1", "https://net/fr/2", "https://netx/fr/2", "no scheme", "", None, "http://", "://com/x", "http://a.b.org/x", "http://x.com:80/a",
    "http://com/", "http://xcom/", "http://x.com./a", "a://b://net/es/", "http://x.net/es/\n?y",
]


def slow(url, rules=url_rules.RULES):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [(len(h + p), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def check(spark, urls, rules):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'x' AS host", "'x' AS rule", "0 AS slot")
    got = {r.page_id: tuple(r)[1:] for r in url_rules.filter_urls(pages, url_rules.rule_frame(spark, rules)).collect()}
    assert got == {k: slow(u, rules) for k, u in enumerate(urls)}


def test_awkward_urls(spark):
    check(spark, URLS, url_rules.RULES)


def test_many_nested_rules_and_one_hot_host(spark):
    hosts = ["com", "a.com", "b.a.com", "c.b.a.com", "org", "z.org"]
    rules = [("block" if (k + n) % 2 else "allow", h, p) for k, h in enumerate(hosts) for n, p in enumerate(["/", "/x/", "/x/y", ""])]
    urls = [f"http://{h}{p}" for h in [*hosts, "d.c.b.a.com", "aa.com", "b.org"] for p in ("", "/", "/x", "/x/", "/x/yz", "/w?x")]
    check(spark, urls + [f"http://b.a.com/x/{k}" for k in range(3_000)], rules)


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.com/"), (None, None), (1, "http://a.com/")], "page_id long, url string")
    rules = url_rules.rule_frame(spark, url_rules.RULES)
    assert url_rules.filter_urls(pages.limit(0), rules).count() == 0
    rows = url_rules.filter_urls(pages, rules.limit(0)).collect()
    assert len(rows) == 3 and all(r.rule is None and r.verdict == "allow" for r in rows)

from tapeloom.llm import url_filters as u

CASES = [
    ("https://A.Example.ORG/es/x?q#f", "a.example.org", "/es/x", "example.org/es/", "block"),
    ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
    ("http://example.org/fr/", "example.org", "/fr/", "org/", "allow"),
    ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ("https://x.com/de/1", "x.com", "/de/1", "com/de/", "block"),
    ("https://x.com/fr/1", "x.com", "/fr/1", "com/fr/", "allow"),
    ("https://x.com", "x.com", "", None, "allow"),
    ("https://www.spam-farm.net/a", "www.spam-farm.net", "/a", None, "block"),
    ("https://www.spam-farm.org/a", "www.spam-farm.org", "/a", "org/", "allow"),
    ("https://x.net/ads/1", "x.net", "/ads/1", None, "block"),
    ("x.com/de/", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("https://x.com?a=/b", "x.com", "", None, "allow"),
    ("https://x.net/" + "a" * 100_000, "x.net", "/" + "a" * 100_000, None, "allow"),
]


def test_judges(spark):
    df = spark.createDataFrame([(k, c[0], "h") for k, c in enumerate(CASES)] * 2, "page_id long, url string, rules string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in u.judge(df).collect()}
    for k, c in enumerate(CASES):
        assert got[k] == c[1:], c[0]
    assert u.judge(df).count() == 2 * len(CASES)
    assert u.judge(df.limit(0)).count() == 0


def test_rarest_token_indexes_without_changing_results(spark):
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(CASES)], "page_id long, url string")
    counts = u.token_counts(df, ["spam", "farm", "ads"])
    assert counts == {"spam": 2, "farm": 2, "ads": 1}
    key = lambda d: sorted(map(tuple, d.select("page_id", "verdict").collect()))
    assert key(u.judge(df, counts=counts)) == key(u.judge(df, counts={"spam": 9, "farm": 0}))


FIRING = ["http://my-casino.net/x", "http://casino.shop.net", "http://casinos.net/", "http://x.net/login", "http://x.net/a/login.php", "http://x.net/logins", "http://a.net/wp-content/plugins/x-ads/1", "http://a.net/tag/page/12/", "http://a.net/tag/page/x", "http://a.net/cgi-bin/redirect?u", "http://b.net/buy-pills-online/", "http://b.net/robots.txt", "http://porn.example.org/fr/", "http://x.tracker.net", "http://xtracker.net"]


def test_pattern_rules_fire_and_a_long_list_is_joined(spark):
    import re

    urls = [c[0] for c in CASES] + FIRING * 3
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    more = u.PATTERN_RULES + tuple(("block", rf"/long{k}(/|$)", (f"long{k}",)) for k in range(3000))
    key = lambda d: sorted(map(tuple, d.select("page_id", "host", "path", "rule", "verdict").collect()), key=lambda r: r[0])
    plain, joined = key(u.judge(df)), key(u.judge(df, patterns=more))
    assert plain == joined == key(u.judge(df, inline=0))
    for (k, host, path, rule, verdict), url in zip(plain, urls):
        if rule is None:  # against all rules, one by one
            hit = any(v == "block" and re.search(p, (host + path).lower()) for v, p, _ in u.PATTERN_RULES)
            assert verdict == ("block" if hit else "allow"), url
    fired = {url for (*_, rule, verdict), url in zip(plain, urls) if rule is None and verdict == "block"}
    assert len(fired & set(FIRING)) == 9


def test_every_rule_is_indexed_under_tokens_that_its_matches_hold():
    assert len(u.PATTERN_RULES) > 40
    for _, pattern, tokens in u.PATTERN_RULES:
        assert tokens and all(t in pattern for t in tokens)


def test_columns_with_the_operators_own_names(spark):
    df = spark.createDataFrame([("http://x.org/a", "s", "o", "r", "q")], "url string, site string, other string, row string, host string")
    assert u.judge(df).first().asDict() == {"url": "http://x.org/a", "site": "s", "other": "o", "row": "r", "host": "x.org", "path": "/a", "rule": "org/", "verdict": "allow"}


def test_no_rules(spark):
    df = spark.createDataFrame([("http://x.org/",)], "url string")
    assert u.judge(df, sites=(), patterns=()).first().verdict == "allow"

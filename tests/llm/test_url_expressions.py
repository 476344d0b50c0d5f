import random

from kinfold.llm import queries, url_expressions

RULES = [(h, p, v) for h, p, v in queries.URL_RULES]


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
        path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[2], max(fits)[3]) if fits else (host, path, None, default)


def judged(spark, urls, rules):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    frame = spark.createDataFrame(rules, "host string, path string, verdict string")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_expressions.judge(pages, frame).collect()}


def test_rules_win_as_by_brute_force(spark):
    draw = random.Random(8)
    urls = [None, "", "no scheme", "http://", "://", "a://b://com/x", "http://WWW.Example.COM/en/", "http://example.com", "http://com/", "http://x.net/es/?q#f",
            "http://notexample.com/en/", "http://a.b.example.com:80/en/1", "http://é.com/ü", "http://com./", "http://.com/", "http://x.net#/es/", "x" * 50000 + "://com/" + "y/" * 20000]
    urls += ["http://" + ".".join(draw.choice(["a", "www", "example", "com", "net", "m"]) for _ in range(draw.randint(1, 5)))
             + draw.choice(["", "/", "/en", "/en/", "/en/x/y", "/es/", "/fr/1", "/e", "//en/"]) + draw.choice(["", "?a=/en/", "#/es/"]) for _ in range(300)]
    urls += urls[:20]
    finer = RULES + [("example.com", "/e", "block"), ("com", "/en/x/y", "allow"), ("a.com", "", "block"), ("net", "/", "allow"), ("m", "/en/x/", "block")]
    for rules in (RULES, finer):
        assert judged(spark, urls, rules) == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_odd_rules_and_tables(spark):
    urls = ["http://a.com/x", "http://b.com/x"]
    assert judged(spark, urls, [(None, "/", "block"), ("", "/", "block"), ("a.com", None, "block"), ("b.com", "/", None)]) == {
        0: ("a.com", "/x", "a.com", "block"), 1: ("b.com", "/x", None, "allow")}
    assert judged(spark, urls, [("COM", "/x", "allow"), ("com", "/x", "block")])[0][2:] == ("com/x", "block")
    assert judged(spark, urls, [])[1] == ("b.com", "/x", None, "allow")
    pages = spark.createDataFrame([(1, "http://a.com/", "x"), (1, "http://a.com/", "x")], "page_id bigint, url string, HOST string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = url_expressions.judge(pages, rules).collect()
    assert len(got) == 2 and got[0].__fields__.count("host") == 1 and "HOST" not in got[0].__fields__ and got[0].verdict == "allow"
    assert url_expressions.judge(pages.limit(0), rules).count() == 0

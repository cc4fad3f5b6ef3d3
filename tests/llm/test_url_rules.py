import random

from matchup.llm import url_rules as m

LOW = str.maketrans(m.__dict__.get("UPPER", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "abcdefghijklmnopqrstuvwxyz")


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:cut].translate(LOW), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, default)))


def test_against_brute_force(spark):
    rng = random.Random(1)
    hosts = ["org", "EXAMPLE.org", "a.example.org", "x.y.com", "com", "badexample.org", "a..org", "", "İ.org", "example.org:80", "net"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12.html", "/de/x", "/fr/é", "//", "/de/" + "x" * 5000]
    urls = [f"{s}{h}{p}{q}" for h in hosts for p in paths for s in ("http://", "") for q in ("", "?a=/es/", "#b")] + [None, "", "://", "a://b://c"]
    urls += ["http://a.example.org/es/1"] * 50
    rng.shuffle(urls)
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, Rule string, host string")
    rules = m.values(spark, "verdict string, host string, path string", m.RULES)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in m.judged(pages, rules).collect()}
    assert got == {i: brute(u, m.RULES) for i, u in enumerate(urls)}


def test_empty_tables_and_ties(spark):
    none = m.values(spark, "verdict string, host string, path string", [])
    pages = spark.createDataFrame([(1, "http://a.org/x"), (1, "http://a.org/x")], "page_id long, url string")
    assert [r.verdict for r in m.judged(pages, none, default="block").collect()] == ["block"] * 2
    assert m.judged(pages.limit(0), none).count() == 0
    tie = m.values(spark, "verdict string, host string, path string", [("allow", "org", "/x"), ("block", "ORG", "/x"), ("allow", None, "/")])
    assert {r.verdict for r in m.judged(pages, tie).collect()} == {"block"}

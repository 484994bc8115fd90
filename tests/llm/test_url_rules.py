import random

import pytest

from sizewise.llm.url_rules import judge_urls


def brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda f: f[:2], default=None)
    return host, path, best and best[2], best[3] if best else default


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
         ("a.net", "", "block"), ("net", "/es/x/y", "allow"), ("com", "/en/abcdefgh", "block"), ("example.com", "/en/a", "allow")]


@pytest.mark.parametrize("per_pass", [500_000, 2])
def test_against_brute_force(spark, per_pass):
    rng = random.Random(2)
    hosts = ["com", "example.com", "www.example.com", "x.www.EXAMPLE.com", "badexample.com", "net", "a.net", "b.a.net", "ba.net", "org", ""]
    paths = ["", "/", "/en", "/en/", "/en/abcdefghi", "/es/", "/es/x/y/z", "?q=/en/", "#/es/", "/EN/", "/en/?a=b://c"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)]
    urls += [None, "", "no scheme", "://", "a://b://c/en/", "http://com:80/", "http://é.com/é", "x" * 100_000 + "://com/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(5)
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = judge_urls(pages, rules, rules_per_pass=per_pass).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute(r.url, RULES), r.url


def test_nulls_clashes_and_empty_tables(spark):
    pages = spark.createDataFrame([(None, "http://a.com/", "x"), (2**60 + 1, None, "y")], "page_id long, url string, verdict string")
    rules = spark.createDataFrame([(None, "/", "block"), ("com", None, "block")], "host string, path string, verdict string")
    got = {(r.page_id, r.rule, r.verdict) for r in judge_urls(pages, rules).collect()}
    assert got == {(2**60 + 1, None, "allow"), (None, None, "allow")}
    assert judge_urls(pages.limit(0), rules).count() == 0

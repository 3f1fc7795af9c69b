"""URL rules against a plain reading of the contract."""

import random
import re

import pytest

from tidemark.llm import queries, url_filter

RULES = queries.URL_RULES


def judged(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    host = "" if rest is None else re.split(r"[/?#]", rest)[0]
    path = "" if rest is None else re.split(r"[?#]", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
    return host, path, best[0], best[1]


def test_against_plain_python(spark):
    rng = random.Random(1)
    hosts = ["example.com", "www.example.com", "WWW.Example.COM", "a.b.net", "net", "notexample.com", "x.org", "a..com", "com", "é.net", "example.com:80", ""]
    paths = ["", "/", "/en", "/en/", "/en/x/y", "/es/1", "/fr/?q=/en/", "/a//b/", "?x=://y/en/", "#top", "/EN/", "/en/" * 50]
    urls = [None, "", "no scheme", "mailto:a@b.com", "://", "http://", "a://b://c.com/en/", "http://example.com/en/\n"]
    urls += [f"{rng.choice(['http', 'HTTPS', 'x'])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)]
    rows = [(i, u, "clash", 1, 2) for i, u in enumerate(urls)] + [(1, urls[20], "clash", 1, 2)] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, _best int, _url int")
    got = url_filter.apply_rules(pages, url_filter.rules_table(spark, RULES)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == judged(r.url, RULES), r


def test_full_digests_decide_where_prefixes_collide(spark):
    rng = random.Random(2)
    rules = [(rng.choice(["allow", "block"]), f"h{i}.org", rng.choice(["/", "/a/", "/a/b/"])) for i in range(120)]
    urls = [f"http://{rng.choice(['', 'w.'])}h{rng.randrange(200)}.org{rng.choice(['/', '/a/x', '/a/b/c', '/z/'])}" for _ in range(500)] + ["http://h1.org/"] * 300 + [None] * 200
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for digits in (0, 1, 8):
        got = url_filter.apply_rules(pages, url_filter.rules_table(spark, rules), prefix_digits=digits).collect()
        assert len(got) == len(urls) and all((r.host, r.path, r.rule, r.verdict) == judged(urls[r.page_id], rules) for r in got)


def test_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x/")], "page_id long, url string")
    both = url_filter.rules_table(spark, [("allow", "a.com", "/"), ("block", "A.com", "/")])
    assert url_filter.apply_rules(pages, both).first().verdict == "block"
    none = url_filter.apply_rules(pages, both.limit(0)).first()
    assert (none.rule, none.verdict, none.host, none.path) == (None, "allow", "a.com", "/x/")
    assert url_filter.apply_rules(pages.limit(0), both).count() == 0
    for bad in (("deny", "a.com", "/"), ("allow", "", "/"), ("allow", "a.com", "x")):
        with pytest.raises(ValueError):
            url_filter.rules_table(spark, [bad])

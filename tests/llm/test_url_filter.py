"""Hosts, paths, rules and posteriors."""

import pytest

from exonloom.llm import urlfilter
from exonloom.llm.queries import RULES


def judged(spark, urls, labels=(), **options):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    outcomes = spark.createDataFrame(list(labels), "page_id long, bad int")
    return {r["page_id"]: r for r in urlfilter.judge(pages, outcomes, RULES, **options).collect()}


def test_hosts_paths_and_rules(spark):
    cases = [
        ("https://WWW.Example.COM/en/x?y#z", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        ("http://m.example.com/en/", "m.example.com", "/en/", "example.com/en/", "block"),
        ("http://myexample.com/en/", "myexample.com", "/en/", "com/", "allow"),
        ("http://a.net/es/p", "a.net", "/es/p", "net/es/", "block"),
        ("http://net/fr/p", "net", "/fr/p", "net/fr/", "block"),
        ("ftp://Ä.org?q=/a", "Ä.org", "", None, None),
        ("x://h#://b/c", "h", "", None, None),
        ("http://a.com", "a.com", "", None, None),
        ("no scheme/en/", "", "", None, None),
        ("", "", "", None, None),
        (None, "", "", None, None),
        ("http://long.com/" + "a" * 50000, "long.com", "/" + "a" * 50000, "com/", "allow"),
    ]
    got = judged(spark, [c[0] for c in cases])
    for i, (_, host, path, rule, verdict) in enumerate(cases):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), cases[i][0]
        assert got[i]["verdict"] == (verdict or "allow")


def test_posterior_is_drawn_to_its_parents(spark):
    urls = ["http://bad.spam.org/1"] * 30 + ["http://new.spam.org/"] + ["http://fine.good.org/"] * 30 + ["http://new.good.org/"] * 2
    labels = [(i, 1) for i in range(30)] + [(i, 0) for i in range(31, 61)] + [(0, 0), (5, None), (None, 1), (900, 1)]
    got = judged(spark, urls, labels)
    assert got[0]["verdict"] == "block" and got[40]["verdict"] == "allow"
    assert got[0]["bad_share"] > got[30]["bad_share"] > got[61]["bad_share"] > got[40]["bad_share"] > 0
    assert len(got) == len(urls)


def test_no_labels_no_pages_and_ports(spark):
    got = judged(spark, ["http://a.org:8080/x", "http://b.co.uk/"])
    assert {r["verdict"] for r in got.values()} == {"allow"} and got[0]["host"] == "a.org:8080"
    assert judged(spark, []) == {}
    hosts = spark.createDataFrame([("a.b.co.uk",), ("x.y.org:80",), ("localhost",)], "host string")
    domain, suffix = urlfilter.domain_and_suffix(hosts["host"])
    assert [tuple(r) for r in hosts.select(domain, suffix).collect()] == [("b.co.uk", "co.uk"), ("y.org", "org"), ("localhost", "localhost")]


@pytest.mark.parametrize("bad", [0, 1])
def test_labels_of_one_kind_only(spark, bad):
    got = judged(spark, ["http://a.org/"] * 40, [(i, bad) for i in range(40)])
    assert {r["verdict"] for r in got.values()} == {"block" if bad else "allow"}

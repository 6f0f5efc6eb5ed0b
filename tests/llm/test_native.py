"""URL reputation, license scan: SQL comparison and edge rows."""

import numpy as np
import pytest
from compare import differences
from pyspark.sql import functions as F

from traceaudit.llm import license_scan, shrinkage, url_reputation
from traceaudit.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_sql(spark, sf_dir, name):
    diff, n = differences(spark, sf_dir, QUERIES[name], ORACLE_SQL[name])
    assert not diff and n


URLS = [
    (1, "HTTP://Sub.Example.ORG/es/1?x#y"),
    (2, "http://example.org/en/17"),
    (3, "http://badexample.org/es/"),
    (4, "http://x.com/de"),
    (5, "http://x.com/de/"),
    (6, None),
    (7, "no scheme"),
    (8, "http://a.net"),
    (9, "http://a.net?q=://b.org/"),
    (10, ""),
    (11, "ftp://ÄÖ.net:80/p#f"),
    (11, "ftp://ÄÖ.net:80/p#f"),
]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in URLS], "page_id long, url string, host string")
    outcomes = spark.createDataFrame([("a.net", 0)] * 200 + [("b.net", 1)] * 200 + [("c.net", None)], "host string, good int")
    rows = url_reputation.judge_urls(pages, outcomes).collect()
    got = {r["page_id"]: r for r in rows}
    assert len(rows) == len(URLS)
    pick = lambda i: tuple(got[i][c] for c in ("host", "path", "rule", "verdict"))
    assert pick(1) == ("sub.example.org", "/es/1", "example.org/es/", "block")
    assert pick(2) == ("example.org", "/en/17", "example.org/en/1", "block")
    assert pick(3) == ("badexample.org", "/es/", "org/", "allow")
    assert pick(4)[:3] == ("x.com", "/de", None)
    assert pick(5) == ("x.com", "/de/", "com/de/", "block")
    assert pick(6)[:3] == ("", "", None) and pick(7)[:3] == ("", "", None) and pick(10)[:3] == ("", "", None)
    assert pick(8) == ("a.net", "", None, "block")
    assert pick(9)[:2] == ("a.net", "")
    assert pick(11)[:2] == ("ÄÖ.net:80", "/p")


def test_sparse_hosts_shrink(spark):
    hosts = ["good.net", "one.net", "bad.net", "new.net", "other.org"]
    outcomes = spark.createDataFrame([("good.net", 1)] * 500 + [("one.net", 0)] + [("bad.net", 0)] * 50, "host string, good int")
    post = {r["host"]: r["mean"] for r in url_reputation.host_posteriors(spark.createDataFrame([(h,) for h in hosts], "host string"), outcomes).collect()}
    assert post["bad.net"] < 0.3 < post["one.net"] < post["good.net"] and 0.3 < post["new.net"] < 0.97


def test_prior_strength_recovers_what_the_data_were_drawn_from(spark):
    rng = np.random.default_rng(4)
    for strength in (5.0, 60.0):
        rows = []
        for parent, mean in (("a", 0.8), ("b", 0.3)):
            p = rng.beta(strength * mean, strength * (1 - mean), 400)
            n = rng.integers(1, 200, 400)
            rows += [(parent, int(x), int(k)) for x, k in zip(n, rng.binomial(n, p), strict=True)]
        got = shrinkage.prior_strength(spark.createDataFrame(rows, "parent string, n long, k long"), ["parent"])
        assert 0.7 * strength < got < 1.4 * strength
    none = spark.createDataFrame([("a", 5, 5), ("b", 4, 0)], "parent string, n long, k long")
    assert shrinkage.prior_strength(none, ["parent"]) == shrinkage.DEFAULT == shrinkage.prior_strength(none.limit(0), [])


def test_domains(spark):
    hosts = ["a.b.co.uk", "b.co.uk", "co.uk", "x.y.example.com:80", "10.0.0.1", "10.0.0.1:8080", "user.github.io", "localhost", ""]
    rows = spark.createDataFrame([(h,) for h in hosts], "host string").select("host", url_reputation.registered_domain(F.col("host")), url_reputation.suffix(F.col("host"))).collect()
    assert [tuple(r)[1:] for r in rows] == [("b.co.uk", "co.uk"), ("b.co.uk", "co.uk"), ("co.uk", "co.uk"), ("example.com", "com"), ("10.0.0.1", ""), ("10.0.0.1", ""), ("user.github.io", "github.io"), ("localhost", "localhost"), ("", "")]


def test_no_outcomes_and_no_pages(spark):
    pages = spark.createDataFrame(URLS, "page_id long, url string")
    none = spark.createDataFrame([], "host string, good int")
    assert {r["verdict"] for r in url_reputation.judge_urls(pages, none).filter("rule IS NULL").collect()} == {"allow"}
    assert url_reputation.judge_urls(pages.limit(0), none).count() == 0


def test_license_edges(spark):
    long = "word " * 50_000
    docs = spark.createDataFrame(
        [
            (1, None),
            (2, ""),
            (3, "cc"),
            (4, "CC-BY, cc by CC BY"),
            (5, long + "All Rights Reserved. " + long),
            (6, "Licensed under the Apache License, Version 2.0"),
            (7, "licensed under the very apache license version 2 0"),
            (8, "general public general public license"),
            (9, "Äcc by"),
        ],
        "doc_id long, text string",
    ).selectExpr("*", "'x' AS n_words", "1 AS pos")
    got = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    assert len(got) == 9
    pick = lambda i: tuple(got[i][c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"))
    assert pick(1) == pick(2) == (0, 0, None, None, "", "", 0.0)
    assert pick(3) == (1, 0, None, None, "", "", 0.0)
    assert pick(4) == (6, 3, 0, 4, "cc-by", "cc-by", 1.0)
    assert pick(5) == (100_003, 1, 50_000, 50_000, "reserved", "reserved", 1.0)
    assert pick(6) == (8, 0, None, None, "", "apache-2.0", 1.0)
    assert got[7]["labels"] == "apache-2.0" and 0.7 <= got[7]["score"] < 1
    assert pick(8) == (5, 1, 2, 2, "gpl", "gpl", 1.0)
    assert pick(9)[1] == 0  # a letter beyond ASCII belongs to the word
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_license_scan_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "all rights reserved"), (1, "all rights reserved"), (1, "cc by"), (None, "cc by cc by")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_base"], r["labels"], r["score"]) for r in license_scan.scan(docs).collect())
    assert got == [("1", 2, 1, "cc-by", 1.0), ("1", 3, 1, "reserved", 1.0), ("1", 3, 1, "reserved", 1.0), ("None", 4, 2, "cc-by", 1.0)]


def test_license_share_counts_positions_once(spark):
    again = "permission is hereby granted " * 6  # many votes, few of the template's positions
    assert license_scan.scan(spark.createDataFrame([(1, again)], "doc_id long, text string")).first()["labels"] == ""
    with pytest.raises(ValueError):
        license_scan.template_grams(spark, templates=(("long", "w " * 70),))

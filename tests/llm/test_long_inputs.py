"""Inputs that are long in an awkward way."""

import time

import pytest

from arealis.llm import html_text, url_filter


@pytest.mark.parametrize("page", ["<b>" * 20_000 + "</u>" * 20_000, "<b>" * 20_000 + "<hr>" * 20_000, "<u><div>" + "<b>" * 20_000 + "</u>" * 20_000, "</i>" * 40_000, "<div>" * 20_000 + "<p>x" * 20_000])
def test_parser_is_linear(page):
    began = time.time()
    html_text.parse(page)
    assert time.time() - began < 20


def test_end_tags():
    texts = lambda page: [t for n in html_text.parse(page) for _, t in n.blocks]
    assert texts("<p>a<b>b</u>c</b>d</p>e") == ["abcd", "e"]
    assert texts("<b><div>x</b>y</div>z") == ["xy", "z"]
    assert texts("<ul><li>a<li>b</ul>c") == ["a", "b", "c"]


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_long_hosts(spark, most):
    labels = ".".join(["a"] * 50_000)
    urls = [(1, f"https://{labels}.example.com/en/x"), (2, "https://" + "b" * 200_000 + ".net/es/"), (3, f"http://{labels}.listed.org/" + "p" * 100_000), (4, "https://x.example.com/"), (5, "https://example.com/en/"), (6, None), (7, "no scheme")]
    pages = spark.createDataFrame([(*u, "r", "v") for u in urls], "page_id long, url string, rule string, verdict string")
    rules = spark.createDataFrame([("com/", "allow"), ("example.com/en/", "block"), ("net/es/", "block")], "rule string, verdict string")
    listed = spark.createDataFrame([("listed.org",)], "entry string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules, listed, max_entries=most).collect()}
    assert got == {1: ("example.com/en/", "block"), 2: ("net/es/", "block"), 3: (None, "block"), 4: ("com/", "allow"), 5: ("example.com/en/", "block"), 6: (None, "allow"), 7: (None, "allow")}


def test_many_entries(spark):
    """More entries than fit the array give the same answers by a join."""
    pages = spark.createDataFrame([(i, f"https://h{i % 50}.d{i}.org/p{i % 7}/x") for i in range(400)], "page_id long, url string")
    rules = spark.range(300).selectExpr("concat('d', id, '.org/p', id % 7, '/') as rule", "if(id % 2 = 0, 'block', 'allow') as verdict")
    listed = spark.range(100, 400).selectExpr("concat('h', id % 50, '.d', id, '.org') as entry")
    rows = [sorted(map(tuple, url_filter.filter_urls(pages, rules, listed, max_entries=m).collect())) for m in (1_000_000, 10)]
    assert rows[0] == rows[1] and {r[4] for r in rows[0]} == {"allow", "block"} and sum(r[3] is not None for r in rows[0]) == 300

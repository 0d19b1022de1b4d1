import html
import re

import pytest

from ordergate.llm import html_wrapper as H
from ordergate.llm.common import table

PAGE = """<!doctype html><html><head><title>t</title><style>p{{}}</style></head><body>
<div id="cookieNotice">We use cookies</div><header><h1>Site</h1></header><nav><ul>{menu}</ul></nav>
<div class="top-ad">Buy now</div><{main}><h2>{title} &amp; more</h2>{body}<div class="share-links">Share this</div>
<script>var x = "</p>";</script><form><label>Mail</label><input></form></{main}>
<section class="comments"><p>First!</p></section><aside>Side</aside><footer>&copy; us</footer></body></html>"""


def page(main, title, paragraphs, menu=3):
    body = "".join(f"<p>{p}" for p in paragraphs)
    return PAGE.format(main=main, title=title, body=body, menu="".join(f"<li><a href=/{i}>m{i}</a></li>" for i in range(menu)))


def test_main_text_of_odd_markup():
    p = H.Page(page("article", "T", ["one <b>bo</b>ld", "two < three\n & &eacute;&#33;", "tail<br>end"]))
    assert H.main_text(p, set(), None) == "T & more one bold two < three & é! tail end"
    for source, want in (("", ""), ("just text", "just text"), ("<p>a<p>b", "a b"), ("<div>x <unclosed", "x"),
                         ("<!-- a --><p>b<!-- c", "b"), ("<P CLASS='Comment'>no</P>yes", "yes")):
        assert H.main_text(H.Page(source), set(), None) == want


def test_folding_and_alignment():
    t = lambda *names: [["t", n] for n in names]
    li = [["t", "li"], ["s", "a"], ["t", "/li"]]
    folded = H.fold(t("ul") + li * 4 + t("/ul"))
    assert H.shapes(folded) == "ul +(li # /li) /ul"
    one = H.align(folded, H.fold(t("ul") + [["t", "li"], ["s", "b"], ["t", "/li"]] + t("/ul")))
    assert H.shapes(one) == "ul +(li # /li) /ul" and one[1][1][1] == ["s", None]
    more = H.align(one, t("ul") + t("hr") + t("/ul"))
    assert H.shapes(more) == "ul ?(+(li # /li)) ?(hr) /ul" or "?(hr)" in H.shapes(more)
    again = H.align(more, t("ul") + t("hr") + t("/ul"))
    assert H.shapes(again).count("hr") == 1                # learnt once
    wild = H.align(t("a", "b"), t("a") + t(*[f"x{i}" for i in range(3)]) + t("b"))
    for i in range(80):
        wild = H.align(wild, t("a", f"y{i}", "b"))
    assert len(wild) < 40                                  # endless variety becomes "anything"


def test_pages_without_article_use_the_wrapper(spark):
    """Where pages name no article, the host's main container and constant texts decide."""
    rows = []
    for i in range(12):
        rows.append((i, "http://a.example/x", f"<html><body><div class=box><h4>Fixed text of the site</h4><p>Story {i} goes on and on, line {i * 7}.</p></div>"
                                              f"<div class=links><a href=1>one</a> <a href=2>two {i}</a></div></body></html>"))
    rows += [(100, None, page("article", "N", ["x"])), (101, "nonsense", None), (102, "http://b.example/", ""), (102, "http://b.example/", "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'x' AS _host", "'y' AS state").repartition(4)
    got = H.extract(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert [by[i].text for i in range(12)] == [f"Story {i} goes on and on, line {i * 7}." for i in range(12)]
    assert by[100].text == "N & more x" and by[101].text == by[102].text == "" and by[101].n_chars == 0
    assert H.extract(df.limit(0)).collect() == []


@pytest.mark.parametrize("main", ["article", "main"])
def test_hot_host_in_many_parts(spark, monkeypatch, main):
    """Partial wrappers joined two at a time, and the join beyond the broadcast bound, give the same."""
    monkeypatch.setattr(H, "FAN", 2)
    rows = [(i, "https://Hot.example/p", page(main, f"T{i}", [f"p{j} of {i}" for j in range(i % 9 + 1)], menu=i % 5 + 1)) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(7, "page_id")
    want = {i: " ".join([f"T{i} & more"] + [f"p{j} of {i}" for j in range(i % 9 + 1)]) for i in range(60)}
    assert H.wrappers(df).count() == 1
    for bound in (0, 1 << 20):
        assert {r.page_id: r.text for r in H.extract(df, broadcast_bytes=bound).collect()} == want


def test_given_pages(spark):
    pages = table(spark, "/root/testdata/sf0.001", "pages")
    got = {r.page_id: r for r in H.extract(pages).collect()}
    for r in pages.collect():
        body = re.sub(r"</?b>", "", re.search(r"<article>(.*)</article>", r.html, re.S).group(1))
        assert got[r.page_id].text == " ".join(html.unescape(re.sub(r"<[^>]+>", " ", body)).split())
        assert got[r.page_id].n_chars == len(got[r.page_id].text)

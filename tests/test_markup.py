"""Elements by nesting, and cards through the table function."""

import pytest
from pyspark.sql import functions as F

from flatlake.functions import sqlfuncs
from flatlake.sources import markup, sites
from flatlake.sources.markup import Pick, cards, elements, selects


def inner(html, selector):
    return [html[e.start : e.end] for e in elements(html) if selects(e, selector)]


@pytest.mark.parametrize(
    "html, selector, want",
    [
        ("<div><div>a</div>b</div>", "div", ["<div>a</div>b", "a"]),
        ("<ul><li>1<li>2<p>x<p>y</ul>z", "li", ["1", "2<p>x<p>y"]),
        ("<ul><li>1<ul><li>2</li></ul><li>3</ul>", "li", ["1<ul><li>2</li></ul>", "2", "3"]),
        ("<div>a<br>b<img src=x>c</div>", "img", [""]),
        ("<div>a</p></span></div>b", "div", ["a</p></span>"]),
        ("<div>open<b>x", "b", ["x"]),
        ("<!-- <b>no</b> --><script>'<b>no</b>'</script><style><b>no</b></style><b>yes</b>", "b", ["yes"]),
        ("<script>never closed <b>no</b>", "b", []),
        ('<a title="a > b" class="x y">t</a>', "a.y", ["t"]),
        ('<a class="xy">t</a>', "a.x", []),
        ("<a href='/card/1'>t</a><a href=/other>u</a>", "a[href*=/card/]", ["t"]),
        ('<p data-k="1"><i>t</i></p><i>u</i>', "[data-k=1] i", ["t"]),
        ('<p data-k><b><i>t</i></b></p>', "p[data-k] b i", ["t"]),
        ("<DIV><B>t</B></DIV>", "div b", ["t"]),
        ("", "div", []),
        ("1 < 2 <3", "div", []),
        ('<a "<a "<a "', "a", []),
    ],
)
def test_elements(html, selector, want):
    assert inner(html, selector) == want


def test_selectors_are_checked():
    with pytest.raises(ValueError):
        inner("<p>x</p>", "p > b")


def test_picks():
    html = '<div class="c"><span>x1</span><span class="f">3/5</span><i>этаж</i><span class="f">1/2</span><a href="?a&amp;b">&lt;t&gt;&nbsp; u</a><script>s</script></div>'
    picks = {"floor": (Pick(".f", after="этаж"),), "other": (Pick(".none"), Pick(".f", text="^1")), "url": (Pick("a", "href"),), "none": (Pick("b"),), "title": (Pick("a"),)}
    assert list(cards(html, (".c",), picks)) == [(0, html[15:-6], "x1 3/5 этаж 1/2 <t> u", {"floor": "3/5", "other": "1/2", "url": "?a&b", "title": "<t> u"})]
    assert list(cards(None, (".c",), picks)) == list(cards("", (".c",), picks)) == []


def test_large_pages_are_read_once():
    deep = "<div class=c>" * 3000 + "x" + "</div>" * 3000
    assert len(elements(deep)) == 3000 and elements(deep)[0].end == len(deep) - 6
    assert len(elements("<li>" * 50_000)) == 50_000 and len(elements('<a b="' * 20_000)) < 20_000


NESTED = """<div class="a-card"><div class="wrap"><a class="a-card__title" href="/a/1"><b>1-комн</b></a></div><div class="a-card__price"><div>250</div><div>000</div></div>
  <div class="a-card"><a class="a-card__title" href="/a/2">Inner</a><div class="a-card__price">7</div></div><div class="a-card__subtitle"><div>Street</div> 1</div></div>"""


def test_nested_cards(spark):
    pages = spark.createDataFrame([(1, NESTED, "krisha"), (2, None, "krisha"), (3, "<p>", "olx"), (4, NESTED, "unknown"), (5, NESTED, None)], "page_id long, html string, site string")
    got = sites.listings(pages.filter("page_id < 3"), sites.SITES["krisha"], F.lit("2024-08-15").cast("date")).orderBy("card_no").collect()
    assert [(r["url"], r["title"], r["price"], r["address"]) for r in got] == [("https://krisha.kz/a/1", "1-комн", 250000, "Street 1"), ("https://krisha.kz/a/2", "Inner", 7, "")]
    sqlfuncs.register(spark)
    pages.createOrReplaceTempView("raw_pages")
    rows = spark.sql("SELECT page_id, card_no, fields['title'] AS title FROM raw_pages, LATERAL page_cards(html, site) ORDER BY page_id, card_no").collect()
    assert [tuple(r) for r in rows] == [(1, 0, "1-комн"), (1, 1, "Inner")]
    assert [r["page_id"] for r in sites.cards_of(pages, F.col("site")).collect()] == [1, 1]


def test_every_site_has_marks():
    for site in sites.SITES.values():
        assert site.marks and {"url", "title"} <= set(site.picks)
        for each in site.picks.values():
            for pick in each:
                assert markup._steps(pick.select)


def test_attributes_are_read_where_they_may_fit():
    """An element whose tag hasn't the words of a selector isn't taken apart; entities may stand for them."""
    from flatlake.sources.markup import elements, selects

    other, own, coded = elements('<p class="x">a</p><p class="big card">b</p><p class="c&#97;rd">c</p>')
    assert [selects(e, "p.card") for e in (other, own, coded)] == [False, True, True]
    assert other._attrs is None and own._attrs is not None

import pytest

from sluice.sources import selectors

PAGE = """<html><body><div id="main" class="list"><article class="card big" data-ref="7" id="c1"><h2>  Two&nbsp;rooms <br>in <b>Paris</b></h2><img class="pic" src="/a.jpg">
  <p class="meta"><span>3 pièces · 55.32 m²</span><span class="price">1 450 € <i>CC</i></span></p><a href="/x/12?q" title="mailto:a@b.c">see</a><p>Au 3eme etage avec ascenseur</article>
  <article class="card" data-ref=""><p>one<p>two<ul><li>x<li>y<ol><li>z</ol></ul></article></div><article class="cards"><p>not a card</p></article></body></html>"""
CASES = {
    "": ["Two rooms in Paris 3 pièces · 55.32 m²1 450 € CCseeAu 3eme etage avec ascenseur", "onetwoxyz"],
    "@data-ref": ["7", None], "h2": ["Two rooms in Paris", None], "h2 b": ["Paris", None], "h2 > b": ["Paris", None], "article > b": [None, None], ".meta .price": ["1 450 € CC", None],
    "p.meta > span => ([\\d.,]+)\\s*m²": ["55.32", None], "p span:nth-child(2) => \\d+": ["1", None], "img.pic@src": ["/a.jpg", None], "img + p": ["error", None], "a@href => /([^/?]+)(?:\\?|$)": ["12", None],
    "a[title=\"mailto:a@b.c\"]": ["see", None], "[href^='/x']": ["see", None], "[href$='q']@href": ["/x/12?q", None], "[href*='12'], li": ["see", "x"], "li:nth-child(2)": [None, "yz"], "li li": [None, "z"], "#main p": ["3 pièces · 55.32 m²1 450 € CC", "one"],
    "p:first-child": [None, "one"], ".card.big h2": ["Two rooms in Paris", None], "#c1 a@title": ["mailto:a@b.c", None], "*": ["Two rooms in Paris", "one"], "p ~ x": ["error", None], "p:nth-child(4) => prose:floor": [None, None],
    "p:nth-child(5) => prose:elevator": ["oui", None], "p:nth-child(5) => prose:floor": ["3", None], "[class~='pic']@src": ["/a.jpg", None], ".missing@href => (x)": [None, None],
}


def test_entries_over_a_page(spark):
    good = {e: want for e, want in CASES.items() if want[0] != "error"}
    df = spark.createDataFrame([("u", PAGE), ("none", None), ("empty", "<p>")], "url string, html string")
    rows = sorted(selectors.select(df, "article.card", {e: e for e in good}).collect(), key=lambda r: r["place"])
    assert [(r["url"], r["place"]) for r in rows] == [("u", 0), ("u", 1)]
    assert {e: [r["fields"][e] for r in rows] for e in good} == good


@pytest.mark.parametrize("entry", [e for e, want in CASES.items() if want[0] == "error"] + ["a => (", "> a", "a >", "=> prose:garden", "a..b"])
def test_what_cannot_be_read_is_an_error(spark, entry):
    df = spark.createDataFrame([("u", PAGE)], "url string, html string")
    with pytest.raises((ValueError, __import__("re").error)):
        selectors.select(df, "article", {"x": entry})


def test_void_and_nested_cards(spark):
    df = spark.createDataFrame([("u", "<img alt='a'><p>t</p><img alt='b'><div class=c>one<div class=c>two</div>three<p>four"), ("v", "<li>a</b><li>b")], "url string, html string")
    assert [r["fields"]["x"] for r in selectors.select(df, "img", {"x": "@alt"}).orderBy("place").collect()] == ["a", "b"]
    assert [r["fields"]["x"] for r in selectors.select(df, "div.c", {"x": ""}).orderBy("place").collect()] == ["onetwothreefour", "two"]
    assert [r["fields"]["x"] for r in selectors.select(df, "li", {"x": ""}).orderBy("place").collect()] == ["a", "b"]
    assert selectors.select(df, "td", {"x": ""}).count() == 0

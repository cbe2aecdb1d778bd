"""The cascade of claim and verdict, links and emphasised words, on hand-made pages; whole given pages parse."""

import pytest

from exposight.functions import articles as A

LONG = "one two three four five six seven eight nine ten"


@pytest.mark.parametrize(
    "html,claim,result",
    [
        ('<p itemprop="claimReviewed"> c </p><div class="claim x"> FALSE </div>', "c", "FALSE"),
        ('<p itemprop="claimReviewed">c</p>', "c", None),
        ("<p>a</p><p><span>Claim</span>: c</p><p> TRUE </p>", ": c", "TRUE"),
        ("<p><span>Claim</span></p>", "", None),
        ('<p><span>Claim:</span> c</p><p>next</p><div class="claim-old">OLD</div>', "c", "OLD"),
        ("<p><span>Claim:</span> c</p><p>next</p>", "c", "next"),
        ("<p><strong>Claim: </strong>c<p>MIXTURE", "c", "MIXTURE"),
        ("<p><font>Claim: </font>c</p><p>Status: Legend</p>", "c", "Legend"),
        ("<p><font>Claim: </font>c</p><p>other</p><table><tr><td><font>Incorrect</font></td></tr></table>", "c", "Incorrect"),
        ("<p><span>claim</span> c</p><p>x</p>", None, None),
        ("", None, None),
        (None, None, None),
    ],
)
def test_cascade(html, claim, result):
    got = A.article(html)
    assert (got["claim"], got["result"]) == (claim if claim != ": c" else got["claim"], result)
    assert claim is None or claim.strip(": ") == got["claim"].strip(": ")
    assert got["parse_result"] == ("ok" if result else "no_result")


def test_links_and_emphasis():
    html = (
        f'<div class="breadcrumb-nav"><a href="/">Home</a><a>Politics</a></div><div><p>{LONG} <i><a href="http://news.bbc.co.uk/a">x</a></i> <em>e</em></p>'
        '<p>short <a href="https://www.site.org/b">y</a></p></div><div class="article-sources-box"><p><em>no</em></p></div><a href="mailto:x">m</a><a href="/rel">r</a>'
    )
    got = A.article(html)
    assert got["categories"] == ["Home", "Politics"] and [e["text"] for e in got["emphasised"]] == ["e"]
    assert [(x["site"], x["parent"], x["grandparent"], bool(x["paragraph"])) for x in got["links"]] == [("bbc.co.uk", "i", "p", True), ("site.org", "p", "div", False)]


def test_deep_nesting():
    assert A.article("<div>" * 20_000 + "<p>x")["parse_result"] == "no_result"


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = A.articles(pages, "page_id", "html")
    assert got.count() == pages.count() and got.filter("parse_result = 'no_result'").count() == pages.count()

import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from exposight.functions.location import classify, update_location
from exposight.functions.names import align
from exposight.functions.pages import clean_url, metadata, registrable
from exposight.functions.text import stem, tokenize
from exposight.operators.series import segments
from exposight.sources.files import fold_lines


@pytest.mark.parametrize("raw, want", [("Atlanta", "GA"), ("California", "CA"), ("Big Bear City, Ca.", "CA"), ("De Pere, WI", "WI"), ("pennsville, nj", "NJ"), ("Dayton, Nevada", "NV"), ("Birmingham, England", "foreign"), ("lebanon", "foreign"), ("UK", "foreign"), ("westfield", "unparsed"), ("Weston WV", "WV"), ("Washington", "WA"), ("LA", "USA"), ("USA", "USA"), ("東京", "foreign"), ("", None), (None, None)])
def test_places(raw, want):
    assert classify(raw) == want


@pytest.mark.parametrize("name, handle, more", [("*bibin*", "binarbibinwiyar", {"binar", "wiyar", "bibinwiyar"}), ("sam undercuffler", "samunder34", {"under"}), ("Sabri Chandia", "SabriChandia", set()), ("oğuzhan yileç", "oyilec", set()), ("Angel Gutierrez", "AngelGu39440956", {"gu"}), ("Lorenzo Recio", "leprechaun2012", {"eprechaun", "leprechaun"})])
def test_handles(name, handle, more):
    assert set(align(name, handle)[1]) == more


def test_update_location():
    assert update_location("unparsed", "downtown dayton", "Dayton", "NV", "Nevada") == "NV"
    assert update_location("foreign", "dayton, abroad", "Dayton", "NV", "Nevada") == "unparsed"
    assert update_location("NV", "x", "Dayton", "NV", "Nevada") == "NV"


def test_lines_fold():
    assert fold_lines(["101\ta", "tail", "102\tb", "999\tc", "103\td\r"]) == ["101\tatail", "102\tb999\tc", "103\td"]


def test_pages():
    m = metadata("<head><title>T\n x</title><meta name=author content='A'><meta name=author content='B'></head>")
    assert m["title"] == "T  x"  # a line break becomes a space; the space after it stays
    assert m["author"] == "A,B" and m["canonical_url"] == ""
    assert registrable("a.b.example.co.uk:80") == "example.co.uk"
    assert clean_url("https://web.archive.org/web/2016/http://www.news.example.com/x") == "example.com"
    assert clean_url("https://twitter.com/some_one/status/1") == "twitter.com/some_one"


def test_tokens():
    assert tokenize("U.S. voters' #MakeItSo it's") == ["makeitso", "make", "it", "so", "usa", "voter", "it"] or "usa" in tokenize("U.S. voters")
    assert stem("voting") == "vot" and tokenize(None) == []


@given(st.lists(st.floats(-5, 5), min_size=1, max_size=30))
def test_segments_cover(values):
    ends = segments(np.array(values), 3.0)
    assert ends[-1] == len(values) and ends == sorted(set(ends))


def test_gini_and_tail(spark):
    from pyspark.sql import functions as F

    from exposight.operators.stats import gini
    from exposight.operators.tails import binomial_tail

    df = spark.createDataFrame([("a", i, v) for i, v in enumerate((1, 2, 7))] + [("b", i, 5) for i in range(2)], "g string, i int, v long")
    got = {r["g"]: r["gini"] for r in gini(df, "v", ["g"], "i").collect()}
    assert math.isclose(got["a"], 0.4) and math.isclose(got["b"], 0)
    p = spark.range(1).select(binomial_tail(F.lit(3), F.lit(10), F.lit(0.2)).alias("p")).first()["p"]
    want = sum(math.comb(10, k) * 0.2**k * 0.8 ** (10 - k) for k in range(3, 11))
    assert math.isclose(math.exp(-p), want, rel_tol=1e-9)


def test_nothing_imports_the_corpus_operators():
    import os
    import re

    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "exposight")
    for d, _, names in os.walk(root):
        if "llm" not in d.split(os.sep):
            for n in names:
                if n.endswith(".py"):
                    assert not re.search(r"^\s*(from|import) .*\bllm\b", open(os.path.join(d, n)).read(), re.M)


def test_page_anchors_hold_no_paragraphs(spark):
    from exposight.functions import pages

    html = "<title>T</title><p>one <a href='/x'>X</a> two <b><a href='/y'>Y</a></b></p>"
    df = spark.createDataFrame([(1, html), (2, None), (3, "no links")], "id long, html string").select("id", pages.page_anchors("html").alias("m")).select("id", "m.*")
    assert df.schema["links"].dataType.elementType.names == ["href", "text", "parent"]
    got = {r["id"]: (r["title"], [tuple(x) for x in r["links"]]) for r in df.collect()}
    assert got == {1: ("T", [("/x", "X", "p"), ("/y", "Y", "b")]), 2: ("", []), 3: ("", [])}

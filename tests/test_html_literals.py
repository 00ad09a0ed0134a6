"""Pages with results worked out by hand: the cases that generated pages do not hold."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from codelens.functions import html as H

TEXT = [
    ("Caf&eacute; &#8211; don&rsquo;t &#x20AC;5", "Café – don’t €5"),
    ("&amp;lt; is not &lt;", "&lt; is not <"),
    ("&unknown; &#0; &#150; AT&T", "&unknown; � – AT&T"),
    ('<p title="a > b">x</p>', "x"),
    ("<p title='it\"s > 1'>y</p>", "y"),
    ("before<script>if (a < b) { track() }", "before"),
    ("<style>p{}</style>a<!-- <p>no</p> -->b", "ab"),
    ("3 < 4 and 5", "3 < 4 and 5"),
    ("<b>bold</b>,<br/>next", "bold , next"),
    ("<>", "<"),
    ("   ", None),
]

LINKS = [
    ("<a href=/about>", ["/about"]),
    ("<a data-href='/no' href='/profile'>", ["/profile"]),
    ('<a class="x" title="href=no" HREF = "/a?b=1&amp;c=2">', ["/a?b=1&c=2"]),
    ("<a data-href='/no'>", []),
    ("<a href='/one'>x</a><A\nhref=\"/two\">y</A><abbr href='/no'>", ["/one", "/two"]),
    ("<a href=''>", [""]),
]

FIELDS = [
    ('<div class="ad-banner">no</div><div class="x ad y">yes</div>', "yes"),
    ("<div data-class='ad'>no</div><div class='ad'>yes &amp; more</div>", "yes & more"),
    ('<div class="bad ads">no</div>', ""),
]


def values(spark, expr, cases):
    frame = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, x string")
    return [r.y for r in frame.select("i", expr.alias("y")).orderBy("i").collect()]


def test_text(spark):
    got = values(spark, H.html_to_text("x"), TEXT)
    assert got == [t for _, t in TEXT]


def test_links(spark):
    assert values(spark, H.extract_links("x"), LINKS) == [x for _, x in LINKS]


def test_class_names_are_whole(spark):
    assert values(spark, H.first_tag_text("x", "div", "ad"), FIELDS) == [x for _, x in FIELDS]


def test_site_of_a_url_without_scheme_is_null(spark):
    cases = [("example.com/x",), ("https://a.b/c?d",), ("http://a.b#f",)]
    assert values(spark, H.site_root("x"), cases) == [None, "https://a.b", "http://a.b"]
    frame = spark.createDataFrame([("example.com/x", [])], "u string, links array<string>")
    assert frame.select(F.explode_outer(H.site_and_links(H.site_root("u"), "links"))).collect()[0][0] is None


@pytest.mark.parametrize("name,char", [("&NewLine;", "\n"), ("&apos;", "'"), ("&Afr;", "\U0001d504"), ("&fjlig;", "fj"), ("&#1114112;", "�")])
def test_entities(spark, name, char):
    assert values(spark, H.decode_entities("x"), [(f"a{name}b",)]) == [f"a{char}b"]

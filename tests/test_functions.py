"""Column functions on small literal tables: the edge rules of the contract."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelens.functions import codes as C
from codelens.functions import html as H
from codelens.functions import text as X


def one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("y")).first()["y"]


def col_values(spark, expr, values, schema="x string"):
    rows = spark.createDataFrame([(v,) for v in values], schema).select(expr.alias("y")).collect()
    return [r["y"] for r in rows]


def test_pad_code_keeps_long_codes(spark):
    assert col_values(spark, C.pad_code("x"), ["123", "1234567", "01111"]) == ["00123", "1234567", "01111"]
    assert one(spark, C.pad_code("x"), 123, "x int") == "00123"


def test_code_prefixes_and_cast(spark):
    df = spark.createDataFrame([("01234",), ("A",), (None,)], "x string")
    rows = df.select(*[v.alias(k) for k, v in C.code_prefixes("x").items()], C.code_as_int("x").alias("i")).collect()
    assert rows[0]["Division"] == "01" and rows[0]["Class"] == "0123" and rows[0]["i"] == 1234
    assert rows[1]["i"] is None and rows[2]["Division"] is None


def test_blank_and_fill(spark):
    assert col_values(spark, X.blank_to_empty("x"), ["<Blank>", "NaN", None, "ok"]) == ["", "", "", "ok"]


def test_normalize_and_clean(spark):
    assert one(spark, X.normalize_text("x"), "  Hello\r\nWorld\nX  ") == "hello world x"
    assert one(spark, X.clean_text("x"), " a\n•b   c ") == "a - b c"
    assert one(spark, X.clean_text("x", lower=True), "A\nB") == "a b"
    assert one(spark, X.clean_text("x"), None) is None


def test_strip_trailing_dot_only_one_final_dot(spark):
    assert col_values(spark, X.strip_trailing_dot("x"), ["ABC LTD.", "A.B", "X..", "Y"]) == ["ABC LTD", "A.B", "X.", "Y"]


def test_build_description_null_in_null_out(spark):
    df = spark.createDataFrame([("t", "d", "e"), ("t", None, "e")], "a string, b string, c string")
    rows = df.select(X.build_description(F.col("a"), F.col("b"), F.col("c")).alias("y")).collect()
    assert rows[0]["y"] == "t.d.e" and rows[1]["y"] is None


def test_tokenize(spark):
    assert one(spark, X.tokenize_words("x"), "Hello, world 42 éte") == ["hello", "world", "te"]
    assert one(spark, X.tokenize_words("x", "unicode"), "Hello, world 42 éte") == ["hello", "world", "éte"]


def test_preprocess_tags_and_domain(spark):
    assert one(spark, X.preprocess_tags("x"), "<b>The</b> Food & 3 Beverages of it") == "food beverages"
    assert one(spark, X.preprocess_domain("x"), "Principal activities: Retail, 2023 the shops!") == "retail shops"


def test_tag_activity_first_match_wins_and_it_never_hits(spark):
    vals = ["we sell food and insurance", "insurance only", "it services", "nothing here"]
    cleaned = [X.preprocess_tags(F.lit(v)) for v in vals]
    df = spark.range(1).select(*[X.tag_activity(c).alias(f"a{i}") for i, c in enumerate(cleaned)])
    r = df.first()
    assert (r["a0"], r["a1"], r["a2"], r["a3"]) == ("food & beverages", "insurance", "Other", "Other")


def test_junk_rules(spark):
    vals = ["abc", "Error 403 page", "404 NOT FOUND here", "NaN", "finance report", None, "good text"]
    word = col_values(spark, X.is_junk_text("x"), vals)
    literal = col_values(spark, X.is_junk_text("x", literal_nan=True), vals)
    assert word == [True, True, True, True, False, True, False]
    assert literal == [True, True, True, True, True, True, False]


def test_kept_value_filters_once(spark):
    df = spark.createDataFrame([("keep this",), ("403",), (None,)], "x string")
    out = df.select(X.kept_value(F.upper("x"), lambda v: ~X.junk_rule(v)).alias("y")).collect()
    assert [r["y"] for r in out] == ["KEEP THIS"]


def test_company_from_filename(spark):
    vals = ["ACME PTE LTD 2023.pdf", "A.B CORP 2023.pdf", "NAME-FY2023AR", "x.pdf"]
    assert col_values(spark, X.company_from_filename("x"), vals) == ["ACME PTE LTD", "A B CORP", "NAME", ""]


def test_query_url(spark):
    assert one(spark, X.query_url("x", dash_spaces=True), "Acme Pte") == "https://www.linkedin.com/company/Acme-Pte/about"


HTML = (
    "<!DOCTYPE html><html><head><style>p{x:1}</style><script>var a='</p>';</script></head>"
    "<body><!-- c --><div class=\"top ad\">Cat &amp; Co</div><p>One\n&lt;b&gt; | two</p>"
    "<a href=\"/About-us\">a</a><a href='https://x.org/profile'>b</a><a href=\"team\">c</a>"
    "<span>http://site.example</span></body></html>"
)


def test_html_to_text(spark):
    # decoded "&lt;b&gt;" loses its ">" (removed like the original), the "|" goes too
    assert one(spark, H.html_to_text("x"), HTML) == "Cat & Co One<b  two a b c http://site.example"
    assert one(spark, H.html_to_text("x"), "<p> </p>") is None


def test_links(spark):
    links = one(spark, H.extract_links("x"), HTML)
    assert links == ["/About-us", "https://x.org/profile", "team"]
    df = spark.createDataFrame([(HTML, "https://acme.example")], "x string, site string")
    r = df.select(H.resolve_links(H.filter_links(H.extract_links("x")), F.col("site")).alias("y")).first()["y"]
    assert r == ["https://acme.example/About-us", "https://x.org/profile"]
    r = df.select(H.resolve_links(F.array(F.lit("team")), F.col("site")).alias("y")).first()["y"]
    assert r == ["https://acme.example/team"]


def test_site_and_links_and_explode_outer(spark):
    df = spark.createDataFrame([("s", ["a"]), (None, []), (None, None)], "site string, links array<string>")
    out = df.select(F.explode_outer(H.site_and_links("site", "links")).alias("l")).collect()
    assert [r["l"] for r in out] == ["s", "a", None, None]


def test_force_https(spark):
    vals = ["https://a", "http://b/http://c", "d.com"]
    assert col_values(spark, H.force_https("x"), vals) == ["https://a", "https://b/https://c", "https://d.com"]


def test_first_tag_text(spark):
    df = spark.createDataFrame([(HTML,)], "x string")
    r = df.select(
        H.first_tag_text("x", "div", "ad").alias("cat"),
        H.first_tag_text("x", "span", must_contain="http").alias("site"),
        H.first_tag_text("x", "h1").alias("none"),
    ).first()
    assert (r["cat"], r["site"], r["none"]) == ("Cat & Co", "http://site.example", "")


def test_profile_fields_with_original_classes(spark):
    page = ('<div class="org-top-card-summary-info-list__info-item">\n  IT Services  </div>'
            '<span class="link-without-visited-state">Follow</span>'
            '<span class="link-without-visited-state"> https://acme.example </span>'
            '<p class="break-words white-space-pre-wrap t-black--light text-body-medium">We build &amp; run systems.</p>')
    df = spark.createDataFrame([(page,), ("<html></html>",)], "x string")
    rows = df.select(*[v.alias(k) for k, v in H.profile_fields("x").items()]).collect()
    assert (rows[0]["category"], rows[0]["website"], rows[0]["text"]) == ("IT Services", "https://acme.example",
                                                                         "We build & run systems.")
    assert (rows[1]["category"], rows[1]["website"], rows[1]["text"]) == ("", "", "")

"""Column functions on generated and on chosen strings: what must hold of any
result, and results worked out by hand."""

from __future__ import annotations

import re
import string

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codelens.functions import codes as C
from codelens.functions import text as X

ALPHABET = st.sampled_from(list("abcXYZ .\n\t•-_0123"))
TEXTS = st.lists(st.text(ALPHABET, max_size=20), min_size=1, max_size=40)
SETTINGS = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


def _apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r["y"] for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


@SETTINGS
@given(TEXTS)
def test_cleaned_text(spark, values):
    got = _apply(spark, X.clean_text, values)
    assert not [g for g in got if "  " in g or "\n" in g or "•" in g or g != g.strip()]
    assert _apply(spark, X.clean_text, got) == got, "cleaning twice changes nothing"
    assert [re.sub(r"[\s-]", "", g) for g in got] == [re.sub(r"[\s•-]", "", v) for v in values], "nothing else is lost"
    assert _apply(spark, lambda c: X.clean_text(c, lower=True), values) == [g.lower() for g in got]


@SETTINGS
@given(TEXTS)
def test_normalized_text(spark, values):
    got = _apply(spark, X.normalize_text, values)
    assert not [g for g in got if "\n" in g or g != g.lower()]
    assert _apply(spark, X.normalize_text, got) == got
    assert [g.split() for g in got] == [v.lower().split() for v in values], "the words stay"


@SETTINGS
@given(TEXTS)
def test_trailing_dot(spark, values):
    got = _apply(spark, X.strip_trailing_dot, values)
    assert all(v in (g, g + ".") for v, g in zip(values, got))
    assert all(len(g) == len(v) - v.endswith(".") for v, g in zip(values, got))


@pytest.mark.parametrize(
    "name,company",
    [
        ("ACME LTD 2023.pdf", "ACME LTD"), ("A.B.C PTE 2021.pdf", "A B C PTE"), ("X 2020.PDF", "X"), ("2023.pdf", ""), ("NO EXT 2023 pdf", "NO EXT"),
        ("  SPACED  CO 1999.pdf", "SPACED  CO"), (".pdf", ""),
    ],
)
def test_company_from_filename(spark, name, company):
    assert _apply(spark, X.company_from_filename, [name]) == [company]


@SETTINGS
@given(st.lists(st.integers(min_value=0, max_value=10**7), min_size=1, max_size=40))
def test_padded_code(spark, values):
    got = _apply(spark, C.pad_code, [str(v) for v in values])
    assert [int(g) for g in got] == values and all(len(g) == max(5, len(str(v))) for v, g in zip(values, got))


@SETTINGS
@given(TEXTS)
def test_tokens(spark, values):
    for tokens, v in zip(_apply(spark, X.tokenize_words, values), values):
        assert all(t and set(t) <= set(string.ascii_lowercase) for t in tokens)
        assert "".join(tokens) == "".join(c for c in v.lower() if c in string.ascii_lowercase)


WORDS = st.sampled_from(["the", "Company", "retail", "shop's", "a1b2", "x-ray", "Trading!", "fish", "(it)", "2023",
                         "holding", "café", "e.g.", "##", "Principal", "ok?"])
PHRASES = st.lists(st.lists(WORDS, max_size=12).map(" ".join), min_size=1, max_size=30)


@SETTINGS
@given(PHRASES)
def test_domain_words_and_marks_are_gone(spark, values):
    got = _apply(spark, X.preprocess_domain, values)
    dropped = set(X.STOP_WORDS) | set(X.DOMAIN_WORDS)
    for g in got:
        assert not dropped & set(g.split()) and not set(g) & set(string.punctuation + string.digits) and "  " not in g
    assert _apply(spark, X.preprocess_domain, got) == got


@pytest.mark.parametrize(
    "text,left",
    [("The Company's fish-shop, 2023!", "companys fishshop"), ("Principal activities: retail of toys", "retail toys"), ("x-ray a1b2 ##", "xray ab"), ("", "")],
)
def test_domain_text(spark, text, left):
    assert _apply(spark, X.preprocess_domain, [text]) == [left]

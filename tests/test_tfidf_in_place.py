"""TF-IDF rows stay in their document's task, with the same weights whatever is broadcast."""

from __future__ import annotations

import pytest

from codelens.operators import tfidf as TF


def corpus(spark):
    texts = [(i, f"shared words {'often ' * (i % 3)} pair{chr(97 + i // 2)} only{chr(97 + i)}{chr(97 + i)}") for i in range(20)]
    return spark.createDataFrame([*texts, (3, "shared again"), (None, "words words"), (90, None), (91, "")], "id long, text string")


def test_no_list_of_terms_is_gathered(spark):
    # the old plan collected (term, tf, weight) of every document behind its last exchange
    plan = TF.tfidf(corpus(spark), "id", "text", in_place=True)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan


@pytest.mark.parametrize(("terms", "rows"), [(10, 10**6), (10, 0), (3, 0), (10**6, 0), (0, 0)])
def test_in_place_weights_equal_gathered_ones(spark, monkeypatch, terms, rows):
    flat = lambda df: sorted((str(x["id"]), x["term"], x["tf"], round(x["weight"], 5)) for x in df.collect())
    bag = TF.weighted_bags(TF.bags(corpus(spark), "id", TF.plain_tokens("text")), "id", broadcast=True)
    want = flat(bag.selectExpr("id", "inline(terms)"))
    monkeypatch.setattr(TF, "BROADCAST_MAX_TERMS", terms)
    monkeypatch.setattr(TF, "BROADCAST_MAX_ROWS", rows)
    assert flat(TF.tfidf(corpus(spark), "id", "text", in_place=True)) == want

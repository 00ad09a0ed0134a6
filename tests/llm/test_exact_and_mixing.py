from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from codelens.llm import content_sort, mixing
from helpers import awkward, no_rows, words


def plain_groups(rows, best):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        known = [x for x in ids if x is not None]
        out.append((i, best(known) if known else None, len(ids), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("keep,best", [("largest", max), ("smallest", min)])
def test_groups_equal_plain_version(spark, keep, best):
    docs = awkward(spark)
    found = content_sort.exact_groups(docs, keep=keep, salts=3)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found.collect()), key=repr)
    expected = plain_groups(rows, best)
    assert [g[:1] + g[2:] for g in got] == [e[:1] + e[2:] for e in expected]
    assert {g[3]: g[1] for g in got if g[2] > 1 and g[1] is not None} == {e[3]: e[1] for e in expected if e[2] > 1 and e[1] is not None}
    kept = found.where("kept").groupBy("text_sha256").count()
    assert kept.where("count <> 1").count() == 0 and kept.count() == len({t or "" for _, t in rows})


def test_rows_that_stay_keep_all_columns(spark):
    docs = awkward(spark)
    left = content_sort.deduplicated(docs, salts=3)
    assert left.columns == docs.columns
    texts = [r.text or "" for r in left.collect()]
    assert len(texts) == len(set(texts)) == docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert {r.doc_id for r in left.collect()} >= {2, 3, 8, 9, 10, 11, 12}


def test_normalised_and_empty(spark):
    docs = awkward(spark)
    merged = content_sort.exact_groups(docs, keep="smallest", normalise=lambda t: F.lower(F.trim(t)))
    assert {r.doc_id: r.keep_id for r in merged.collect()}[11] == 10
    assert content_sort.exact_groups(no_rows(docs)).count() == 0
    assert content_sort.deduplicated(no_rows(docs)).count() == 0
    with pytest.raises(ValueError):
        content_sort.exact_groups(docs, keep="first")


def test_hot_text_is_dealt_to_many_runs(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    found = content_sort.exact_groups(docs)
    hot = found.where("group_size = 1000")
    assert hot.count() == 1000 and hot.where("kept").collect()[0].doc_id == 2997 and found.where("kept").count() == 2001


def plain_share(children, budget):
    """Fill the smallest room per weight first."""
    out, left, weights = {}, budget, sum(w for _, w in children.values())
    for k, (room, w) in sorted(children.items(), key=lambda x: (x[1][0] / x[1][1], x[0])):
        out[k] = min(room, left * w / weights)
        left, weights = left - out[k], weights - w
    return out


def test_budgets_share_shortages_with_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 1000), ("b", "x", 1000), ("b", "z", 1000)], "top string, leaf string, tokens long")
    got = {(r.top, r.leaf): r.budget for r in mixing.tree_budgets(leaves, ["top", "leaf"], {"top": {"a": 1.0, "b": 1.0}, "leaf": {}}, 1000.0, 2).collect()}
    assert got == {("a", "x"): 20.0, ("a", "y"): 480.0, ("b", "x"): 250.0, ("b", "z"): 250.0}
    tight = {(r.top, r.leaf): r.budget for r in mixing.tree_budgets(leaves, ["top", "leaf"], {"top": {"a": 9.0, "b": 1.0}, "leaf": {"x": 0.0}}, 3000.0, 2).collect()}
    assert tight[("a", "x")] == 0 and tight[("a", "y")] == 2000 and tight[("b", "z")] == 1000 and tight[("b", "x")] == 0


def test_budgets_equal_plain_water_filling(spark):
    import random

    rng = random.Random(5)
    rows = [(f"d{i}", f"s{j}", rng.randint(1, 500)) for i in range(5) for j in range(6)]
    weights = {"d": {f"d{i}": float(i + 1) for i in range(5)}, "s": {f"s{j}": float(j % 3 + 1) for j in range(6)}}
    leaves = spark.createDataFrame(rows, "d string, s string, tokens long")
    for total in (100.0, 5000.0, 40000.0):
        got = {(r.d, r.s): r.budget for r in mixing.tree_budgets(leaves, ["d", "s"], weights, total, 3).collect()}
        rooms = defaultdict(dict)
        for d, s, n in rows:
            rooms[d][s] = (3.0 * n, weights["s"][s])
        top = plain_share({d: (sum(r for r, _ in x.values()), weights["d"][d]) for d, x in rooms.items()}, total)
        expected = {(d, s): b for d, x in rooms.items() for s, b in plain_share(x, top[d]).items()}
        assert got == pytest.approx(expected)


def test_mix_takes_whole_epochs_then_a_seeded_prefix(spark):
    docs = spark.createDataFrame([(i, words(10, i), "a" if i < 30 else "b") for i in range(60)], "doc_id long, text string, source string")
    taken = mixing.mix(docs, ["source"], {"source": {"a": 3.0, "b": 1.0}}, fraction=1.0, max_epochs=4, seed=1, runs=8).collect()
    a, b = ([r for r in taken if r.source == s] for s in "ab")
    assert sum(r.tokens for r in a) == 450 and sum(r.tokens for r in b) == 150
    assert Counter(r.epoch for r in a) == {0: 30, 1: 15}
    again = mixing.mix(docs, ["source"], {"source": {"a": 3.0, "b": 1.0}}, fraction=1.0, max_epochs=4, seed=1, runs=512).collect()
    assert Counter(taken) == Counter(again), "the number of runs does not change the result"
    other = mixing.mix(docs, ["source"], {"source": {"a": 3.0, "b": 1.0}}, fraction=1.0, max_epochs=4, seed=2).collect()
    assert Counter(other) != Counter(taken)


def test_mix_awkward_rows(spark):
    docs = awkward(spark)
    light = mixing.mix(docs, ["lang", "source"], {"lang": {"en": 2.0}, "source": {}}, fraction=1.0)
    whole = mixing.mix(docs, ["lang", "source"], {"lang": {"en": 2.0}, "source": {}}, fraction=1.0, whole_rows=True)
    assert whole.columns == docs.columns
    assert Counter(r.doc_id for r in light.collect()) == Counter(r.doc_id for r in whole.collect())
    assert mixing.mix(no_rows(docs), ["lang"], {}).count() == 0


def test_word_count(spark):
    df = spark.createDataFrame([("",), (" a  b\t",), ("x",), ("a b c",)], "t string")
    assert [r[0] for r in df.select(mixing.word_count(F.col("t"))).collect()] == [0, 2, 1, 2]


def test_groups_come_from_neighbours_in_the_sort(spark, monkeypatch):
    """With every row a run of its own, no group is found but the hot ones: nothing else puts equal texts together."""
    docs = spark.range(4000).select("id", F.when(F.col("id") % 4 == 0, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") % 900).cast("string"))).alias("text"))
    docs = docs.withColumnRenamed("id", "doc_id")
    sizes = {r.text: r.n for r in docs.groupBy("text").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = docs.join(content_sort.exact_groups(docs), "doc_id").collect()
    assert all(r.group_size == sizes[r.text] for r in found) and sum(r.kept for r in found) == len(sizes)
    largest = {t: max(r.doc_id for r in found if r.text == t) for t in list(sizes)[:20]}
    assert all(r.keep_id == largest[r.text] for r in found if r.text in largest)
    monkeypatch.setattr(content_sort, "RUN", (*content_sort.RUN, "__id"))
    apart = docs.join(content_sort.exact_groups(docs), "doc_id").where("text <> 'hot'")
    assert apart.where("group_size > 1").count() == 0 and apart.where("not kept").count() == 0

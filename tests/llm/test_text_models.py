from __future__ import annotations

import pickle
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelens.llm import html_blocks, lm_scoring, toxicity
from codelens.llm.queries import LM
from helpers import awkward, no_rows, words


# --- language-model scoring -------------------------------------------------

SMALL = lm_scoring.Settings(classes=4, per_class=16, others=8, hidden=12, size=8, masked=0.5, rounds=2, batch=64)


def grammar(n, seed):
    """Every second word is decided by the one before it."""
    rng = random.Random(seed)
    follows = {f"a{i}": f"b{i}" for i in range(20)}
    return [" ".join(x for _ in range(40) for x in (lambda w: (w, follows[w]))(rng.choice(list(follows)))) for _ in range(n)]


def test_class_softmax_sums_to_one():
    net = lm_scoring.Network.fresh(SMALL, np.random.default_rng(0).permutation(SMALL.words))
    context = np.tile(np.array([[1, 2, 3, 4]]), (SMALL.words, 1))
    assert np.exp(net.log_probabilities(context, np.arange(SMALL.words))).sum() == pytest.approx(1, abs=1e-4)


def test_contexts_stay_within_their_text():
    s = lm_scoring.Settings(reach=2)
    net = lm_scoring.Network(s, {}, np.zeros(0))
    ids, begin = np.array([10, 11, 12, 20, 21]), np.array([0, 3])
    edge = s.words
    assert net.contexts(ids, begin, np.arange(5)).tolist() == [
        [edge, edge, 11, 12], [edge, 10, 12, edge], [10, 11, edge, edge], [edge, edge, 21, edge], [edge, 20, edge, edge]
    ]


def test_trained_network_tells_order_from_disorder(spark):
    texts = grammar(400, 1)
    shuffled = []
    for i, t in enumerate(grammar(50, 2)):
        w = t.split()
        random.Random(i).shuffle(w)
        shuffled.append(" ".join(w))
    rows = [(i, t) for i, t in enumerate(texts + shuffled)]
    got = lm_scoring.pseudo_likelihood(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), SMALL).collect()
    score = {r.doc_id: r.mean_log_likelihood for r in got}
    assert all(r.n_tokens == 80 for r in got)
    assert all(r.mean_log_likelihood == pytest.approx(r.log_likelihood / 80) for r in got)
    kept, mixed = [score[i] for i in range(400)], [score[i] for i in range(400, 450)]
    assert min(kept) > max(mixed), "held-out disorder scores below order"
    assert np.mean(kept) > -np.log(40), "better than guessing among the words"


def test_every_word_has_a_probability_of_its_own(spark):
    """Words that share an id: one 30 times as frequent scores log 30 higher, and all words' probabilities sum to 1."""
    import zlib

    few = lm_scoring.Settings(classes=2, per_class=4, others=2, hidden=4, size=2, masked=0.5, rounds=1, batch=64)
    same = [w for w in (f"w{i}" for i in range(100)) if zlib.crc32(w.encode()) % 2 == 0][:3]
    often, once = same[0], same[1:]
    listed = [f"common{i}" for i in range(6)]
    texts = [" ".join(listed)] * 60 + [often] * 30 + once
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = lm_scoring.vocabulary(docs, few)
    table = lm_scoring.encoded(docs, words, few)
    net = lm_scoring.train(table, words.order, few)
    got = {r.doc_id: r.log_likelihood for r in lm_scoring.score(table, net, words).collect()}
    assert got[60] - got[90] == pytest.approx(np.log(30), abs=1e-4) and got[90] == pytest.approx(got[91], abs=1e-4)
    edge = np.full((8, 2 * few.reach), few.words)
    ids = np.exp(net.log_probabilities(edge, np.arange(8)))
    assert np.exp([got[60], got[90], got[91]]).sum() == pytest.approx(ids[6], rel=1e-3), "the words of an id share its probability"


def test_a_long_text_is_scored_in_pieces_as_in_one(spark, monkeypatch):
    texts = [" ".join(grammar(5, 3)), "", "a1 b1", " ".join(grammar(3, 4))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    words = lm_scoring.vocabulary(docs, SMALL)
    table = lm_scoring.encoded(docs, words, SMALL)
    net = lm_scoring.Network.fresh(SMALL, words.order)
    ids = [np.frombuffer(r.ids, "<u2").astype(np.int64) for r in table.orderBy("kept.doc_id").collect()]
    own = np.concatenate((np.zeros(SMALL.words - SMALL.others), -np.log(np.maximum(words.totals, 1))))
    expected = [(net.log_probabilities(net.contexts(x, np.array([0]), np.arange(len(x))), x) + own[x]).sum() if len(x) else 0.0 for x in ids]
    monkeypatch.setattr(lm_scoring, "EXAMPLES", 7)
    got = lm_scoring.text_sums(net, own, np.concatenate(ids), np.array([len(x) for x in ids]))
    assert got.tolist() == pytest.approx(expected, abs=1e-3)


def test_all_places_are_learned_from_once():
    sizes = np.array([500, 0, 1, 3000])
    keys, ids = np.array([5, -7, 9, -(2**62)]), np.arange(3501)
    net = lm_scoring.Network(LM, {}, np.zeros(0))
    rounds = [lm_scoring.examples(net, keys, ids, sizes, r) for r in range(LM.parts)]
    assert sorted(np.concatenate(rounds)[:, -1].tolist()) == ids.tolist()
    assert all(0.05 < len(x) / 3501 < 0.2 for x in rounds), "a round masks a part only"


def test_query_settings_tell_order_from_disorder(spark):
    texts, shuffled = grammar(2000, 3), []
    for i, t in enumerate(grammar(50, 4)):
        w = t.split()
        random.Random(i).shuffle(w)
        shuffled.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts + shuffled)), "doc_id long, text string").repartition(3)
    score = {r.doc_id: r.mean_log_likelihood for r in lm_scoring.pseudo_likelihood(docs, LM).collect()}
    kept, mixed = [score[i] for i in range(2000)], [score[i] for i in range(2000, 2050)]
    assert min(kept) > max(mixed) and np.mean(kept) > -np.log(40)


def test_scoring_awkward_rows(spark):
    docs = awkward(spark)
    got = lm_scoring.pseudo_likelihood(docs, SMALL).collect()
    assert len(got) == docs.count()
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[4].n_tokens == by_id[5].n_tokens == by_id[6].n_tokens == 0 and by_id[4].mean_log_likelihood is None and by_id[4].log_likelihood == 0
    assert by_id[7].n_tokens == 30_000 and by_id[7].log_likelihood == pytest.approx(by_id[8].log_likelihood)
    assert by_id[1].key == 3 and lm_scoring.pseudo_likelihood(no_rows(docs), SMALL).count() == 0


# --- toxicity ---------------------------------------------------------------

FEW = toxicity.Settings(epochs=8, least_documents=3, max_toxic=400, max_clean=800)


def labelled(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w = words(rng.randint(5, 60), seed * 10_000 + i).split()
        toxic = i % 4 == 0
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(["Zounds!", "blackguard,", "knave"]))
        rows.append((i, " ".join(w), rng.choice(["en", "de", None]), int(toxic)))
    return rows


def test_classifier_learns_and_leaves_held_out_rows_alone(spark):
    rows = labelled(900, 1)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    held = toxicity.held_out(F.col("doc_id"))
    wrong_on_held = df.select("doc_id", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")).alias("toxic"))
    model = toxicity.fit(df.drop("toxic"), wrong_on_held, FEW, learn=~held)
    got = toxicity.score(df, model).withColumn("held", held).collect()
    test = [r for r in got if r.held]
    assert 150 < len(test) < 300
    toxic, clean = [r.score for r in test if r.toxic], [r.score for r in test if not r.toxic]
    assert np.mean([t > c for t in toxic for c in clean]) > 0.97 and np.mean([t >= 0.3 for t in toxic]) > 0.95
    assert set(model.thresholds) >= {"", "en", "de"} and all(0 < t < 1 for t in model.thresholds.values())


def test_score_ignores_everything_but_the_text(spark):
    rows = labelled(200, 2)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model = toxicity.fit(df.drop("toxic"), df.select("doc_id", "toxic"), FEW)
    a = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    moved = df.select((F.col("doc_id") + 5000).alias("doc_id"), "text", F.lit("xx").alias("lang"), (1 - F.col("toxic")).alias("toxic"))
    b = {r.doc_id - 5000: r.score for r in toxicity.score(moved, model).collect()}
    assert a == pytest.approx(b)


def test_toxicity_awkward_rows(spark):
    docs = awkward(spark).drop("score")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (7, 1), (7, 0), (99, 1), (10, 5)], "doc_id long, toxic int")
    scored = toxicity.score(docs, toxicity.fit(docs, labels, FEW)).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 for r in scored)
    none = toxicity.fit(docs, no_rows(labels), FEW)
    assert all(r.score < 0.01 for r in toxicity.score(docs, none).collect())
    assert toxicity.score(no_rows(docs), none).count() == 0


def test_every_labelled_row_is_learned_from(spark):
    """Twelve marks, each too rare in one shard's rows to have a vector, are all learned from the shards together."""
    marks = [f"mark{chr(97 + i)}" for i in range(12)]
    rng, rows = random.Random(5), []
    for i in range(1600):
        w = words(rng.randint(5, 40), 70_000 + i).split()
        if i % 4 == 0:
            w.insert(rng.randrange(len(w)), marks[i // 4 % 12])
        rows.append((i, " ".join(w), "en" if i % 3 else "de", int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    few = toxicity.Settings(epochs=8, rounds=6, max_toxic=30, max_clean=90, least_documents=5)
    held = toxicity.held_out(F.col("doc_id"))
    model = toxicity.fit(df.drop("toxic"), df.select("doc_id", "toxic"), few, learn=~held)
    assert {toxicity.word_hash(m) for m in marks} <= set(toxicity.Network.loaded(model.blob).hashes.tolist())
    got = toxicity.score(df.where(held), model).collect()
    toxic, clean = [r.score for r in got if r.toxic], [r.score for r in got if not r.toxic]
    assert len(toxic) > 60 and np.mean([t > c for t in toxic for c in clean]) > 0.95
    assert set(model.thresholds) == {"", "en", "de"} and all(0 < t < 1 for t in model.thresholds.values())


def test_the_driver_ships_one_network_at_a_time(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * k) % 400}" for k in range(1, 40)) + (" vile" if i % 3 == 0 else " kind"), int(i % 3 == 0)) for i in range(1, 601)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    few = toxicity.Settings(epochs=1, least_steps=10, rounds=1, max_toxic=60, max_clean=120, least_documents=2)
    sizes, ship = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: sizes.append(len(pickle.dumps(value))) or ship(value))
    model = toxicity.fit(df.drop("toxic"), df.select("doc_id", "toxic"), few)
    words = len(toxicity.Network.loaded(model.blob).hashes)
    assert words > 300
    # a word's vector and its sums are 24 floats, its hash 8 bytes
    assert max(sizes) < 1.5 * (words * (24 * 4 + 8) + 20_000)


def test_threshold_is_where_f1_is_largest():
    labels = np.array([1] * 30 + [0] * 70)
    scores = np.concatenate([np.linspace(0.4, 0.9, 30), np.linspace(0.0, 0.3, 70)])
    assert 0.3 < toxicity.best_threshold(scores, labels) < 0.4
    assert toxicity.best_threshold(scores[:10], labels[:10]) == 0.5


# --- web pages --------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav>
<!-- a comment --><div class="ad">Buy &amp; save</div><article><h1>Title &eacute;</h1><p>First <b>bold</b>
 and   &#8220;more&#8221;.<br>Next line<p>Second, unclosed<script>var x="</p>";</script></article><footer>&copy; us</footer></body></html>"""


def test_blocks_of_a_page():
    got = [(b.text, b.path[2:]) for b in html_blocks.blocks_of(PAGE)]
    assert got == [
        ("Home", ("nav", "ul", "li")), ("Buy & save", ("div", ".ad")), ("Title é", ("article", "h1")),
        ("First bold and “more”. Next line", ("article", "p")), ("Second, unclosed", ("article", "p")), ("© us", ("footer",)),
    ]
    assert html_blocks.blocks_of("") == [] and html_blocks.blocks_of("plain < 3 text")[0].text == "plain < 3 text"
    assert [b.text for b in html_blocks.blocks_of('<p title="a > b">x</p><p>y<script>never closed')] == ["x", "y"]


def test_lstm_gradients():
    s = html_blocks.Settings(hidden=3, path_size=4, word_size=3, path_rows=16, word_rows=16)
    net = html_blocks.Labeller.fresh(s)
    for k in net.v:
        net.v[k] = net.v[k].astype(np.float64)
    pages = [html_blocks.features(html_blocks.blocks_of(PAGE), s), html_blocks.features(html_blocks.blocks_of("<p>a</p><div>b</div>"), s)]
    labels = [np.array([0, 0, 1, 1, 1, 0.0]), np.array([1, -1.0])]

    def loss():
        x, mask, _ = net.inputs(pages)
        p = net.probabilities(x.astype(np.float64), mask)
        terms = [-(y * np.log(p[t, i]) + (1 - y) * np.log(1 - p[t, i])) for i, ys in enumerate(labels) for t, y in enumerate(ys) if y >= 0]
        return np.mean(terms)

    g = net.gradients(pages, labels)
    rng = np.random.default_rng(0)
    for key, v in net.v.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in v.shape)
            old, h = v[at], 1e-3
            v[at] = old + h
            up = loss()
            v[at] = old - h
            down = loss()
            v[at] = old
            assert g[key][at] == pytest.approx((up - down) / (2 * h), abs=2e-3), key


def made_pages(n, seed):
    """Pages in layouts drawn from the fixed lists, with the text that should come out."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        main = [html_blocks.Block(words(int(rng.integers(5, 40)), seed * 1000 + i * 20 + j), (), 0) for j in range(int(rng.integers(1, 8)))]
        other = [html_blocks.Block(words(6, seed * 5000 + i), (), 0)]
        blocks, y = html_blocks.shown_anew(main + other, np.array([1.0] * len(main) + [0.0]), rng)
        html = "".join(_tagged(b) for b in blocks)
        out.append((i, html, "\n".join(b.text for b, z in zip(blocks, y) if z == 1)))
    return out


def _tagged(b):
    opened, closed = "", ""
    path = list(b.path)
    while path:
        tag = path.pop(0)
        names = []
        while path and path[0][0] == ".":
            names.append(path.pop(0)[1:])
        opened += f"<{tag} class='{' '.join(names)}'>" if names else f"<{tag}>"
        closed = f"</{tag}>" + closed
    return opened + b.text + closed


def test_extraction_of_unseen_layouts(spark):
    train = [(i, f"<html><body><nav><a href='/'>{words(3, i)}</a></nav><article>{''.join(f'<p>{words(20, i * 50 + j)}</p>' for j in range(5))}</article><footer>{words(5, i + 9)}</footer></body></html>") for i in range(120)]
    model = html_blocks.fit(spark.createDataFrame(train, "page_id long, html string"))
    rows = made_pages(80, 7)
    pages = spark.createDataFrame([(i, h) for i, h, _ in rows], "page_id long, html string")
    got = {r.page_id: r.text for r in html_blocks.extract(pages, model).collect()}
    assert np.mean([got[i] == t for i, _, t in rows]) > 0.9


def test_extraction_awkward_rows(spark):
    pages = spark.createDataFrame(
        [(1, None, "old"), (2, "", "old"), (3, PAGE, "old"), (3, PAGE, "old"), (None, PAGE, "old"), (4, "<nav>x</nav>", "old"), (5, "<article>" + "<p>long text here</p>" * 30_000 + "</article>", "old")],
        "page_id long, html string, text string",
    )
    few = html_blocks.Settings()
    rows = [(i, f"<html><body><nav><a href='/'>{words(3, i)}</a></nav><article>{''.join(f'<p>{words(8, i * 50 + j)}</p>' for j in range(5))}</article><footer>{words(5, i + 9)}</footer></body></html>") for i in range(120)]
    model = html_blocks.fit(spark.createDataFrame(rows, "page_id long, html string"), few)
    got = html_blocks.extract(pages, model, few).collect()
    assert len(got) == 7
    by_id = {r.page_id: r.text for r in got}
    assert by_id[1] == by_id[2] == "" and by_id[None] == by_id[3] and by_id[5].count("\n") == 29_999
    empty = html_blocks.fit(no_rows(pages), few)
    assert html_blocks.extract(no_rows(pages), empty, few).count() == 0


def test_given_labels_held_out_and_thresholds_by_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = toxicity.held_out(F.col("doc_id"))
    model = toxicity.fit(docs, labels, learn=~held)
    assert set(model.thresholds) == {"", *(r[0] for r in docs.select("lang").where("lang is not null").distinct().collect())}
    test = docs.join(labels.where(held), "doc_id")
    rows = toxicity.score(test.select("text", "toxic"), model).select("score", "toxic").collect()
    toxic, clean = (np.array([r.score for r in rows if r.toxic == k]) for k in (1, 0))
    assert len(toxic) > 50 and np.mean(toxic[:, None] > clean[None, :]) > 0.93

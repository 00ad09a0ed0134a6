from __future__ import annotations

import random
import re

import numpy as np
import pytest

from codelens.llm import embed_dedup, minhash
from codelens.llm.common import connected_components
from helpers import awkward, no_rows, words


def plain_components(nodes, linked):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def plain_near(rows, k, percent=80):
    sets = {}
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, plain_components(ids, links)


def variants(n, seed):
    """A large group of near copies around the threshold, smaller ones, and texts that share one passage."""
    rng = random.Random(seed)
    base, passage = words(80, 100).split(), words(30, 101)
    texts = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = words(1, rng.randrange(10**6))
        texts.append(" ".join(w))
    texts += [f"{words(15, 1000 + i)} {passage} {words(15, 2000 + i)}" for i in range(n // 2)]
    for g in range(n // 4):
        one = words(50, 3000 + g).split()
        texts += [" ".join(one), " ".join(one[: 50 - rng.randint(1, 12)])]
    return list(enumerate(texts))


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_equal_all_pairs(spark, k):
    rows = variants(120, k)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = minhash.near_duplicates(df, minhash.Settings(words=k, block=16, cell_rows=200)).collect()
    sizes, label = plain_near(rows, k)
    assert {r.doc_id: r.n_shingles for r in got} == sizes
    assert {r.doc_id: r.component_id for r in got} == label
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_awkward_rows(spark):
    docs = awkward(spark)
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert [by_id[i].component_id for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11)] == [1, 1, 1, 4, 5, 6, 7, 7, 9, 10, 10]
    assert [by_id[i].n_shingles for i in (4, 5, 6, 10)] == [0, 0, 0, 1]
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert minhash.near_duplicates(no_rows(docs)).count() == 0


def test_index_guarantees_the_distance():
    s = minhash.Settings()
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 16, (300, s.length)).astype(np.uint16)
    b = a.copy()
    for row in b:  # the most differences that are guaranteed
        at = rng.choice(s.length, 2 * s.chunks - 1, replace=False)
        row[at] ^= 1
    ka, kb = minhash.index_keys(a, s), minhash.index_keys(b, s)
    assert all(np.intersect1d(x, y).size for x, y in zip(ka, kb))
    assert not np.intersect1d(ka[0], ka[1]).size


def test_signature_distance_follows_similarity():
    s = minhash.Settings(words=1)
    shared = [f"w{i}" for i in range(800)]
    a = " ".join(shared + [f"a{i}" for i in range(100)])
    b = " ".join(shared + [f"b{i}" for i in range(100)])
    sets = minhash.shingle_sets([a.encode(), b.encode()], 1)
    assert [len(x) for x in sets] == [900, 900] and len(np.intersect1d(*sets)) == 800
    sig = minhash.signatures(sets, s)
    apart = sig[0] != sig[1]
    assert 3 <= apart[: s.length].sum() <= s.accept and 25 <= apart.sum() <= s.accept_all


def test_components(spark):
    rng = random.Random(3)
    path = list(range(400))
    rng.shuffle(path)
    edges = list(zip(path, path[1:])) + [(1000 + i, 1000) for i in range(1, 300)] + [(2000, 2001), (2001, 2000), (5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == plain_components({x for e in edges for x in e}, edges)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(n, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(4):
        centre = rng.normal(size=24)
        spread = (0.02, 0.06, 0.12, 0.2)[c]
        rows += [(centre + rng.normal(scale=spread, size=24)).astype(np.float32).tolist() for _ in range(n)]
    rows += [rng.normal(size=24).astype(np.float32).tolist() for _ in range(n)]
    return [(i, v, i % 3 if i % 11 else None) for i, v in enumerate(rows + rows[:5])]


def test_near_vectors_equal_all_pairs(spark):
    rows = vectors(60, 1)
    rows += [(900, None, 1), (901, [0.0] * 24, 1), (902, [float("nan")] * 24, 1), (903, [None] + [1.0] * 23, 1), (904, [1.0, 2.0], 1), (905, [2.0, 4.0], 1), (906, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = {r.vec_id: r for r in embed_dedup.near_vectors(df, embed_dedup.Settings(block=16, cell_rows=100, bucket=4)).collect()}
    fit = {i: np.array(v, np.float64) for i, v, la in rows if la is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: la for i, _, la in rows}
    links = []
    ids = sorted(fit)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if label[a] == label[b] and len(fit[a]) == len(fit[b]) and fit[a] @ fit[b] / np.linalg.norm(fit[a]) / np.linalg.norm(fit[b]) >= 0.98:
                links.append((a, b))
    components = plain_components([i for i, _, _ in rows], links)
    counts = {i: sum(i in p for p in links) for i, _, _ in rows}
    assert {i: r.component_id for i, r in got.items()} == components
    assert {i: r.n_links for i, r in got.items()} == counts
    assert all(r.kept == (i == components[i]) for i, r in got.items())


def test_near_vectors_awkward(spark):
    df = spark.createDataFrame(
        [(1, [1.0, 0.0], 1, 5), (1, [1.0, 0.0], 1, 5), (2, [2.0, 0.0], 1, 5), (None, [1.0, 0.0], 1, 5), (3, [1e-200, 0.0], 1, 5), (4, [1e200, 1e199], 1, 5)],
        "vec_id long, embedding array<double>, label int, id long",
    )
    got = embed_dedup.near_vectors(df).collect()
    assert len(got) == 6
    by_id = {r.vec_id: r for r in got}
    assert by_id[1].n_links == by_id[2].n_links == by_id[3].n_links == 4 and by_id[4].component_id == 1
    assert by_id[None].component_id is None and by_id[None].kept
    assert embed_dedup.near_vectors(no_rows(df)).count() == 0


def test_tables_follow_from_the_chance_of_a_miss():
    bits, tables = embed_dedup.planes_needed(10**8, embed_dedup.Settings())
    same = 1 - np.arccos(0.98) / np.pi
    assert bits == 23 and (1 - same**bits) ** tables <= 1e-8 < (1 - same**bits) ** (tables - 1)
    assert embed_dedup.planes_needed(0, embed_dedup.Settings())[0] == 4

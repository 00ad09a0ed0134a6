"""What the neighbour search sends: a query once a tile of blocks, a row with several keys once; and the same rows as before."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from codelens.operators import neighbours as N
from codelens.operators import split as S
from codelens.plans import q_neighbours as QN


def table(spark, vectors, name: str):
    return spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], f"{name} long, embedding array<double>")


def test_a_query_is_sent_once_a_tile(spark, monkeypatch):
    q, r = np.random.default_rng(1).normal(size=(60, 16)), np.random.default_rng(2).normal(size=(2000, 16))
    sent, meet = [], N._meet

    def counted(query, *more):
        sent.append(query.count())
        return meet(query, *more)

    monkeypatch.setattr(N, "_meet", counted)
    found = N.nearest_neighbours(table(spark, q, "qid"), table(spark, r, "rid"), 3, "qid", "rid", block_rows=64)
    # 2,000 references of no structure in blocks of 64 or less are 32 blocks at least, and 10 or so tiles
    assert sum(sent) < 18 * len(q)
    unit = [m / np.linalg.norm(m, axis=1, keepdims=True) for m in (q, r)]
    best = np.argsort(-np.round(unit[0] @ unit[1].T, N.SIM_DECIMALS), axis=1, kind="stable")[:, :3]
    assert sorted((x["qid"], x["rid"], x["nb_rank"]) for x in found.collect()) == sorted((i, int(b), n + 1) for i, row in enumerate(best) for n, b in enumerate(row))


@pytest.mark.parametrize("block_rows", [32, 4096])
def test_array_keys_give_the_rows_of_exploded_ones(spark, block_rows):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(400, 8))
    m[::4] = m[0]  # a quarter are copies: ties go to the smaller id
    rows = [(i, v, [t for t in range(1, 6) if (i * 7 + t * t) % 5 < 2], [t for t in range(1, 7) if (i + t) % 6 == 0], None if i % 9 == 0 else f"n{i}")
            for i, v in enumerate(m.tolist())]
    rows += [(7, rows[7][1], rows[7][2], rows[7][3], "n7"), (900, [0.0] * 8, [1], [1], "zero"), (901, None, [1], [1], "none"), (902, [1.0] * 8, [], None, "no key"), (903, [2.0] * 8, [None, 3], [None, 3], "null key")]
    both = spark.createDataFrame(rows, "id long, embedding array<double>, held array<int>, asked array<int>, name string")
    query, ref = both.select("id", "embedding", F.col("asked").alias("trial")), both.select(F.col("id").alias("rid"), "embedding", "name", F.col("held").alias("trial"))

    def search(a, b):
        return sorted(map(tuple, N.nearest_neighbours(a, b, 4, "id", "rid", r_payload=["name"], by=["trial"], block_rows=block_rows)
                          .select("trial", "id", "rid", "sim", "nb_rank", F.coalesce("name", F.lit(""))).collect()))

    def single(df):
        return df.withColumn("trial", F.explode("trial")).where(F.col("trial").isNotNull())

    packed = search(query, ref)
    assert packed == search(single(query), single(ref)) and {t for t, *_ in packed} == {1, 2, 3, 4, 5}
    many = N.MAX_KEYS
    N.MAX_KEYS = 3
    try:
        assert search(query, ref) == packed
    finally:
        N.MAX_KEYS = many


@pytest.mark.parametrize("copies", [0, 3000])
def test_references_in_any_steps_give_the_best(copies):
    rng = np.random.default_rng(5)
    q, r, k, n_keys = rng.normal(size=(40, 12)), rng.normal(size=(5000, 12)), 6, 3
    if copies:
        r[rng.choice(5000, copies, False)] = q[0]
    q_keys, r_keys = rng.integers(0, 1 << n_keys, 40), rng.integers(0, 1 << n_keys, 5000)
    ids = rng.permutation(5000)
    floors = np.where((q_keys[:, None] >> np.arange(n_keys)) & 1, -np.inf, np.inf)
    best = N._Best(q, r, ids, k, floors, q_keys, r_keys)
    for low in (2500, 0):
        best.meet(np.arange(40), low, low + 2500)
    found = sorted(zip(*(x.tolist() for x in best.result()), strict=True))
    sims = np.round((q / np.linalg.norm(q, axis=1, keepdims=True)) @ (r / np.linalg.norm(r, axis=1, keepdims=True)).T, N.SIM_DECIMALS)
    want = []
    for i in range(40):
        for key in range(n_keys):
            if q_keys[i] >> key & 1:
                of = np.flatnonzero(r_keys >> key & 1)
                want += [(i, key, int(j), float(sims[i, j])) for j in of[np.lexsort((ids[of], -sims[i, of]))[:k]]]
    assert [x[:3] for x in found] == [x[:3] for x in sorted(want)]
    assert np.allclose([x[3] for x in found], [x[3] for x in sorted(want)], atol=1.1e-6)


def test_a_trial_is_a_key_not_a_copy_of_the_vectors(spark):
    from codelens.session import configure

    configure(spark)
    rows = QN._trial_rows(spark, SF_SMALL)
    base = QN.recommend_base(spark, SF_SMALL)
    assert rows.count() == base.count()
    apart = S.with_trials(base.select("vec_id", "company"), "company", QN.TRIALS, QN.TRAIN_PCT)
    for column, side in (("train_trials", F.col("is_train")), ("test_trials", ~F.col("is_train"))):
        packed = rows.select("vec_id", F.explode(column).alias("trial"))
        assert sorted(map(tuple, packed.collect())) == sorted(map(tuple, apart.where(side).select("vec_id", "trial").collect()))


def test_a_tile_of_floats_is_not_widened():
    q, r = np.random.default_rng(6).normal(size=(64, 64)).astype(np.float32), np.random.default_rng(7).normal(size=(32_768, 64)).astype(np.float32)
    tracemalloc.start()
    try:
        best = N._Best(q, r, np.arange(len(r)), 5, np.full((64, 1), -np.inf))
        best.meet(np.arange(64), 0, len(r))
        found = best.result()
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(found[0]) == 5 * 64 and peak < 3 * r.nbytes  # its units, and the room of a step

"""The pruned neighbour search: same rows as all pairs, and meetings skipped where vectors have structure."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelens.operators import neighbours as N


def clustered(n: int, centres: int, seed: int, spread: float = 0.05, dim: int = 16, seed_of_centres: int = 99) -> np.ndarray:
    c = np.random.default_rng(seed_of_centres).normal(size=(centres, dim))
    rng = np.random.default_rng(seed)
    return c[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dim))


def table(spark, vectors, name: str, kind: str = "double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], f"{name} long, embedding array<{kind}>")


def plain(q: np.ndarray, r: np.ndarray, k: int) -> list[tuple]:
    unit = [m / np.linalg.norm(m, axis=1, keepdims=True) for m in (q, r)]
    sims = np.round(unit[0] @ unit[1].T, N.SIM_DECIMALS)
    return sorted((i, j, n + 1) for i in range(len(q)) for n, j in enumerate(np.lexsort((np.arange(len(r)), -sims[i]))[:k].tolist()))


def rows(df) -> list[tuple]:
    return sorted((x["qid"], x["rid"], x["nb_rank"]) for x in df.select("qid", "rid", "nb_rank").collect())


@pytest.mark.parametrize("shape", ["clusters", "noise", "copies", "few"])
def test_pruned_search_equals_all_pairs(spark, shape):
    q, r = clustered(80, 12, 1), clustered(900, 12, 2)
    if shape == "noise":
        q, r = np.random.default_rng(1).normal(size=(80, 8)), np.random.default_rng(2).normal(size=(900, 8))
    if shape == "copies":  # a third of all references are one vector, and every query is near it
        r[::3] = r[0]
        q[:40] = r[0] + 0.001 * q[:40]
    k = 7 if shape != "few" else 1000  # more neighbours than there are references
    found = N.nearest_neighbours(table(spark, q, "qid"), table(spark, r, "rid"), k, "qid", "rid", block_rows=64)
    assert rows(found) == plain(q, r, k)


def test_clusters_skip_most_meetings_and_noise_none(spark):
    q, r = clustered(200, 40, 3), clustered(4000, 40, 4)
    seen = N.search_visits(table(spark, q, "qid"), table(spark, r, "rid"), 5, "qid", "rid", block_rows=128, groups=160)
    assert seen["met"] < 0.25 * seen["all"], seen
    noise = np.random.default_rng(5).normal(size=(2000, 64))
    seen = N.search_visits(table(spark, noise[:50], "qid"), table(spark, noise, "rid"), 5, "qid", "rid", block_rows=128, groups=64)
    assert seen["met"] >= 0.9 * seen["all"], seen


def test_keys_payload_and_odd_vectors(spark):
    r = clustered(400, 6, 6)
    ref = table(spark, r, "rid", "float").withColumn("trial", (F.col("rid") % 2).cast("int"))
    odd = spark.createDataFrame([(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 1)], "rid long, embedding array<float>, trial int")
    ref = ref.unionByName(odd).withColumn("name", F.when(F.col("rid") % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("n"), "rid")))
    query = ref.where("rid % 10 = 3 or rid >= 1000").select(F.col("rid").alias("qid"), "embedding", "trial", (F.col("rid") + 2**60).alias("big"))
    got = N.nearest_neighbours(query, ref, 3, "qid", "rid", q_payload=["big"], r_payload=["name"], by=["trial"], block_rows=32).collect()
    assert dict(zip(["trial", "qid", "rid", "sim", "nb_rank", "big", "name"], got[0]))["big"] >= 2**60
    one = r.astype(np.float32).astype(np.float64)
    want = []
    for t in (0, 1):
        ids = [i for i in range(400) if i % 2 == t]
        some = [i for i in ids if i % 10 == 3]
        want += [(t, some[a], ids[b], n) for a, b, n in plain(one[some], one[ids], 3)]
    assert sorted((x["trial"], x["qid"], x["rid"], x["nb_rank"]) for x in got) == sorted(want)
    assert all(x["name"] == (None if x["rid"] % 5 == 0 else f"n{x['rid']}") and x["big"] == x["qid"] + 2**60 for x in got)


def test_hot_group_is_dealt_to_several_blocks(spark):
    r = np.ones((600, 4)) + 0.0
    r[500:] = np.random.default_rng(8).normal(size=(100, 4))
    placed, groups = N._grouped(table(spark, r, "_rid").withColumnRenamed("embedding", "_vec"), 10, 64)
    assert placed.groupBy("_block").count().agg(F.max("count")).first()[0] <= 2 * 64
    assert groups.blocks.max() >= 500 // 64 and groups.rows.sum() == 600


def test_empty_sides(spark):
    some, none = table(spark, clustered(300, 3, 9), "qid"), table(spark, clustered(300, 3, 9), "rid")
    assert N.nearest_neighbours(some, none.where("1 = 0"), 3, "qid", "rid", block_rows=16).count() == 0
    assert N.nearest_neighbours(some.where("1 = 0"), none, 3, "qid", "rid", block_rows=16).count() == 0
    nothing = spark.createDataFrame([(i, [0.0, 0.0]) for i in range(40)], "rid long, embedding array<double>")
    assert N.nearest_neighbours(some.select("qid", F.slice("embedding", 1, 2).alias("embedding")), nothing, 3, "qid", "rid", block_rows=16).count() == 0


def test_a_block_holds_few_copies_of_its_similarities():
    q, r = np.random.default_rng(3).normal(size=(64, 16)), np.random.default_rng(4).normal(size=(16_384, 16))
    tracemalloc.start()
    try:
        found = N._top_k_block(q, np.arange(len(r)), r, 5)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(found[0]) == 5 * len(q) and peak < 3 * 8 * len(q) * len(r)
    assert N.SPLIT_ROWS <= 1 << 14 and N.MAX_PAIRS_PER_CHUNK <= 1 << 20

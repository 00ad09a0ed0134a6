"""Flagship: which entities' declared codes look wrong.

vectors -> md5 train/test split -> exact cosine top-k neighbours (blocked,
no pair rows) -> best score per candidate code -> rank (top 15) -> exp scores
for primary and secondary code -> per-entity min, weighted total, top-N flag.

Exchanges: the cogroup of blocks, then one hash exchange on the entity; the
(entity, code) aggregate, the ranking window and the per-entity aggregate all
reuse that partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelens.operators.judge import judge_entities, top_k_per_entity
from codelens.operators.neighbours import nearest_neighbours
from codelens.operators.split import train_test_split
from codelens.sources import fixtures

K_NEIGHBOURS = 50
TOP_N_PREDICTIONS = 15
TOP_N_FLAG = 3
TRAIN_PCT = 70


def ranked_candidates(
    spark: SparkSession, sf_dir: str, k: int = K_NEIGHBOURS, top_n: int = TOP_N_PREDICTIONS, train_pct: int = TRAIN_PCT,
    entity_filter=None,
) -> DataFrame:
    """(vec_id, code, sim, rank, primary_code, secondary_code), rank <= top_n.

    ``entity_filter``: a predicate on the held-out entities, applied before the
    neighbour search (an entity's result depends only on its own neighbours,
    and the optimizer cannot push a filter through the Python block step).
    """
    v = fixtures.vectors(spark, sf_dir)
    train, test = train_test_split(v, "vec_id", train_pct)
    if entity_filter is not None:
        test = test.where(entity_filter)
    nb = nearest_neighbours(
        test.select("vec_id", "embedding", "primary_code", "secondary_code"),
        train.select("vec_id", "embedding", F.col("primary_code").alias("code")),
        k=k,
        q_id="vec_id",
        r_id="vec_id",
        q_payload=["primary_code", "secondary_code"],
        r_payload=["code"],
    )
    cand = nb.groupBy("vec_id", "code").agg(
        F.max("sim").alias("sim"),
        F.first("primary_code").alias("primary_code"),
        F.first("secondary_code").alias("secondary_code"),
    )
    return top_k_per_entity(cand, "vec_id", "sim", "code", top_n)


def judge_report(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    """Per-entity scores and flag; keyword arguments as ``ranked_candidates``."""
    ranked = ranked_candidates(spark, sf_dir, **kw)
    return judge_entities(
        ranked, "vec_id", "code", "rank", "primary_code", "secondary_code",
        top_n_predictions=kw.get("top_n", TOP_N_PREDICTIONS), n=TOP_N_FLAG,
    )

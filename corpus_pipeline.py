"""From documents to packed training windows, stage by stage.

A stage takes (spark, docs, sf_dir); its result is written as Parquet and read
again as the next stage's documents. All but the last return the columns of
documents. Scores, sorted neighbourhoods and packing have no form in SQL that
gives the same rows, so there is no oracle: a test compares exact dedup with a
plain version and the other stages by what must hold of their rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelens.llm import content_sort, minhash, mixing, packing, toxicity
from codelens.llm.common import documents, stored
from codelens.llm.queries import tokenizer_json


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold calibrated for their language.

    Learned from the labels of sf_dir that op6 may learn from. Null and empty texts
    have a score like any other; repeated rows are judged each; a null language has
    the common threshold. An empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    model = toxicity.fit(docs, labels, learn=~toxicity.held_out(F.col("doc_id")))
    scored = toxicity.score(docs, model, out_col="__toxicity")
    return scored.where(F.col("__toxicity") < model.threshold(F.col("lang"))).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of equal texts, the one with the largest id; null counts as empty."""
    return content_sort.deduplicated(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of every component of near-duplicate texts (runs of five words, similarity 0.8).

    Empty texts link with nothing and stay; so do rows without an id.
    """
    found = minhash.near_duplicates(docs)
    gone = stored(found.where("not kept").select("doc_id").distinct(), "near-copies")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weights of their domain, language and source call for."""
    levelled = docs.withColumn("__domain", mixing.domain())
    levels = ("__domain", "lang", "source")
    weights = {"__domain": mixing.WEIGHTS["domain"], "lang": mixing.WEIGHTS["lang"], "source": mixing.WEIGHTS["source"]}
    mixed = mixing.mix(levelled, levels, weights, mixing.FRACTION, mixing.MAX_EPOCHS, mixing.SEED, whole_rows=True)
    return mixed.select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 tokens with their lexical neighbours."""
    return packing.pack(docs, tokenizer_json(), end_id=1).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("packing", pack_windows),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

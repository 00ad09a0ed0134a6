"""The registered queries of this folder: one per operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelens.llm import content_sort, embed_dedup, html_blocks, lm_scoring, minhash, mixing, packing, perspectives, repair, resampling, sanitise, secrets, toxicity
from codelens.llm.common import documents


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


LM = lm_scoring.Settings(reach=3)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.pseudo_likelihood(documents(spark, sf_dir).select("doc_id", "text"), LM)


NEAR = minhash.Settings(words=4)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), NEAR)


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.rotate(_table(spark, sf_dir, "conversations"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = html_blocks.extract(pages, html_blocks.fit(pages))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), learn=~toxicity.held_out(F.col("doc_id")))
    scored = toxicity.score(docs.select("doc_id", "text", "lang"), model)
    threshold = model.threshold(F.col("lang"))
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        threshold.alias("lang_threshold"),
        (F.col("score") >= threshold).alias("rejected"),
    )


def tokenizer_json(name: str = "word_bpe_49k.json") -> str:
    """A public tokenizer's file, read on the driver and shipped to the tasks."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.exact_groups(documents(spark, sf_dir), keep="largest")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("domain", mixing.domain())
    return mixing.mix(docs, mixing.LEVELS, mixing.WEIGHTS, mixing.FRACTION, mixing.MAX_EPOCHS, mixing.SEED)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_json(), end_id=1).drop("ids")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise.report(documents(spark, sf_dir))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(documents(spark, sf_dir))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    return repair.report(turns, repair.repair(repair.damaged(turns)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_html_extraction": op5_html_extraction,
    "op6_toxicity": op6_toxicity,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_mixing": op8_mixing,
    "op9_packing": op9_packing,
    "op10_pii": op10_pii,
    "op11_secret_scan": op11_secret_scan,
    "op12_resampling": op12_resampling,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE: dict[str, str] = {
    "op2_minhash_near_dedup": minhash.oracle_sql(NEAR.words, NEAR.percent),
    "op3_chat_formatting": perspectives.ORACLE_SQL,
    "op4_embedding_near_dedup": embed_dedup.oracle_sql(embed_dedup.Settings().cosine),
    "op7_exact_dedup": content_sort.ORACLE_SQL,
    "op8_mixing": mixing.ORACLE_SQL,
    "op11_secret_scan": secrets.oracle_sql(),
    "op12_resampling": resampling.oracle_sql(),
    "op13_conversation_repair": repair.oracle_sql(),
}

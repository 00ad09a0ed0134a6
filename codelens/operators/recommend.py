"""Code recommendation by nearest documents, and its evaluation.

Given rows (entity, code, vector) and a train/test assignment, every test row
gets the codes of its k most similar training rows. Evaluation compares the
declared and recommended codes at a prefix length (Division = 2).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelens.operators.judge import match_flag
from codelens.operators.neighbours import nearest_neighbours

DIVISION = 2
STAT_DECIMALS = 1


def recommend(train: DataFrame, test: DataFrame, k: int, id_col: str, entity: str, code: str,
              vec_col: str = "embedding", by: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """[by], entity, actual_code, rec_code, score, rank; ``with_ids`` adds the document and its neighbour, ref_id.

    ``rank`` is the 1-based place among all recommendations of the entity, over
    all its documents: score desc, then document, then the document's own order."""
    by = list(by or [])
    q = test.select(*by, id_col, vec_col, F.col(entity), F.col(code).alias("actual_code"))
    r = train.select(*by, id_col, vec_col, F.col(code).alias("rec_code"))
    nb = nearest_neighbours(q, r, k=k, q_id=id_col, r_id=id_col, vec_col=vec_col,
                            q_payload=[entity, "actual_code"], r_payload=["rec_code"], by=by)
    place = Window.partitionBy(*by, entity).orderBy(F.col("sim").desc(), id_col, "nb_rank")
    ids = [id_col, "ref_id"] if with_ids else []
    return nb.select(*by, entity, "actual_code", "rec_code", F.col("sim").alias("score"), F.row_number().over(place).alias("rank"), *ids)


def with_matches(recs: DataFrame, prefix_len: int = DIVISION) -> DataFrame:
    return recs.withColumn("match", match_flag(F.col("actual_code"), F.col("rec_code"), prefix_len)).withColumn(
        "match_code", match_flag(F.col("actual_code"), F.col("rec_code"))
    )


def match_accuracy(recs: DataFrame, entity: str, by: list[str] | None = None, prefix_len: int = DIVISION) -> DataFrame:
    """Share of entities with at least one match (at the prefix, and on the full code)."""
    by = list(by or [])
    m = with_matches(recs, prefix_len).groupBy(*by, entity).agg(
        F.max("match").alias("m"), F.max("match_code").alias("mc")
    )
    return m.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_entities"),
        F.round(F.avg("m"), 6).alias("accuracy"),
        F.round(F.avg("mc"), 6).alias("accuracy_code"),
    )


def recommendation_stats(recs: DataFrame, entity: str, prefix_len: int = DIVISION) -> DataFrame:
    """Mean and sample std of the recommended Division (as a number) per entity."""
    r = recs.withColumn("_d", code_as_int_prefix("rec_code", prefix_len))
    return r.groupBy(entity).agg(
        F.round(F.avg("_d"), STAT_DECIMALS).alias("mean"),
        F.round(F.stddev_samp("_d"), STAT_DECIMALS).alias("std"),
    )


def code_as_int_prefix(c: str, n: int):
    return F.substring(F.col(c), 1, n).try_cast("bigint")


def overall_stats(recs: DataFrame, entity: str, prefix_len: int = DIVISION) -> DataFrame:
    """Mean of per-entity means and stds, and the mean similarity."""
    r = recs.withColumn("_d", code_as_int_prefix("rec_code", prefix_len))
    per = r.groupBy(entity).agg(F.avg("_d").alias("m"), F.stddev_samp("_d").alias("s"), F.sum("score").alias("ss"),
                                F.count(F.lit(1)).alias("n"))
    return per.agg(
        F.round(F.avg("m"), 6).alias("mean_of_means"),
        F.round(F.avg("s"), 6).alias("mean_of_stds"),
        F.round(F.sum("ss") / F.sum("n"), 6).alias("mean_score"),
    )


def result_tables(base: DataFrame, train: DataFrame, test: DataFrame, texts: DataFrame, descriptions: DataFrame, k: int,
                  id_col: str, entity: str, code: str, text: str = "text", vec_col: str = "embedding") -> dict[str, DataFrame]:
    """The recommender's six tables: results, outputs, stats, validation, training, testing.

    ``texts``: (id, text) of all documents of ``base``; ``descriptions``: (code, description), one row a code.
    Recommendations are computed and written once (a reliable checkpoint); the
    tables read them. Texts meet them by document id in two joins, for the
    validation table alone.
    """
    recs = recommend(train, test, k, id_col, entity, code, vec_col, with_ids=True).checkpoint(eager=True)
    public = [entity, "actual_code", "rec_code", "score", "rank"]
    outputs = recs.select(entity, F.substring("actual_code", 1, DIVISION).alias("actual_ssic"), F.substring("rec_code", 1, DIVISION).alias("rec_ssic"), "score", "rank")
    own = texts.select(F.col(id_col), F.col(text).alias("actual_text"))
    other = texts.select(F.col(id_col).alias("ref_id"), F.col(text).alias("rec_text"))
    validation = recs.join(own, id_col, "left").join(other, "ref_id", "left")
    for side in ("actual", "rec"):
        d = descriptions.select(F.col("code").alias(f"{side}_code"), F.col("description").alias(f"{side}_description"))
        validation = validation.join(d, f"{side}_code", "left")
    described = [F.coalesce(f"{side}_description", F.lit("")).alias(f"{side}_description") for side in ("actual", "rec")]
    stats = overall_stats(recs, entity)
    accuracy = match_accuracy(recs, entity).select("accuracy")
    measures = {"overall accuracy": accuracy, "mean similarity": stats.select("mean_score"),
                "mean of division means": stats.select("mean_of_means"), "mean of division deviations": stats.select("mean_of_stds")}
    results = [one.select(F.lit(name).alias("metric"), F.col(one.columns[0]).alias("value")) for name, one in measures.items()]
    for more in results[1:]:
        results[0] = results[0].unionByName(more)
    kept = [id_col, entity, code]
    return {
        "results": results[0], "outputs": outputs, "stats": recommendation_stats(recs, entity),
        "validation": validation.select(*public, "actual_text", "rec_text", *described),
        "training": train.select(*kept).join(texts, id_col, "left"), "testing": test.select(*kept).join(texts, id_col, "left"),
    }


def best_row_per_entity(recs: DataFrame, entity: str, prefix_len: int = DIVISION) -> DataFrame:
    """The first row per entity after sorting by match desc (then rank)."""
    m = with_matches(recs, prefix_len)
    w = Window.partitionBy(entity).orderBy(F.col("match").desc(), F.col("rank"))
    return m.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def top_k_after_dedupe(recs: DataFrame, entity: str, k: int) -> DataFrame:
    """Best score per (entity, recommended code), re-ranked, first k kept."""
    d = recs.groupBy(entity, "actual_code", "rec_code").agg(F.max("score").alias("score"))
    w = Window.partitionBy(entity).orderBy(F.col("score").desc(), F.col("rec_code"))
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def softmax(df: DataFrame, entity: str, score: str, name: str = "prob") -> DataFrame:
    """exp(x - max) / sum(exp(x - max)) per entity."""
    w = Window.partitionBy(entity)
    e = F.exp(F.col(score) - F.max(score).over(w))
    return df.withColumn("_e", e).withColumn(name, F.round(F.col("_e") / F.sum("_e").over(w), 6)).drop("_e")


def class_weighted(df: DataFrame, weights: DataFrame, code: str, score: str, name: str = "weighted_score") -> DataFrame:
    """score x class weight; classes without a weight keep weight 1. The weight
    table has one row per class, bounded by the code domain: broadcast."""
    j = df.join(F.broadcast(weights), code, "left")
    return j.withColumn(name, F.col(score) * F.coalesce("weight", F.lit(1.0)))

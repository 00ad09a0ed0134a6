"""MLlib models standing in for the per-machine models of the original.

* text classifier: regex tokens -> stop words -> hashed TF -> IDF -> Naive
  Bayes (or multinomial logistic regression); the class level is a parameter.
* top-N scoring: probabilities -> array -> posexplode -> per-entity top-N,
  class index mapped back to the code with IndexToString (JVM side).
* clustering: the weights of ``operators.tfidf`` over 1,000 terms as sparse unit
  vectors -> KMeans(k=10, seed=0).
* cross-validation: CrossValidator on given folds.

Quality is not comparable with a fine-tuned transformer; these are the
distributed, seeded equivalents.
"""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import (
    IDF,
    CountVectorizerModel,
    ElementwiseProduct,
    HashingTF,
    IndexToString,
    Normalizer,
    RegexTokenizer,
    StopWordsRemover,
    StringIndexer,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelens.functions.text import STOP_WORDS, tokenize_words
from codelens.operators.tfidf import MIN_TOKEN_LEN

TOKEN_GAPS = r"[^\p{L}]+"
# Hashed feature space; Naive Bayes keeps a dense classes x features matrix
# that every scoring task receives, so keep it moderate.
NUM_FEATURES = 1 << 15


def _tokenizer(text_col: str) -> list:
    return [
        RegexTokenizer(inputCol=text_col, outputCol="_tokens", pattern=TOKEN_GAPS, gaps=True, toLowercase=True,
                       minTokenLength=2),
        StopWordsRemover(inputCol="_tokens", outputCol="_words", stopWords=STOP_WORDS),
    ]


def train_text_classifier(train: DataFrame, text_col: str, label_col: str, model: str = "nb",
                          max_iter: int = 50, num_features: int = NUM_FEATURES) -> PipelineModel:
    """Fit a text -> label pipeline; labels are indexed in alphabetical order.
    Raise ``num_features`` with the vocabulary: distinct words share a feature beyond it."""
    stages = _tokenizer(text_col) + [
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=num_features),
        IDF(inputCol="_tf", outputCol="_features"),
        StringIndexer(inputCol=label_col, outputCol="_label", handleInvalid="skip", stringOrderType="alphabetAsc"),
    ]
    if model == "nb":
        clf = NaiveBayes(featuresCol="_features", labelCol="_label", modelType="multinomial", smoothing=1.0)
    else:
        clf = LogisticRegression(featuresCol="_features", labelCol="_label", maxIter=max_iter, family="multinomial")
    return Pipeline(stages=stages + [clf]).fit(train)


def class_labels(model: PipelineModel) -> list[str]:
    """Class index -> label (the indexer's label list; bounded by the classes)."""
    for st in model.stages:
        if hasattr(st, "labels") and st.__class__.__name__ == "StringIndexerModel":
            return list(st.labels)
    raise ValueError("no StringIndexerModel in pipeline")


def score_top_n(model: PipelineModel, df: DataFrame, entity: str, text_col: str, top_n: int,
                keep: list[str] | None = None, out_col: str = "pred_code") -> DataFrame:
    """Per entity: the top_n classes with probability and 1-based rank.

    The top-N is taken inside each row: the probability array is sorted as
    (-probability, class index) structs and sliced, and only the kept N are
    exploded. No row per class, no window, no shuffle."""
    keep = keep or []
    # the label indexer is a training stage: scoring rows have no label
    scorer = PipelineModel([st for st in model.stages if st.__class__.__name__ != "StringIndexerModel"])
    in_col = model.stages[0].getInputCol()  # the text column the model was fitted on
    pred = scorer.transform(df.select(entity, F.col(text_col).alias(in_col), *keep))
    ranked = F.slice(F.sort_array(F.transform(
        vector_to_array("probability"), lambda p, i: F.struct((-p).alias("neg"), i.alias("idx")))), 1, top_n)
    top = pred.select(entity, *keep, F.posexplode(ranked).alias("_pos", "_s"))
    top = top.select(entity, *keep, (F.col("_pos") + 1).alias("rank"), (-F.col("_s.neg")).alias("score"),
                     F.col("_s.idx").cast("double").alias("_idx"))
    top = IndexToString(inputCol="_idx", outputCol=out_col, labels=class_labels(model)).transform(top)
    return top.select(entity, *keep, out_col, F.round("score", 6).alias("score"), "rank")


def weighted_vectors(df: DataFrame, text_col: str, vocab: int = 1000, out_col: str = "_features") -> DataFrame:
    """``df`` with sparse unit vectors of the weights of ``operators.tfidf``: idf = ln((1 + n) / (1 + df)) + 1 over
    the ``vocab`` terms of the largest corpus count.

    The term index, ``vocab`` rows, comes from partial aggregates; counting,
    weighting and norm are column transformers on sparse vectors, so no row is
    exploded and nothing is shuffled but the counts. A text without such a term
    has the zero vector.
    """
    tokens = F.filter(tokenize_words(F.coalesce(F.col(text_col), F.lit("")), "unicode"), lambda t: F.length(t) >= MIN_TOKEN_LEN)
    rows = df.withColumn("_tokens", tokens)
    one = F.count(F.lit(1))
    uses = rows.select(F.explode("_tokens").alias("term")).groupBy("term").agg(one.alias("total"))
    index = uses.orderBy(F.col("total").desc(), F.col("term")).limit(vocab)
    documents = rows.select(F.explode(F.array_distinct("_tokens")).alias("term")).groupBy("term").agg(one.alias("df"))
    found = index.join(documents, "term").orderBy(F.col("total").desc(), F.col("term")).collect()
    n = df.count()
    counter = CountVectorizerModel.from_vocabulary([r["term"] for r in found] or [""], inputCol="_tokens", outputCol="_tf")
    idf = Vectors.dense([math.log((1 + n) / (1 + r["df"])) + 1 for r in found] or [0.0])
    weigh = ElementwiseProduct(scalingVec=idf, inputCol="_tf", outputCol="_idf")
    unit = Normalizer(inputCol="_idf", outputCol=out_col, p=2.0)
    return unit.transform(weigh.transform(counter.transform(rows))).drop("_tokens", "_tf", "_idf")


def kmeans_clusters(df: DataFrame, text_col: str, k: int = 10, seed: int = 0, vocab: int = 1000) -> DataFrame:
    """Cluster id per row from TF-IDF vectors (``weighted_vectors``)."""
    rows = weighted_vectors(df, text_col, vocab)
    model = KMeans(featuresCol="_features", predictionCol="cluster", k=k, seed=seed).fit(rows)
    return model.transform(rows).drop("_features")


def cross_validate(df: DataFrame, text_col: str, label_col: str, fold_col: str, folds: int, smoothing: list[float],
                   num_features: int = NUM_FEATURES) -> list[tuple[float, float]]:
    """(smoothing, mean accuracy over the folds) of the naive Bayes pipeline, by MLlib's ``CrossValidator``
    on the folds that ``fold_col`` (0 .. folds - 1) names.

    Texts are parted and hashed once: these steps learn nothing, so each fold and
    smoothing reads the written term counts."""
    indexer = StringIndexer(inputCol=label_col, outputCol="_label", handleInvalid="skip", stringOrderType="alphabetAsc")
    rows = indexer.fit(df).transform(df)
    for step in [*_tokenizer(text_col), HashingTF(inputCol="_words", outputCol="_tf", numFeatures=num_features)]:
        rows = step.transform(rows)
    rows = rows.select("_tf", "_label", fold_col).checkpoint(eager=True)
    bayes = NaiveBayes(featuresCol="_features", labelCol="_label", modelType="multinomial")
    stages = [IDF(inputCol="_tf", outputCol="_features"), bayes]
    grid = ParamGridBuilder().addGrid(bayes.smoothing, smoothing).build()
    measure = MulticlassClassificationEvaluator(labelCol="_label", predictionCol="prediction", metricName="accuracy")
    found = CrossValidator(estimator=Pipeline(stages=stages), estimatorParamMaps=grid, evaluator=measure, numFolds=folds, foldCol=fold_col).fit(rows)
    return list(zip(smoothing, found.avgMetrics, strict=True))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)

"""Nearest-centroid labelling (the re-aim of zero-shot label scoring).

Label centroids are the mean vector of each label's training rows: the
vectors are exploded to (label, dim, value) and averaged with a partial
aggregate, then folded back into one array per label. Scoring reuses the
blocked top-k neighbour search with k = 1, so no cross join is planned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelens.operators.neighbours import nearest_neighbours


def label_centroids(train: DataFrame, vec_col: str, label: str) -> DataFrame:
    el = train.select(label, F.posexplode(vec_col).alias("i", "x"))
    m = el.groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return m.groupBy(label).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias(vec_col)
    )


def centroid_classifier(train: DataFrame, test: DataFrame, id_col: str, label: str, vec_col: str = "embedding") -> DataFrame:
    cents = label_centroids(train, vec_col, label)
    nb = nearest_neighbours(
        test.select(id_col, F.col(vec_col).cast("array<double>").alias(vec_col)),
        cents.select(label, vec_col),
        k=1, q_id=id_col, r_id=label, vec_col=vec_col,
    )
    return nb.select(id_col, label, "sim")

"""Exact deduplication by sorting content (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelens.llm.common import shuffle_width, stored, text_or_empty

SALTS = 64
#: Characters of a text in a splitter.
LEAD = 32
#: A text with more rows than this share of a sort task's fair share is cut into salted runs.
HOT_SHARE = 0.125
#: Columns that rows of one run share; the last is the whole text, compared in full.
RUN = ("__lead", "__hash", "__salt", "__text")


def exact_groups(
    docs: DataFrame, keep: str = "largest", normalise=None, salts: int = SALTS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    ``repartitionByRange`` samples splitters and deals the normalised texts out
    by range; each task sorts its range, on disk when memory runs out, so equal
    texts are neighbours, and the window compares each text with its neighbour
    in full: a run of equal texts gives each of its rows the run's best id and its
    length. A splitter is the first ``LEAD`` characters, then a hash of the
    whole text for those that begin alike, then a salt: the sample that the
    driver sees is bounded however long texts are.

    The salt is 0 but for hot texts, those with more than ``HOT_SHARE`` of a task's
    fair share of rows (counted before by their hash, combined before the
    shuffle; there can be at most 8 times as many as there are tasks). They are cut into ``salts`` runs
    in as many tasks, and the heads of these runs alone are joined by the SHA-256 of the text.

    ``keep``: "smallest" or "largest" id of a group stays. ``normalise``: a
    function Column -> Column applied before comparing (None: no change).
    Null and empty texts are equal to each other. Of rows that repeat an id and
    its text one is kept. A null id stays only if its group has no other.
    Other columns are ignored. An empty table gives no rows.
    """
    best = _best(keep)
    marked = stored(_runs(docs, keep, normalise, salts, id_col, text_col, payload=()), "exact")
    heads = marked.where("__hot and __place = 1")
    # a head a salt, the first of them by salt where several have the best id
    better = _rank(keep)
    hot = heads.groupBy("text_sha256").agg(best(better).alias("best"), F.sum("__size").alias("all"))
    hot = stored(hot.select("text_sha256", F.col("best.__id").alias("hot_id"), F.col("best.__salt").alias("hot_salt"), "all"), "exact-hot")
    out = marked.join(F.broadcast(hot), "text_sha256", "left")
    keep_id = F.when(F.col("__hot"), F.col("hot_id")).otherwise(F.col("__first"))
    first = (F.col("__place") == 1) & (~F.col("__hot") | (F.col("__salt") == F.col("hot_salt")))
    return out.select(
        F.col("__id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("all", "__size").alias("group_size"),
        first.alias("kept"),
        "text_sha256",
    )


def _best(keep: str):
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    return F.max if keep == "largest" else F.min


def _rank(keep: str):
    """What heads are compared by: a null id is worse than any."""
    known = F.col("__id").isNotNull() if keep == "largest" else F.col("__id").isNull()
    return F.struct(known.alias("known"), F.col("__id"), F.col("__salt"))


def _runs(docs: DataFrame, keep: str, normalise, salts: int, id_col: str, text_col: str, payload: Sequence[str]) -> DataFrame:
    """Every row with its place in its run of equal texts (1: the best id), the run's best id and size, and ``payload`` as the struct ``__row``."""
    text = text_or_empty(text_col)
    if normalise is not None:
        text = normalise(text)
    width = shuffle_width(docs.sparkSession)
    many = HOT_SHARE * docs.count() / width
    hashes = docs.select(F.xxhash64(text).alias("__hash")).groupBy("__hash").agg(F.count(F.lit(1)).alias("n"))
    hot = stored(hashes.where(F.col("n") > max(1.0, many)).select("__hash", F.lit(True).alias("__hot")), "exact-hot-hashes")
    carried = [F.struct(*[F.col(c) for c in payload]).alias("__row")] if payload else []
    rows = docs.select(
        F.col(id_col).alias("__id"), text.alias("__text"), F.substring(text, 1, LEAD).alias("__lead"), F.xxhash64(text).alias("__hash"), *carried
    )
    rows = rows.join(F.broadcast(hot), "__hash", "left").withColumn("__hot", F.coalesce("__hot", F.lit(False)))
    dealt = F.pmod(F.xxhash64("__id", F.monotonically_increasing_id()), F.lit(salts))
    rows = rows.withColumn("__salt", F.when(F.col("__hot"), dealt).otherwise(F.lit(0).cast("long")))
    ranged = rows.repartitionByRange(width, *RUN[:3])
    run = Window.partitionBy(*RUN)
    order = F.col("__id").desc_nulls_last() if keep == "largest" else F.col("__id").asc_nulls_last()
    columns = ["__id", "__salt", "__hot", *(["__row"] if payload else [])]
    return ranged.select(
        *columns,
        F.row_number().over(run.orderBy(order)).alias("__place"),
        F.first("__id").over(run.orderBy(order)).alias("__first"),
        F.count(F.lit(1)).over(run).alias("__size"),
        F.sha2(F.col("__text"), 256).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, keep: str = "largest", normalise=None, salts: int = SALTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group of equal texts (see ``exact_groups``).

    Rows travel through the one sort by content; the runs of a hot text, which was
    dealt to several tasks, leave a head each, and all heads but the best are
    taken out by their hash and salt.
    """
    best = _best(keep)
    heads = _runs(docs, keep, normalise, salts, id_col, text_col, payload=docs.columns).where("__place = 1")
    heads = stored(heads.drop("__first", "__size", "__place"), "exact-heads")
    hot = heads.where("__hot").select("text_sha256", "__id", "__salt")
    kept = hot.groupBy("text_sha256").agg(best(_rank(keep)).alias("best")).select("text_sha256", F.col("best.__salt").alias("__kept"))
    beaten = hot.join(kept, "text_sha256").where("__salt <> __kept").select("text_sha256", "__salt")
    return heads.join(F.broadcast(stored(beaten, "exact-beaten")), ["text_sha256", "__salt"], "left_anti").select("__row.*")


ORACLE_SQL = """
WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM t
"""

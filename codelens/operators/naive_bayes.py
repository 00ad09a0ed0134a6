"""Multinomial naive Bayes as tables: counts, joins and sums.

Fitting counts words per class (a partial aggregate; a word of every text costs
one combined row per class and map task). The model is two tables: ``classes``
(one row per class) and ``terms`` (one row per word with its classes). The
vocabulary is exact: no hashing, no matrix on the driver or in a task.

With add-one smoothing a word that a class never had adds ln(0 + 1) = 0, so

    score(d, c) = ln P(c) + sum over words of d that c has of tf * ln(n_ct + 1)
                  - (words of d in the vocabulary) * ln(N_c + V)

and only the (word, class) pairs that occur are joined. Logarithms enter as whole
millionths, whose sums are exact in any order and any engine.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelens.functions.text import STOP_WORDS, tokenize_words
from codelens.operators.tfidf import run_starts
from codelens.session import shuffle_width

SCALE = 1_000_000
MIN_TOKEN_LEN = 2
# The model's words are broadcast up to so many, with their classes up to so many (word, class) pairs.
BROADCAST_MAX_TERMS = 2_000_000
BROADCAST_MAX_PAIRS = 2_000_000
# (word, class) pairs that a task sums, about: some 100 bytes each if all of them were of different rows.
PAIRS_PER_TASK = 4_000_000


def model_words(text: str) -> Column:
    """Lower-cased runs of two or more letters that are no stop words."""
    return F.filter(tokenize_words(text, "unicode"), lambda t: (F.length(t) >= MIN_TOKEN_LEN) & ~t.isin(*STOP_WORDS))


def _units(value: Column) -> Column:
    return F.round(F.log(value) * SCALE).cast("bigint")


@dataclass(frozen=True)
class Model:
    """``classes``: label, prior, log_total. ``terms``: term, weights (label, weight of each class that has it)."""

    classes: DataFrame
    terms: DataFrame

    def save(self, path: str) -> None:
        self.classes.write.mode("overwrite").parquet(f"{path}/classes")
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        return Model(spark.read.parquet(f"{path}/classes"), spark.read.parquet(f"{path}/terms"))


def fit(train: DataFrame, text: str, label: str) -> Model:
    """Count words per class. Rows without a label are left out; a text without a word counts for its class's prior.

    The counts are written with a reliable checkpoint: both tables, and all that is
    scored with them, read them from there.
    """
    rows = train.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.col(text).alias("text"))
    words = rows.select("label", F.explode(model_words("text")).alias("term"))
    counts = words.groupBy("term", "label").agg(F.count(F.lit(1)).alias("n")).checkpoint(eager=True)
    terms = counts.groupBy("term").agg(F.sort_array(F.collect_list(F.struct("label", _units(F.col("n") + 1).alias("weight")))).alias("weights"))
    terms = terms.checkpoint(eager=True)
    vocabulary = terms.count()
    docs = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n_docs")).checkpoint(eager=True)
    total = docs.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
    sizes = counts.groupBy(F.col("label").alias("l")).agg(F.sum("n").alias("n_words"))
    known = docs.join(sizes, F.col("label") == F.col("l"), "left")
    size = F.greatest(F.coalesce("n_words", F.lit(0)) + vocabulary, F.lit(1))
    classes = known.select("label", _units(F.col("n_docs") / F.lit(float(max(total, 1)))).alias("prior"), _units(size).alias("log_total"))
    return Model(classes.checkpoint(eager=True), terms)


def _counted_words(df: DataFrame, entity: str, text: str) -> DataFrame:
    """(_e, term, tf): a row's words, sorted and counted inside the row."""
    rows = df.select(F.col(entity).alias("_e"), F.sort_array(F.coalesce(model_words(text), F.array().cast("array<string>"))).alias("_words"))
    rows = rows.withColumn("_begin", run_starts("_words"))

    def entry(first: Column, i: Column) -> Column:
        n = F.coalesce(F.get("_begin", i + 1), F.size("_words")) - first
        return F.struct(F.get("_words", first).alias("term"), n.cast("bigint").alias("tf"))

    return rows.select("_e", F.explode(F.transform("_begin", entry)).alias("w")).select("_e", "w.term", "w.tf")


def score_top_n(model: Model, df: DataFrame, entity: str, text: str, top_n: int, keep: list[str] | None = None, out_col: str = "pred_code") -> DataFrame:
    """Per row of ``df`` (one per entity): the ``top_n`` classes with probability (6 decimals) and 1-based rank.

    Texts are not shuffled, and words are counted inside their row: the known words
    of a text are written as (row's id, word, count), dealt by id to as many tasks as
    their (word, class) pairs ask for, and meet the words' classes there. So a task
    sums about ``PAIRS_PER_TASK`` pairs however large the table is. Each document's
    sums, one for a class at most, are put beside its row. Ties go to the smaller
    label. A text without a known word is ranked by the priors alone.
    """
    keep = keep or []
    size = model.terms.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("weights")), F.lit(0)).alias("pairs"), F.coalesce(F.max(F.size("weights")), F.lit(0)).alias("most")).first()
    known = model.terms.select("term")
    bag = _counted_words(df, entity, text).join(F.broadcast(known) if size["n"] <= BROADCAST_MAX_TERMS else known, "term")
    bag = bag.checkpoint(eager=True)
    tasks = max(shuffle_width(df.sparkSession), math.ceil(bag.count() * size["most"] / PAIRS_PER_TASK))
    # an entry without a label counts the words that are known
    weights = F.explode(F.concat(F.array(F.struct(F.lit(None).cast("string").alias("label"), F.lit(1).cast("bigint").alias("weight"))), "weights")).alias("w")
    if size["pairs"] <= BROADCAST_MAX_PAIRS:
        hits = bag.repartition(tasks, "_e").join(F.broadcast(model.terms), "term").select("_e", "tf", weights)
    else:
        hits = bag.join(model.terms, "term").select("_e", "tf", weights).repartition(tasks, "_e")
    sums = hits.groupBy("_e", F.col("w.label").alias("label")).agg(F.sum(F.col("tf") * F.col("w.weight")).alias("s"))
    own = sums.groupBy("_e").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label", "s")))).alias("own"),
        F.max(F.when(F.col("label").isNull(), F.col("s"))).alias("words"),
    )
    classes = model.classes.agg(F.sort_array(F.collect_list(F.struct("label", "prior", "log_total")))).scalar()
    # a row of sums is wide, many times what it is made of: measured before, it must not be broadcast
    rows = df.select(entity, *keep).repartition(tasks, entity).join(own.hint("merge"), F.col(entity) == F.col("_e"), "left").withColumn("_classes", classes)
    found = F.coalesce("own", F.create_map().cast("map<string,bigint>"))
    score = F.transform(
        "_classes",
        lambda c: F.struct(
            (F.coalesce("words", F.lit(0)) * c["log_total"] - c["prior"] - F.coalesce(F.try_element_at(found, c["label"]), F.lit(0))).alias("loss"),
            c["label"].alias("label"),
        ),
    )
    rows = rows.withColumn("_ranked", F.sort_array(score))

    def share(x: Column) -> Column:
        return F.exp((F.col("_ranked")[0]["loss"] - x["loss"]) / SCALE)

    rows = rows.withColumn("_all", F.aggregate("_ranked", F.lit(0.0), lambda acc, x: acc + share(x)))
    top = F.transform(F.slice("_ranked", 1, top_n), lambda x, i: F.struct(x["label"].alias("label"), F.round(share(x) / F.col("_all"), 6).alias("score"), (i + 1).alias("rank")))
    out = rows.select(entity, *keep, F.explode(top).alias("_t"))
    return out.select(entity, *keep, F.col("_t.label").alias(out_col), "_t.score", "_t.rank")


def words_sql(text: str) -> str:
    words = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)
    return (f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}]+'), "
            f"lambda t: length(t) >= {MIN_TOKEN_LEN} AND NOT list_contains([{words}], t))")


def fit_sql(train: str, prefix: str = "nb") -> tuple[tuple[str, str], ...]:
    """CTEs {prefix}_n, _classes, _terms over a relation (text, label)."""
    p = prefix
    return (
        (f"{p}_rows", f"SELECT label, text FROM {train} WHERE label IS NOT NULL"),
        (f"{p}_n", f"SELECT term, label, count(*) AS n FROM (SELECT label, unnest({words_sql('text')}) AS term FROM {p}_rows) x GROUP BY ALL"),
        (f"{p}_v", f"SELECT count(DISTINCT term) AS v FROM {p}_n"),
        (f"{p}_size", f"SELECT label, sum(n) AS n_words FROM {p}_n GROUP BY label"),
        (f"{p}_classes", f"SELECT d.label, round(ln(n_docs::DOUBLE / (SELECT count(*) FROM {p}_rows)) * {SCALE})::BIGINT AS prior, "
                         f"round(ln(greatest(coalesce(n_words, 0) + (SELECT v FROM {p}_v), 1)::DOUBLE) * {SCALE})::BIGINT AS log_total "
                         f"FROM (SELECT label, count(*) AS n_docs FROM {p}_rows GROUP BY label) d LEFT JOIN {p}_size s ON d.label = s.label"),
        (f"{p}_terms", f"SELECT term, label, round(ln((n + 1)::DOUBLE) * {SCALE})::BIGINT AS w FROM {p}_n"),
    )


def score_sql(docs: str, entity: str, text: str, top_n: int, prefix: str = "nb", out: str = "nb_top") -> tuple[tuple[str, str], ...]:
    """CTEs ending in ``out`` (entity, label, score, rank)."""
    p = prefix
    return (
        (f"{out}_bag", f"SELECT {entity}, term, count(*) AS tf FROM (SELECT {entity}, unnest({words_sql(text)}) AS term FROM {docs}) x "
                       f"WHERE term IN (SELECT term FROM {p}_terms) GROUP BY ALL"),
        (f"{out}_len", f"SELECT {entity}, sum(tf) AS words FROM {out}_bag GROUP BY {entity}"),
        (f"{out}_sum", f"SELECT {entity}, label, sum(tf * w) AS s FROM {out}_bag JOIN {p}_terms USING (term) GROUP BY ALL"),
        (f"{out}_score", f"SELECT d.{entity}, c.label, (c.prior + coalesce(s.s, 0) - coalesce(l.words, 0) * c.log_total)::BIGINT AS v "
                         f"FROM {docs} d CROSS JOIN {p}_classes c LEFT JOIN {out}_sum s ON s.{entity} = d.{entity} AND s.label = c.label "
                         f"LEFT JOIN {out}_len l ON l.{entity} = d.{entity}"),
        (f"{out}_prob", f"SELECT *, exp((v - max(v) OVER w)::DOUBLE / {SCALE}) AS e FROM {out}_score WINDOW w AS (PARTITION BY {entity})"),
        (out, f"SELECT {entity}, label, round(e / sum(e) OVER (PARTITION BY {entity}), 6) AS score, "
              f"CAST(row_number() OVER (PARTITION BY {entity} ORDER BY v DESC, label) AS INTEGER) AS rank FROM {out}_prob QUALIFY rank <= {top_n}"),
    )

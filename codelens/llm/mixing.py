"""Mixing sources to target weights down a tree of groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelens.llm.common import stored

#: Runs of the seeded order into which every leaf is cut.
RUNS = 4096


def word_count(text: Column) -> Column:
    """Words between ASCII white space."""
    trimmed = F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def seeded_draw(key: Column, seed: int, epoch: Column) -> Column:
    """A whole number below 2^28 that looks random in (id, epoch)."""
    text = F.concat_ws("/", F.lit(str(seed)), epoch.cast("string"), key.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long")


def tree_budgets(
    leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, float]], total: float, max_epochs: int
) -> DataFrame:
    """Budgets (tokens) of the leaves of a tree.

    ``leaves``: a row per leaf with the columns ``levels`` and ``tokens``. A node
    can hold its tokens times ``max_epochs``. From the root down, the children of
    a node share its budget by weight, none above what it can hold: the children
    that weight would overfill are filled, and the others share what is left by
    weight. A shortage therefore goes to siblings first, and reaches the
    parent's siblings only when all siblings are full. A value that ``weights``
    of its level lacks weighs 1; a weight of 0 or less gives nothing.
    Every sum is over nodes, never over documents.
    """
    closed = F.lit(False)
    for level in levels:
        closed |= _weight(level, weights) <= 0
    nodes = leaves.select(*levels, F.when(closed, 0.0).otherwise((F.col("tokens") * max_epochs).cast("double")).alias("room"))
    parent, above = None, []
    for i, level in enumerate(levels):
        keys = list(levels[: i + 1])
        children = nodes.groupBy(*keys).agg(F.sum("room").alias("room")).withColumn("weight", _weight(level, weights))
        joined = _join_null_safe(children, parent, above) if above else children.withColumn("budget", F.lit(float(total)))
        parent = _share(joined, above, level).select(*keys, "budget")
        above = keys
    return parent


def _weight(level: str, weights: Mapping[str, Mapping[str, float]]) -> Column:
    out = F.lit(1.0)
    for value, w in weights.get(level, {}).items():
        out = F.when(F.col(level).cast("string") == str(value), F.lit(float(w))).otherwise(out)
    return out


def _join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    right = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return left.join(right, on).drop(*[f"__{k}" for k in keys])


def _share(children: DataFrame, above: Sequence[str], level: str) -> DataFrame:
    """Fill in order of room / weight; after the filled ones the rest has one price per weight."""
    ratio = F.when(F.col("weight") > 0, F.col("room") / F.col("weight")).otherwise(F.lit(-1.0))
    order = Window.partitionBy(*above).orderBy(F.col("__ratio"), F.col(level))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    c = children.withColumn("__ratio", ratio)
    c = c.withColumn("__filled", F.coalesce(F.sum("room").over(before), F.lit(0.0)))
    c = c.withColumn("__weights", F.sum(F.greatest("weight", F.lit(0.0))).over(after))
    price = F.when(F.col("__weights") > 0, (F.col("budget") - F.col("__filled")) / F.col("__weights")).otherwise(0.0)
    c = c.withColumn("__price", price).withColumn("__fits", (F.col("__ratio") > F.col("__price")).cast("int"))
    whole = Window.partitionBy(*above)
    final = F.min(F.when(F.col("__fits") == 1, F.struct("__ratio", F.col(level).alias("l"), "__price"))).over(whole)
    c = c.withColumn("__final", final["__price"])
    share = F.when(F.col("weight") <= 0, 0.0).when(F.col("__final").isNull(), F.col("room"))
    return c.withColumn("budget", share.otherwise(F.least("room", F.col("weight") * F.col("__final"))))


def mix(
    docs: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, float]], fraction: float = 0.5,
    max_epochs: int = 4, seed: int = 17, runs: int = RUNS, id_col: str = "doc_id", tokens: Column | None = None,
    whole_rows: bool = False,
) -> DataFrame:
    """Documents chosen to fill the budgets: levels, id, tokens, epoch, n_epochs, leaf_tokens, budget.

    The total budget is ``fraction`` of all tokens. Each leaf is read in epochs;
    an epoch is a seeded order of all the leaf's documents. Whole epochs are
    taken while the budget lasts, then from the next one the documents before
    which less than the rest has been taken: the prefix that reaches the budget,
    by less than one document above it. A row per document and whole or part
    epoch: ``epoch`` counts from 0.

    A leaf's order is cut in ``runs`` runs by the leading digits of the draw.
    Token sums per run say in which run the prefix ends; only the documents of
    that run are sorted, so a leaf with a third of all rows is never one task.
    Runs need no tuning for results: they only bound what is sorted together.
    With ``whole_rows`` the rows of ``docs`` come back instead, as often as they
    are chosen; their texts are not shuffled, but for those of the last runs.

    Nulls in a level are a group of their own; null and empty texts have no
    tokens and come with any epoch that is taken whole, and in a prefix if they
    come before its end. Ties of the draw go by id. Rows that repeat an id are
    separate rows. Extra columns are ignored. An empty table gives no rows.
    """
    count = tokens if tokens is not None else word_count(F.coalesce(F.col("text"), F.lit("")))
    light = [*[F.col(c) for c in levels], F.col(id_col).alias("__id"), count.cast("long").alias("tokens")]
    rows = stored(docs.select(*light), "mix-rows")
    leaves = rows.groupBy(*levels).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    leaves = stored(leaves, "mix-leaves")
    total = leaves.agg((F.sum("tokens") * F.lit(float(fraction))).alias("t")).first()[0] or 0.0
    budgets = tree_budgets(leaves, levels, weights, float(total), max_epochs)
    budgets = budgets.select(*[F.col(c).alias(f"__{c}") for c in levels], "budget")
    null_safe = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in levels]
    plan = leaves.withColumnRenamed("tokens", "leaf_tokens").join(budgets, null_safe).drop(*[f"__{c}" for c in levels])
    whole = F.when(F.col("leaf_tokens") > 0, F.floor(F.col("budget") / F.col("leaf_tokens"))).otherwise(F.lit(0))
    plan = plan.withColumn("whole", whole.cast("long"))
    plan = plan.withColumn("rest", F.floor(F.col("budget") - F.col("whole") * F.col("leaf_tokens")).cast("long"))
    plan = stored(plan, "mix-plan").select(*[F.col(c).alias(f"__{c}") for c in levels], "leaf_tokens", "budget", "whole", "rest")

    def drawn(frame: DataFrame) -> DataFrame:
        out = frame.join(plan, null_safe).drop(*[f"__{c}" for c in levels])
        out = out.withColumn("draw", seeded_draw(F.col("__id"), seed, F.col("whole")))
        return out.withColumn("run", F.floor(F.col("draw") * runs / (1 << 28)).cast("int"))

    placed = drawn(rows)
    sums = placed.groupBy(*levels, "run").agg(
        F.sum("tokens").alias("run_tokens"), F.first("rest").alias("rest")
    )
    up_to = Window.partitionBy(*levels).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("run_tokens").over(up_to), F.lit(0).cast("long")))
    ends = sums.where("before < rest and before + run_tokens >= rest")
    ends = ends.select(*[F.col(c).alias(f"__{c}") for c in levels], F.col("run").alias("end_run"), F.col("before").alias("end_before"))
    ends = stored(ends, "mix-ends")
    if whole_rows:
        placed = drawn(docs.select(*light, F.struct(*[F.col(c) for c in docs.columns]).alias("__row")))
    named = placed.join(ends, null_safe, "left").drop(*[f"__{c}" for c in levels])
    inside = Window.partitionBy(*levels, "run").orderBy("draw", "__id").rowsBetween(Window.unboundedPreceding, -1)
    edge = named.where("run = end_run").withColumn(
        "taken", F.col("end_before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0).cast("long"))
    )
    prefix = named.where("run < end_run").drop("end_run", "end_before").union(
        edge.where("taken < rest").select(*[c for c in named.columns if c not in ("end_run", "end_before")])
    )
    cols = [F.col("__row")] if whole_rows else [*levels, F.col("__id").alias(id_col), "tokens"]
    epochs = placed.where("whole > 0").select(
        *cols, F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("epoch"), "leaf_tokens", "budget"
    )
    part = prefix.select(*cols, F.col("whole").alias("epoch"), "leaf_tokens", "budget")
    chosen = epochs.union(part)
    return chosen.select("__row.*") if whole_rows else chosen


def domain() -> Column:
    """Top-level groups of the test tables: the source's number modulo 4."""
    number = F.regexp_extract(F.coalesce(F.col("source"), F.lit("")), r"([0-9]+)$", 1).try_cast("int")
    return F.concat(F.lit("domain"), F.pmod(number, F.lit(4)).cast("string"))


LEVELS = ("domain", "lang", "source")
WEIGHTS = {
    "domain": {"domain0": 4.0, "domain1": 3.0, "domain2": 2.0, "domain3": 1.0},
    "lang": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0},
    "source": {},
}
FRACTION, MAX_EPOCHS, SEED = 1.0, 4, 17


def _oracle() -> str:
    """The same budgets and prefixes as one SQL statement over ``documents``."""
    parts = [
        """rows AS (
  SELECT 'domain' || (try_cast(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) AS INT) % 4) AS domain, lang, source, doc_id,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS tokens
  FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens FROM rows GROUP BY ALL)"""
    ]
    above: list[str] = []
    for i, level in enumerate(LEVELS):
        keys = ", ".join(LEVELS[: i + 1])
        cases = "".join(f" WHEN {level} = '{k}' THEN {v}::DOUBLE" for k, v in WEIGHTS[level].items())
        weight = f"CASE{cases} ELSE 1.0::DOUBLE END" if cases else "1.0::DOUBLE"
        over = f"PARTITION BY {', '.join(above)} " if above else ""
        budget = "p.budget" if above else f"(SELECT sum(tokens) * {FRACTION}::DOUBLE FROM leaves)"
        on = " AND ".join(f"c.{k} IS NOT DISTINCT FROM p.{k}" for k in above)
        join = f"JOIN budget{i - 1} p ON {on}" if above else ""
        parts.append(f"""
room{i} AS (SELECT {keys}, sum(tokens * {MAX_EPOCHS})::DOUBLE AS room, {weight} AS weight FROM leaves GROUP BY {keys}),
price{i} AS (
  SELECT *, (budget - filled) / weights AS price FROM (
    SELECT c.*, {budget} AS budget, c.room / c.weight AS ratio,
           coalesce(sum(c.room) OVER ({_prefixed(over)}ORDER BY c.room / c.weight, c.{level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
           sum(c.weight) OVER ({_prefixed(over)}ORDER BY c.room / c.weight, c.{level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
    FROM room{i} c {join})),
budget{i} AS (
  SELECT {keys}, CASE WHEN last_price IS NULL THEN room ELSE least(room, weight * last_price) END AS budget FROM (
    SELECT *, arg_min(CASE WHEN ratio > price THEN price END, CASE WHEN ratio > price THEN ratio END) OVER ({over}) AS last_price
    FROM price{i}))""")
        above = list(LEVELS[: i + 1])
    last = len(LEVELS) - 1
    parts.append(f"""
plan AS (
  SELECT l.*, b.budget, CASE WHEN l.tokens > 0 THEN floor(b.budget / l.tokens) ELSE 0 END::BIGINT AS whole
  FROM leaves l JOIN budget{last} b ON l.domain IS NOT DISTINCT FROM b.domain AND l.lang IS NOT DISTINCT FROM b.lang AND l.source IS NOT DISTINCT FROM b.source),
placed AS (
  SELECT r.*, p.tokens AS leaf_tokens, p.budget, p.whole, floor(p.budget - p.whole * p.tokens)::BIGINT AS rest,
         ('0x' || substr(md5('{SEED}/' || p.whole || '/' || r.doc_id), 1, 7))::BIGINT AS draw
  FROM rows r JOIN plan p ON r.domain IS NOT DISTINCT FROM p.domain AND r.lang IS NOT DISTINCT FROM p.lang AND r.source IS NOT DISTINCT FROM p.source),
ordered AS (
  SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY draw, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken
  FROM placed)""")
    cols = "domain, lang, source, doc_id, tokens, {} AS epoch, leaf_tokens, budget"
    return (
        "WITH " + ",".join(parts)
        + f"\nSELECT {cols.format('whole')} FROM ordered WHERE taken < rest"
        + f"\nUNION ALL SELECT {cols.format('unnest(range(whole))')} FROM placed WHERE whole > 0"
    )


def _prefixed(over: str) -> str:
    return over.replace("PARTITION BY ", "PARTITION BY c.").replace(", ", ", c.")


ORACLE_SQL = _oracle()

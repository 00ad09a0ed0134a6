"""Judge ranked candidate codes against declared primary/secondary codes.

Input: one row per (entity, candidate code) with a score, plus the entity's
declared codes. All per-entity work is keyed by the entity, so after the
ranking window the aggregates reuse its partitioning (no extra exchange).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the scoring rules.
EXP_BASE = 0.9          # exp score: 1 - 0.9 ** (rank - 1)
P_WEIGHT = 1.0          # weight of the primary-code score in the total
S_WEIGHT = 0.5          # weight of the secondary-code score in the total
SCORE_DECIMALS = 2


def rank_within(df: DataFrame, entity: str, score: str, code: str, name: str = "rank") -> DataFrame:
    """1-based position by score (desc) within entity; ties go to the smaller code."""
    w = Window.partitionBy(entity).orderBy(F.col(score).desc(), F.col(code))
    return df.withColumn(name, F.row_number().over(w))


def top_k_per_entity(df: DataFrame, entity: str, score: str, code: str, k: int, name: str = "rank") -> DataFrame:
    """Keep the k best candidates per entity. ``row_number() <= k`` is planned
    as a partial + final WindowGroupLimit, so only k rows per entity and
    partition reach the shuffle."""
    return rank_within(df, entity, score, code, name).where(F.col(name) <= k)


def linear_score(rank: Column, code: Column, declared: Column, top_n: int) -> Column:
    """0 at rank 1, (rank-1)/top_n when matched later, 1 when not matched."""
    hit = (rank <= top_n) & (code == declared)
    return F.when(hit & (rank == 1), F.lit(0.0)).when(
        hit, F.round((rank - 1) / F.lit(float(top_n)), SCORE_DECIMALS)
    ).otherwise(F.lit(1.0))


def exp_score(rank: Column, code: Column, declared: Column, top_n: int) -> Column:
    """0 at rank 1, 1 - 0.9^(rank-1) when matched later, 1 when not matched."""
    hit = (rank <= top_n) & F.coalesce(code == declared, F.lit(False))
    return (
        F.when(hit & (rank == 1), F.lit(0.0))
        .when(hit, F.round(F.lit(1.0) - F.pow(F.lit(EXP_BASE), rank - 1), SCORE_DECIMALS))
        .otherwise(F.lit(1.0))
    )


def secondary_score(rank: Column, code: Column, declared: Column, top_n: int, rule=exp_score) -> Column:
    """Same rule for the secondary code; null when there is none."""
    return F.when(declared.isNull(), F.lit(None).cast("double")).otherwise(rule(rank, code, declared, top_n))


def total_score(s1: Column, s2: Column, p_weight: float = P_WEIGHT, s_weight: float = S_WEIGHT) -> Column:
    """(s1*p + coalesce(s2,0)*s) / (p + (s2 not null)*s), rounded to 2."""
    num = s1 * F.lit(p_weight) + F.coalesce(s2, F.lit(0.0)) * F.lit(s_weight)
    den = F.lit(p_weight) + F.when(s2.isNotNull(), F.lit(s_weight)).otherwise(F.lit(0.0))
    return F.round(num / den, SCORE_DECIMALS)


def match_flag(actual: Column, recommended: Column, prefix_len: int | None = None) -> Column:
    """1 if the codes are equal (optionally on their first prefix_len chars)."""
    if prefix_len:
        actual = F.substring(actual, 1, prefix_len)
        recommended = F.substring(recommended, 1, prefix_len)
    return F.coalesce((actual == recommended).cast("int"), F.lit(0))


def judge_entities(
    ranked: DataFrame,
    entity: str,
    code: str,
    rank: str,
    primary: str,
    secondary: str,
    top_n_predictions: int = 15,
    n: int = 3,
    rule=exp_score,
) -> DataFrame:
    """Per entity: min primary score, min secondary score, weighted total and
    the within-top-N flag. One aggregate keyed by entity."""
    r, c = F.col(rank), F.col(code)
    p, s = F.col(primary), F.col(secondary)
    in_top = (r <= n) & (F.coalesce(c == p, F.lit(False)) | F.coalesce(c == s, F.lit(False)))
    agg = ranked.groupBy(entity).agg(
        F.first(primary).alias(primary),
        F.first(secondary).alias(secondary),
        F.min(rule(r, c, p, top_n_predictions)).alias("score"),
        F.min(secondary_score(r, c, s, top_n_predictions, rule)).alias("score2"),
        F.max(in_top.cast("int")).alias("_in_top"),
    )
    return agg.select(
        entity,
        primary,
        secondary,
        "score",
        "score2",
        total_score(F.col("score"), F.col("score2")).alias("t_score"),
        F.when(F.col("_in_top") == 1, F.lit("Y")).otherwise(F.lit("N")).alias("within_top_n"),
    )


def top_n_share(flags: DataFrame, flag: str = "within_top_n") -> DataFrame:
    """% of entities flagged Y and N."""
    return flags.agg(
        F.round(F.count_if(F.col(flag) == "Y") * 100.0 / F.count(F.lit(1)), 2).alias("pct_in_top_n"),
        F.round(F.count_if(F.col(flag) == "N") * 100.0 / F.count(F.lit(1)), 2).alias("pct_not_in_top_n"),
    )


def score_histogram(scored: DataFrame, score: str = "t_score", flag: str = "within_top_n", bins: int = 20) -> DataFrame:
    """Counts per (bin, flag) over [0, 1]; bin 1..bins, a score of 1 falls in the last bin."""
    b = F.least(F.floor(F.col(score) * bins).cast("int") + 1, F.lit(bins))
    return scored.groupBy(b.alias("bin"), F.col(flag)).agg(F.count(F.lit(1)).alias("n"))


def worst_fraction(scored: DataFrame, frac: float, score: str, entity: str, largest: bool = True) -> DataFrame:
    """The int(n * frac) rows with the largest (or smallest) score, ties by entity.

    Uses a bounded top-k (TakeOrderedAndProject) when k is small; otherwise a
    range-partitioned sort and per-partition offsets, so no single task or the
    driver ever holds k rows. The scored table (one row per entity) is
    checkpointed first, so counting it does not rerun the work behind it.
    """
    from codelens.operators.ranking import top_rows

    scored = scored.checkpoint(eager=True)
    k = int(scored.count() * frac)
    order = [F.col(score).desc() if largest else F.col(score).asc(), F.col(entity).asc()]
    return top_rows(scored, k, order)

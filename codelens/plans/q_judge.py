"""Registered judge queries (flagship and its parts)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelens.operators import judge as J
from codelens.plans import judge as P
from codelens.plans.catalog import register
from codelens.plans.oracle import bucket_sql, cosine_sql, exp_score_sql, linear_score_sql, total_score_sql, with_views

# The ranked-candidate CTEs shared by every judge oracle.
_RANKED_CTES = (
    ("sp", f"SELECT *, {bucket_sql('vec_id')} AS b FROM vectors"),
    ("tr", "SELECT vec_id AS ref_id, CAST(embedding AS DOUBLE[]) AS e, primary_code AS code FROM sp WHERE b < 70"),
    ("te", "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, primary_code, secondary_code FROM sp WHERE b >= 70"),
    ("pairs", f"SELECT te.vec_id, tr.ref_id, tr.code, te.primary_code, te.secondary_code, "
              f"{cosine_sql('te.e', 'tr.e')} AS sim FROM te CROSS JOIN tr"),
    ("nb", "SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, ref_id) <= 50"),
    ("cand", "SELECT vec_id, code, max(sim) AS sim, any_value(primary_code) AS primary_code, "
             "any_value(secondary_code) AS secondary_code FROM nb GROUP BY vec_id, code"),
    ("ranked", "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, code) AS INTEGER) "
               "AS rank FROM cand) x WHERE rank <= 15"),
)


def _judged_sql(rule_sql) -> tuple[tuple[str, str], ...]:
    return _RANKED_CTES + (
        ("sc", f"SELECT vec_id, primary_code, secondary_code, "
               f"{rule_sql('rank', 'code', 'primary_code', 15)} AS s1, "
               f"CASE WHEN secondary_code IS NULL THEN NULL ELSE {rule_sql('rank', 'code', 'secondary_code', 15)} END AS s2, "
               f"CASE WHEN rank <= 3 AND (code = primary_code OR code = secondary_code) THEN 1 ELSE 0 END AS hit FROM ranked"),
        ("agg", "SELECT vec_id, any_value(primary_code) AS primary_code, any_value(secondary_code) AS secondary_code, "
                "min(s1) AS score, min(s2) AS score2, max(hit) AS h FROM sc GROUP BY vec_id"),
        ("judged", f"SELECT vec_id, primary_code, secondary_code, score, score2, {total_score_sql('score', 'score2')} AS t_score, "
                   f"CASE WHEN h = 1 THEN 'Y' ELSE 'N' END AS within_top_n FROM agg"),
    )


JUDGE_SQL = with_views(["vectors"], *_judged_sql(exp_score_sql), body="SELECT * FROM judged")


@register("judge_report", JUDGE_SQL)
def judge_report(spark, sf_dir):
    """Flagship: per-entity exp scores, weighted total and top-N flag."""
    return P.judge_report(spark, sf_dir)


@register("rank_within_company", with_views(["vectors"], *_RANKED_CTES, body=
    "SELECT vec_id, code, sim, rank FROM ranked"))
def rank_within_company(spark, sf_dir):
    return P.ranked_candidates(spark, sf_dir).select("vec_id", "code", "sim", "rank")


@register("predictions_as_list", with_views(["vectors"], *_RANKED_CTES, body=
    "SELECT vec_id, list(code ORDER BY rank) AS codes FROM ranked GROUP BY vec_id"))
def predictions_as_list(spark, sf_dir):
    r = P.ranked_candidates(spark, sf_dir)
    return r.groupBy("vec_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "code"))), lambda s: s["code"]).alias("codes")
    )


@register("within_top_n", with_views(["vectors"], *_RANKED_CTES, body="""
    SELECT vec_id, CASE WHEN max(CASE WHEN rank <= 3 AND (code = primary_code OR code = secondary_code)
                                   THEN 1 ELSE 0 END) = 1 THEN 'Y' ELSE 'N' END AS within_top_n
    FROM ranked GROUP BY vec_id"""))
def within_top_n(spark, sf_dir):
    return P.judge_report(spark, sf_dir).select("vec_id", "within_top_n")


@register("linear_score", with_views(["vectors"], *_judged_sql(linear_score_sql), body=
    "SELECT vec_id, score, score2, t_score FROM judged"))
def linear_score(spark, sf_dir):
    ranked = P.ranked_candidates(spark, sf_dir)
    return J.judge_entities(ranked, "vec_id", "code", "rank", "primary_code", "secondary_code",
                            top_n_predictions=15, n=3, rule=J.linear_score).select("vec_id", "score", "score2", "t_score")


@register("exp_score", with_views(["vectors"], *_RANKED_CTES, body=
    f"SELECT vec_id, code, rank, {exp_score_sql('rank', 'code', 'primary_code', 15)} AS score FROM ranked"))
def exp_score(spark, sf_dir):
    r = P.ranked_candidates(spark, sf_dir)
    return r.select("vec_id", "code", "rank", J.exp_score(F.col("rank"), F.col("code"), F.col("primary_code"), 15).alias("score"))


@register("secondary_score", with_views(["vectors"], *_RANKED_CTES, body=
    f"SELECT vec_id, code, rank, CASE WHEN secondary_code IS NULL THEN NULL ELSE "
    f"{exp_score_sql('rank', 'code', 'secondary_code', 15)} END AS score2 FROM ranked"))
def secondary_score(spark, sf_dir):
    r = P.ranked_candidates(spark, sf_dir)
    return r.select("vec_id", "code", "rank",
                    J.secondary_score(F.col("rank"), F.col("code"), F.col("secondary_code"), 15).alias("score2"))


@register("min_score", with_views(["vectors"], *_judged_sql(exp_score_sql), body=
    "SELECT vec_id, score, score2 FROM agg"))
def min_score(spark, sf_dir):
    return P.judge_report(spark, sf_dir).select("vec_id", "score", "score2")


@register("total_score", with_views(["vectors"], *_judged_sql(exp_score_sql), body=
    "SELECT vec_id, t_score FROM judged"))
def total_score(spark, sf_dir):
    return P.judge_report(spark, sf_dir).select("vec_id", "t_score")


@register("score_with_flag", with_views(["vectors"], *_judged_sql(exp_score_sql),
    ("flags", "SELECT vec_id, within_top_n FROM judged"),
    ("scores", "SELECT vec_id, score, score2, t_score FROM judged"),
    body="SELECT s.vec_id, s.score, s.score2, s.t_score, f.within_top_n FROM scores s LEFT JOIN flags f ON s.vec_id = f.vec_id"))
def score_with_flag(spark, sf_dir):
    """Scores and flags as two tables, joined; both come from one report (a row an entity, written once)."""
    j = P.judge_report(spark, sf_dir).checkpoint(eager=True)
    scores = j.select("vec_id", "score", "score2", "t_score")
    flags = j.select("vec_id", "within_top_n")
    return scores.join(flags, "vec_id", "left")


@register("failed_in_top_n", with_views(["vectors"], *_judged_sql(exp_score_sql), body=
    "SELECT * FROM judged WHERE within_top_n = 'N'"))
def failed_in_top_n(spark, sf_dir):
    return P.judge_report(spark, sf_dir).where(F.col("within_top_n") == "N")


@register("company_view", with_views(["vectors"], *_judged_sql(exp_score_sql), body=
    "SELECT * FROM judged WHERE primary_code = 7"))
def company_view(spark, sf_dir):
    """Rows of one declared code (the original looks at one company); the
    predicate is applied to the held-out entities before the search."""
    return P.judge_report(spark, sf_dir, entity_filter=F.col("primary_code") == 7)


@register("top_n_share", with_views(["vectors"], *_judged_sql(exp_score_sql), body="""
    SELECT round(count_if(within_top_n = 'Y') * 100.0 / count(*), 2) AS pct_in_top_n,
           round(count_if(within_top_n = 'N') * 100.0 / count(*), 2) AS pct_not_in_top_n FROM judged"""))
def top_n_share(spark, sf_dir):
    return J.top_n_share(P.judge_report(spark, sf_dir))


@register("score_histogram", with_views(["vectors"], *_judged_sql(exp_score_sql), body="""
    SELECT CAST(least(floor(t_score * 20) + 1, 20) AS INTEGER) AS bin, within_top_n, count(*) AS n
    FROM judged GROUP BY 1, 2"""))
def score_histogram(spark, sf_dir):
    return J.score_histogram(P.judge_report(spark, sf_dir))


@register("worst_half", with_views(["vectors"], *_judged_sql(exp_score_sql), body="""
    SELECT * FROM judged ORDER BY t_score DESC, vec_id
    LIMIT (SELECT CAST(floor(count(*) * 0.5) AS BIGINT) FROM judged)"""))
def worst_half(spark, sf_dir):
    """The int(n * 0.5) entities with the largest total score (a top-k report)."""
    return J.worst_fraction(P.judge_report(spark, sf_dir), 0.5, "t_score", "vec_id")

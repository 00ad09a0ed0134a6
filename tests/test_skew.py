"""One key holding a third of all rows: results stay whole and per-key work
is pre-aggregated before any shuffle."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelens.operators import ranking as R
from codelens.operators import reconcile as RC
from codelens.operators.neighbours import nearest_neighbours


def _skewed(spark, n=3000):
    # company "HOT" holds a third of the rows
    return spark.range(n).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("C"), F.col("id").cast("string"))).alias("company"),
        (F.col("id") % 5).cast("string").alias("text"),
    )


def test_reconcile_keeps_every_row_of_a_hot_key(spark):
    df = _skewed(spark)
    truth = spark.createDataFrame([("HOT.", "01111"), ("C1", "02222")], "company string, ssic_code string")
    out = RC.reconcile(df, truth)
    assert out.count() == df.count()
    assert out.where((F.col("company") == "HOT") & (F.col("ssic_code") == "01111")).count() == 1000


def test_a_hot_name_is_split_in_the_final_plan(spark):
    """Half of all rows have one name: the plan that ran deals them to several tasks."""
    wanted = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        rows = spark.range(0, 60_000, 1, 8).select(
            F.col("id").alias("doc_id"),
            F.when(F.col("id") % 2 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("C"), F.col("id").cast("string"))).alias("company"),
        )
        truth = spark.range(0, 60_000, 3, 4).select(F.concat(F.lit("C"), F.col("id").cast("string")).alias("company"), F.lpad(F.col("id").cast("string"), 5, "0").alias("ssic_code"))
        truth = truth.union(spark.createDataFrame([("HOT.", "01111")], "company string, ssic_code string"))
        out = RC.reconcile(rows, truth)
        assert out.where("company = 'HOT' and ssic_code = '01111'").count() == 30_000
        out.write.format("noop").mode("overwrite").save()
        joined = out.groupBy("ssic_code").count()
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_per_key_aggregates_are_partial(spark):
    df = _skewed(spark)
    plan = R.dedupe(df, ["company"], order="doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan
    top = R.top_k_within(df, ["company"], [F.col("doc_id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in top and "Partial" in top
    assert R.top_k_within(df, ["company"], [F.col("doc_id")], 3).where(F.col("company") == "HOT").count() == 3


def test_knn_with_a_hot_group(spark):
    rows = [(0 if i % 3 else 1, i, [float(i % 7), float(i % 5), 1.0]) for i in range(600)]
    df = spark.createDataFrame(rows, "trial int, id long, embedding array<double>")
    nb = nearest_neighbours(df, df.withColumnRenamed("id", "rid"), 3, "id", "rid", by=["trial"], block_rows=64)
    counts = {r["trial"]: r["n"] for r in nb.groupBy("trial").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {0: 400 * 3, 1: 200 * 3}


def test_texts_of_a_hot_company_are_gathered_by_many_tasks(spark):
    from codelens.operators import reconcile as RC

    rows = [("hot" if i % 2 else f"c{i % 40}", (i * 7919) % 2003, f"t{i}" if i % 11 else None) for i in range(2000)]
    df = spark.createDataFrame(rows, "company string, ord int, text string")
    placed = RC.in_order(df, ["company"], ["ord"]).withColumn("part", F.spark_partition_id())
    spread = placed.where("company = 'hot'").groupBy("part").count().collect()
    assert len(spread) >= 4 and max(r["count"] for r in spread) < 500
    got = {r["company"]: r["text"] for r in RC.concat_texts(df, ["company"], "text", ["ord"]).collect()}
    want = {}
    for company, _, text in sorted(rows, key=lambda r: (r[0], r[1])):
        if text is not None:
            want[company] = f"{want[company]} {text}" if company in want else text
    assert got == want
    plan = RC.concat_texts(df, ["company"], "text", ["ord"])._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and "partial_collect_list" in plan

"""Hot keys: one value holding a third of all rows must neither change results
nor reach a single task as raw rows (partial aggregation before the shuffle)."""

import math

from pyspark.sql import functions as F

from labeltide.operators import metrics, prepare


def _hot(spark, n=3000):
    return spark.range(n).select(
        F.col("id").alias("row_ord"),
        F.when(F.col("id") % 3 == 0, F.lit("hot text")).otherwise(
            F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"),
        F.when(F.col("id") % 3 == 0, F.lit("HOF")).otherwise(F.lit("NOT")).alias("label"))


def test_dedup_text_hot_key_exact_and_partial(spark):
    df = _hot(spark).repartition(8)
    out = prepare.dedup_text(df, "text", "row_ord")
    rows = {r.text: r.row_ord for r in out.collect()}
    assert rows["hot text"] == 0 and len(rows) == 2001
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan


def test_stratified_split_imbalanced(spark):
    df = _hot(spark)
    out = prepare.stratified_split(df, 0.1, "row_ord", by="label").collect()
    for lab in ("HOF", "NOT"):
        n = sum(1 for r in out if r.label == lab)
        k = sum(1 for r in out if r.label == lab and r.split == "dev")
        assert k == math.ceil(n * 0.1)


def test_confusion_and_best_epoch_hot(spark):
    df = _hot(spark).select(F.col("label"), F.lit("HOF").alias("prediction"))
    conf = {(r.label, r.prediction): r.n for r in metrics.confusion(df).collect()}
    assert conf == {("HOF", "HOF"): 1000, ("NOT", "HOF"): 2000}
    hist = spark.range(3000).select(
        F.when(F.col("id") < 1000, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("run"),
        F.col("id").alias("epoch"), (F.lit(5000) - F.col("id")).cast("double").alias("val_loss"))
    best = {r.run: r.best_epoch for r in metrics.best_epoch(hist).collect()}
    assert best["hot"] == 999 and len(best) == 2001

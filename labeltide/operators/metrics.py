"""Classification metrics from one distributed aggregate.

The only pass over the data is ``groupBy(truth, prediction).count()``, a
partial aggregate with at most k*k groups.  Every metric after it works on
that k*k table, so the cost is one map-side-combined shuffle of k*k rows per
task regardless of the number of scored rows or of class imbalance.

Class order follows scikit-learn: the sorted union of truths and predictions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labels import repair_ids, repair_predictions


# --------------------------------------------------------------------- A1
def confusion(df: DataFrame, truth: str = "label", pred: str = "prediction",
              repair: bool = False, fallback: str = "0", n_classes: int | None = None) -> DataFrame:
    """Long-form confusion matrix ``(label, prediction, n)``; zero cells absent.

    Rows without a truth are no evidence and are left out (``unlabelled`` counts
    them).  ``repair`` mends predictions: one-character labels by default, ids
    below ``n_classes`` where that is given.
    """
    p = F.col(pred)
    if repair:
        p = repair_predictions(pred, fallback) if n_classes is None else repair_ids(pred, n_classes, fallback)
    return (df.where(F.col(truth).isNotNull()).select(F.col(truth).cast("string").alias("label"),
                      p.cast("string").alias("prediction"))
            .groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n")))


def unlabelled(df: DataFrame, truth: str = "label") -> DataFrame:
    """How many rows ``confusion`` leaves out for want of a truth."""
    return df.agg(F.count_if(F.col(truth).isNull()).cast("long").alias("unlabelled"))


def confusion_wide(conf: DataFrame, classes: Sequence[str]) -> DataFrame:
    """A1 wide form: one row per truth, one column per class of ``classes``, zeros included."""
    cells = [F.coalesce(F.sum(F.when(F.col("prediction") == c, F.col("n"))), F.lit(0)).cast("long").alias(c) for c in classes]
    return conf.groupBy("label").agg(*cells).orderBy("label")


# --------------------------------------------------------------------- A2
def confusion_restricted(conf: DataFrame, labels: Sequence[str]) -> DataFrame:
    """A2: the k*k grid over ``labels`` (given order), zeros included.

    The grid is a literal of k*k rows; the join is between two tables of at
    most k*k rows.
    """
    cells = [F.struct(F.lit(i).alias("row"), F.lit(j).alias("col"),
                      F.lit(t).alias("label"), F.lit(p).alias("prediction"))
             for i, t in enumerate(labels) for j, p in enumerate(labels)]
    spark = conf.sparkSession
    grid = spark.range(1).select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    return (grid.join(conf, ["label", "prediction"], "left")
            .select("row", "col", "label", "prediction",
                    F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")))


# --------------------------------------------------------------------- A3
def binary_cells(conf: DataFrame, negative: str, positive: str) -> DataFrame:
    """A3: tn, fp, fn, tp for a two-label list ``[negative, positive]``."""
    def cell(t, p):
        return F.sum(F.when((F.col("label") == t) & (F.col("prediction") == p), F.col("n"))
                     .otherwise(0)).cast("long")
    return conf.agg(cell(negative, negative).alias("tn"), cell(negative, positive).alias("fp"),
                    cell(positive, negative).alias("fn"), cell(positive, positive).alias("tp"))


# --------------------------------------------------------------------- A4
def class_stats(conf: DataFrame) -> DataFrame:
    """Per class: support (true), predicted, tp and F1 = 2tp/(support+predicted)."""
    n = F.col("n")
    both = F.explode(F.array(
        F.struct(F.col("label").alias("class"), n.alias("support"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("label") == F.col("prediction"), n).otherwise(0).cast("long").alias("tp")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("support"),
                 n.alias("predicted"), F.lit(0).cast("long").alias("tp")),
    ))
    stats = (conf.select(both.alias("e")).select("e.*").groupBy("class")
             .agg(F.sum("support").cast("long").alias("support"),
                  F.sum("predicted").cast("long").alias("predicted"),
                  F.sum("tp").cast("long").alias("tp")))
    denom = F.col("support") + F.col("predicted")
    return stats.withColumn(
        "f1", F.when(denom > 0, 2.0 * F.col("tp") / denom).otherwise(F.lit(0.0)))


def f1_per_class(conf: DataFrame) -> DataFrame:
    """A4 as a table ``(class, f1, support)`` in class order."""
    return class_stats(conf).select("class", "f1", "support").orderBy("class")


# --------------------------------------------------------------------- A5-A9, A12
def summary(conf: DataFrame) -> DataFrame:
    """One row: weighted/macro/micro F1, accuracy, MCC, classes, per-class F1."""
    st = class_stats(conf)
    total = F.sum("support")
    s = F.sum("support").cast("double")
    c = F.sum("tp").cast("double")
    sum_pt = F.sum(F.col("predicted").cast("double") * F.col("support"))
    sum_p2 = F.sum(F.col("predicted").cast("double") * F.col("predicted"))
    sum_t2 = F.sum(F.col("support").cast("double") * F.col("support"))
    mcc_den = F.sqrt((s * s - sum_p2) * (s * s - sum_t2))
    per = F.array_sort(F.collect_list(F.struct("class", "f1")))
    return st.agg(
        (F.sum(F.col("f1") * F.col("support")) / total).alias("f1_weighted"),
        F.avg("f1").alias("f1_macro"),
        (c / s).alias("f1_micro"),
        (c / s).alias("accuracy"),
        F.when(mcc_den > 0, (c * s - sum_pt) / mcc_den).otherwise(F.lit(0.0)).alias("mcc"),
        total.cast("long").alias("n"),
        F.count(F.lit(1)).cast("long").alias("n_classes"),
        F.transform(per, lambda x: x["class"]).alias("classes"),
        F.transform(per, lambda x: x["f1"]).alias("f1_per_class"),
    )


def classification_report(df: DataFrame, truth: str = "label", pred: str = "prediction",
                          repair: bool = True, fallback: str = "0", n_classes: int | None = None) -> DataFrame:
    """The printed report as one row, from a single aggregate over ``df``."""
    return summary(confusion(df, truth, pred, repair, fallback, n_classes))


def accuracy(df: DataFrame, truth: str = "label", pred: str = "prediction") -> DataFrame:
    """A8 directly on rows (a fraction): of the rows with a true label, those whose prediction is that; a NULL prediction is wrong."""
    right = F.when(F.col(truth).isNotNull(), F.coalesce(F.col(truth) == F.col(pred), F.lit(False)))
    return df.agg(F.avg(right.cast("double")).alias("accuracy"))


# --------------------------------------------------------------------- A10
def cross_entropy(logits: str, label: str):
    """Per-row -log softmax(logits)[label], with a stable log-sum-exp."""
    v = F.col(logits).cast("array<double>")
    m = F.array_max(v)
    lse = m + F.log(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.exp(x - m)))
    return lse - F.element_at(v, F.col(label).cast("int") + 1)


def mean_loss(df: DataFrame, logits: str, label: str, batch: str) -> DataFrame:
    """A10: mean over batches of the batch-mean cross-entropy (as training loops report)."""
    per_batch = (df.select(F.col(batch), cross_entropy(logits, label).alias("__ce"))
                 .groupBy(batch).agg(F.avg("__ce").alias("__b")))
    return per_batch.agg(F.avg("__b").alias("mean_loss"),
                         F.count(F.lit(1)).cast("long").alias("batches"))


# --------------------------------------------------------------------- A11
def best_epoch(history: DataFrame, run: str = "run", epoch: str = "epoch",
               loss: str = "val_loss") -> DataFrame:
    """Per run, the epoch with the lowest loss (earliest on ties)."""
    best = F.min(F.struct(F.col(loss).alias("l"), F.col(epoch).alias("e")))
    return (history.where(F.col(loss).isNotNull()).groupBy(run).agg(best.alias("__b"))
            .select(run, F.col("__b.e").alias("best_epoch"), F.col("__b.l").alias("best_loss")))


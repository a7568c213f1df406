"""Sinks (K1-K4).  All writes are distributed; nothing is gathered to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _csv(w):
    # Quotes doubled, fields written exactly (the CSV writer trims by default).
    return (w.option("header", True).option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))


def write_splits(train: DataFrame, dev: DataFrame, path: str, fmt: str = "parquet",
                 mode: str = "overwrite") -> None:
    """K1: train and dev side by side under ``path/split=...``."""
    both = (train.withColumn("split", F.lit("train"))
            .unionByName(dev.withColumn("split", F.lit("dev")), allowMissingColumns=True))
    w = both.write.mode(mode).partitionBy("split")
    if fmt == "csv":
        _csv(w).csv(path)
    else:
        w.format(fmt).save(path)


def write_predictions(scored: DataFrame, path: str, task_col: str = "task",
                      fmt: str = "csv", mode: str = "overwrite") -> None:
    """K2: input columns + prediction, one folder per task (the file-name suffix)."""
    w = scored.write.mode(mode).partitionBy(task_col)
    if fmt == "csv":
        _csv(w).csv(path)
    else:
        w.format(fmt).save(path)


def append_metrics(history: DataFrame, path: str, fmt: str = "parquet", keys: tuple[str, ...] = ("run", "epoch")) -> None:
    """K3: append to the metric history ``(run, epoch, train_loss, val_loss, f1_*)``.

    An append is a folder named by a digest of its keys, so a repeated run replaces its own
    rows instead of adding them twice; other appends stay as they are.
    """
    row = history.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*keys).cast("decimal(38,0)")).alias("h")).first()
    history.write.mode("overwrite").format(fmt).save(f"{path}/append={row['n']}-{int(row['h'] or 0) % (1 << 64):016x}")


def write_prediction_lines(scored: DataFrame, path: str, order_col: str = "row_ord",
                           pred_col: str = "prediction") -> None:
    """K4: one prediction per line, in row order within each sorted part file.

    ``orderBy`` range-partitions the rows, so part files concatenated in name
    order give the global order without a single-task write.
    """
    (scored.select(order_col, pred_col).orderBy(order_col)
     .select(F.coalesce(F.col(pred_col).cast("string"), F.lit("")).alias("value"))
     .write.mode("overwrite").text(path))

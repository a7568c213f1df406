"""Input layout helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def spread_one_split(df: DataFrame, factor: int = 2) -> DataFrame:
    """Round-robin the rows of an input no larger than one file split over the cores.

    Such an input (one file of one row group) is scanned by a single task, and
    the regex work above the scan would run on one core.  The bound is bytes,
    ``spark.sql.files.maxPartitionBytes``, so the shuffle never moves more than
    one task's input whatever the size of the cluster.
    """
    spark = df.sparkSession
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes").lower())
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores * factor) if size <= split and df.rdd.getNumPartitions() < cores else df


def keep_where(df: DataFrame, cond: Column) -> DataFrame:
    """Keep rows where ``cond`` holds, evaluated once, where it stands.

    A ``Filter`` on a column computed by an expensive projection (cleaned
    text, token arrays) is pushed below that projection by the optimizer,
    which then evaluates the expression twice, possibly below an exchange
    meant to spread the work.  Emitting each row as a 0- or 1-element array
    and exploding it keeps the test in the projection's output, where the
    optimizer does not move it.
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    kept = F.filter(F.array(row), lambda _: F.coalesce(cond, F.lit(False)))
    return df.select(F.explode(kept).alias("__row")).select("__row.*")

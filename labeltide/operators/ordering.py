"""Order-dependent helpers that never put all rows into one task.

A global ``Window.orderBy`` without ``partitionBy`` moves every row to a single
partition.  Here rows get the number of their range of the order instead.  The
ranges' bounds come from a mergeable quantile sketch of the order column
(``approxQuantile``), so they are balanced whatever the spacing of the values (ids
may be sparse), and they are constants of the plan: computing it twice gives the
same ranges, and nothing needs to be stored.  Windows run inside ranges, over one
exchange; one row per range goes through the global step (prefix sums, carries).

Orders that are no numbers (text, structs) have no sketch; ``in_ranges``
range-partitions those and stores the result, since its bounds come from a sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored

RANGE, PLACE = "__range", "__place"


def in_ranges(df: DataFrame, order_col: str, ranges: int | None = None) -> DataFrame:
    """``df`` with its range number and the position (from 0) inside the range, by ``order_col``."""
    parted = df.repartitionByRange(ranges, order_col) if ranges else df.repartitionByRange(order_col)
    serial = F.monotonically_increasing_id()  # partition number, then position, in 33 bits
    return stored(parted.sortWithinPartitions(order_col)
                  .withColumn(RANGE, F.shiftright(serial, 33).cast("int"))
                  .withColumn(PLACE, serial.bitwiseAND((1 << 33) - 1)), "ranges")


def earlier_ranges() -> Window:
    """Window over a table of one row per range: all ranges before this one."""
    return Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)


def is_numeric(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, T.NumericType)


def range_bounds(df: DataFrame, order_col: str, ranges: int | None = None) -> list[float]:
    """Ascending lower bounds of the ranges after the first: quantiles of the numeric ``order_col``.

    One job over that column.  There are as many ranges as shuffle partitions, each within
    a quarter of its share of rows; the bounds are all that reaches the driver.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if ranges < 2:
        return []
    found = df.select(F.col(order_col).cast("double").alias("__o")).approxQuantile("__o", [k / ranges for k in range(1, ranges)], 0.25 / ranges)
    return sorted(set(found))


def range_number(order: Column, bounds: list[float]) -> Column:
    """How many of ``bounds`` are at or below the value, by binary search; a null value comes first."""
    value = order.cast("double")

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value < bounds[middle], between(low, middle)).otherwise(between(middle + 1, high))

    return F.when(order.isNull(), F.lit(0)).otherwise(between(0, len(bounds))) if bounds else F.lit(0)


def dense_row_number(df: DataFrame, order_col: str, out_col: str = "row_number",
                     ranges: int | None = None) -> DataFrame:
    """Add ``out_col`` = 1-based position of each row in ``order_col`` order (a unique column)."""
    if is_numeric(df, order_col):
        ranged = df.withColumn(RANGE, range_number(F.col(order_col), range_bounds(df, order_col, ranges)))
        place = F.row_number().over(Window.partitionBy(RANGE).orderBy(order_col)) - 1
    else:
        ranged, place = in_ranges(df, order_col, ranges), F.col(PLACE)
    sizes = ranged.groupBy(RANGE).agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select(F.col(RANGE).alias("__of"), F.coalesce(F.sum("__n").over(earlier_ranges()), F.lit(0)).alias("__offset"))
    # One row per range: bounded by the number of shuffle partitions.
    return (ranged.withColumn(PLACE, place).join(F.broadcast(offsets), F.col(RANGE) == F.col("__of"))
            .withColumn(out_col, (F.col("__offset") + F.col(PLACE) + 1).cast("long"))
            .drop(RANGE, PLACE, "__offset", "__of"))


def hash_key(cols: list[str] | str, salt: str | None = None) -> Column:
    """Hex MD5 of the key columns (same value in Spark and in DuckDB's md5)."""
    if isinstance(cols, str):
        cols = [cols]
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]
    if salt is not None:
        parts.append(F.lit(str(salt)))
    return F.md5(F.concat_ws(":", *parts))

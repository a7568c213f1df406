"""Label dictionaries, label encoding/decoding and prediction repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .ordering import dense_row_number

# --------------------------------------------------------------------- L1
def label_dictionary(train: DataFrame, col: str, order_col: str,
                     label_out: str = "label", id_out: str = "label_id") -> DataFrame:
    """Ids 0, 1, ... by order of first appearance of each label in ``train``.

    This is not ``StringIndexer`` (which orders by frequency or alphabet).  The
    distinct labels are numbered in ranges of their first appearance, so even a
    very wide column never lands in one task.
    """
    firsts = (train.where(F.col(col).isNotNull()).groupBy(col).agg(F.min(order_col).alias("__first")))
    numbered = dense_row_number(firsts, "__first", "__rn")
    return numbered.select(F.col(col).cast("string").alias(label_out),
                           (F.col("__rn") - 1).cast("int").alias(id_out))


# --------------------------------------------------------------------- L2
def encode_labels(df: DataFrame, dictionary: DataFrame, col: str,
                  out_col: str | None = None, as_string: bool = True) -> DataFrame:
    """Replace labels by their ids.

    ``as_string=True`` mirrors ``replace(dict)`` + ``str``: unknown labels pass
    through unchanged.  With ``as_string=False`` the id is INT and unknown
    labels become NULL.
    """
    out_col = out_col or col
    d = stored(dictionary.select(F.col("label").alias("__dict_label"),
                                             F.col("label_id").alias("__dict_id")), "dictionary")
    joined = df.join(d, F.col(col).cast("string") == F.col("__dict_label"), "left")
    if as_string:
        value = F.coalesce(F.col("__dict_id").cast("string"), F.col(col).cast("string"))
    else:
        value = F.col("__dict_id").cast("int")
    return joined.withColumn(out_col, value).drop("__dict_label", "__dict_id")


# --------------------------------------------------------------------- L3
def decode_labels(df: DataFrame, dictionary: DataFrame, pred_col: str,
                  out_col: str = "prediction", default: str = "") -> DataFrame:
    """Map predicted ids ('0', '1', ... or ints) back to label names.

    Unknown or NULL ids give ``default`` (``''`` as in the reference).
    """
    d = stored(dictionary.select(F.col("label").alias("__dict_label"),
                                             F.col("label_id").cast("string").alias("__dict_id")), "dictionary")
    joined = df.join(d, F.col(pred_col).cast("string") == F.col("__dict_id"), "left")
    return (joined.withColumn(out_col, F.coalesce(F.col("__dict_label"), F.lit(default)))
            .drop("__dict_label", "__dict_id"))


# --------------------------------------------------------------------- L4
def argmax(values: Column | str) -> Column:
    """Index (0-based) of the largest element, first one on ties; like numpy a NaN wins."""
    v = F.col(values) if isinstance(values, str) else values
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


# --------------------------------------------------------------------- L5-L7
def needs_repair(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | (F.length(c) != 1)


def repair_predictions(c: Column | str, fallback: str | Column = "0") -> Column:
    """Empty, NULL or multi-character predictions become ``fallback``."""
    col = F.col(c) if isinstance(c, str) else c
    fb = fallback if isinstance(fallback, Column) else F.lit(fallback)
    return F.when(needs_repair(col), fb).otherwise(col)


def repair_ids(c: Column | str, n_classes: int, fallback: str | Column = "0") -> Column:
    """Ids that a scorer gave: whatever is not '0' to ``n_classes`` - 1 becomes ``fallback``.

    ``repair_predictions`` is for generated text, where a label is one character;
    with ten or more classes an id has more.
    """
    col = (F.col(c) if isinstance(c, str) else c).cast("string")
    fb = fallback if isinstance(fallback, Column) else F.lit(fallback)
    known = col.rlike("^(0|[1-9][0-9]*)$") & (col.try_cast("int") < n_classes)
    return F.when(F.coalesce(known, F.lit(False)), col).otherwise(fb)


def count_repairs(df: DataFrame, col: str, out_col: str = "repaired") -> DataFrame:
    """How many predictions the repair rule would change (one aggregate)."""
    return df.agg(F.count_if(needs_repair(col)).cast("long").alias(out_col))


def majority_label(train: DataFrame, col: str) -> DataFrame:
    """The most frequent non-NULL label (ties: smallest) as a one-row frame."""
    return (train.where(F.col(col).isNotNull()).groupBy(col)
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col(col).asc()).limit(1)
            .select(F.col(col).cast("string").alias("majority"), "count"))


def majority_fallback(train: DataFrame, col: str) -> str | None:
    """The L7 label as a scalar for use as L5's fallback."""
    row = majority_label(train, col).first()
    return None if row is None else row["majority"]

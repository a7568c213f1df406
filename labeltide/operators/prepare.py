"""Relational and dataflow operators.

All of them are DataFrame plans; none collects data rows.  The only values
that reach the driver are scalars (a row count, a split boundary).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .ordering import PLACE, RANGE, dense_row_number, earlier_ranges, hash_key, in_ranges, is_numeric, range_bounds, range_number


# --------------------------------------------------------------------- D1
def forward_fill(df: DataFrame, cols: Sequence[str], order_col: str,
                 ranges: int | None = None) -> DataFrame:
    """Replace NULLs in ``cols`` by the last non-NULL value earlier in ``order_col`` (unique).

    Rows are filled inside ranges of the order.  Each range also gives the last
    non-NULL value of each column (``max`` of a struct led by the order); over one
    row per range, the values carried in from earlier ranges follow.
    """
    cols = list(cols)
    if not cols:
        return df
    if is_numeric(df, order_col):
        order = F.col(order_col)
        ranged = df.withColumn(RANGE, range_number(order, range_bounds(df, order_col, ranges)))
    else:
        order, ranged = F.col(PLACE), in_ranges(df, order_col, ranges)
    last = ranged.groupBy(RANGE).agg(*[
        F.max(F.when(F.col(c).isNotNull(), F.struct(order.alias("o"), F.col(c).alias("v"))))
        .alias(f"__last_{i}") for i, c in enumerate(cols)])
    carries = last.select(F.col(RANGE).alias("__of"), *[
        F.last(F.col(f"__last_{i}.v"), ignorenulls=True).over(earlier_ranges()).alias(f"__carry_{i}")
        for i in range(len(cols))])
    inside = Window.partitionBy(RANGE).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = ranged.select(*[
        F.last(F.col(c), ignorenulls=True).over(inside).alias(c) if c in cols else F.col(c)
        for c in df.columns], RANGE)
    # One row per range: bounded by the number of shuffle partitions.
    out = filled.join(F.broadcast(carries), F.col(RANGE) == F.col("__of"), "left")
    return out.select(*[
        F.coalesce(F.col(c), F.col(f"__carry_{cols.index(c)}")).alias(c) if c in cols
        else F.col(c) for c in df.columns])


# --------------------------------------------------------------------- D2
def dedup_rows(df: DataFrame, order_col: str | None = None, along: Sequence[str] = ()) -> DataFrame:
    """Full-row de-duplication keeping the first occurrence.

    The order column itself is not part of the row identity; the kept row gets
    the smallest order value.  ``along`` are columns that never fall as the order
    grows (the place of a file): no part of the identity either, and their smallest
    value is the kept row's.  A single aggregate with map-side combine, so a
    row repeated a billion times costs one entry per map task; numbers as orders keep
    it a hash aggregate, without a sort of whole rows.
    """
    if order_col is None:
        return df.dropDuplicates()
    smallest = [order_col, *along]
    keys = [c for c in df.columns if c not in smallest]
    return (df.groupBy(*keys).agg(*[F.min(c).alias(c) for c in smallest])
            .select(*df.columns))


# --------------------------------------------------------------------- D3
def dedup_text(df: DataFrame, col: str, order_col: str) -> DataFrame:
    """Keep, per distinct value of ``col``, the row with the smallest order (unique).

    Texts are compared by their SHA-256, so the exchange carries 32 bytes and an
    order per row, never the text, and a hot text costs one entry per map task
    (a hash aggregate of ``min(order)``).  The other columns come back by a
    join on the order with the few columns of the rows that stay.
    """
    return df.join(first_orders(df, col, order_col), order_col, "left_semi")


def first_orders(df: DataFrame, col: str, order_col: str) -> DataFrame:
    """Only the orders of the rows that ``dedup_text`` keeps; nothing else is read or moved."""
    digest = F.unhex(F.sha2(F.col(col), 256)).alias("__digest")
    return df.select(digest, order_col).groupBy("__digest").agg(F.min(order_col).alias(order_col)).select(order_col)


# --------------------------------------------------------------------- D4
def drop_null_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a NULL in any column (or in ``subset``)."""
    return df.na.drop(how="any", subset=list(subset) if subset else None)


# --------------------------------------------------------------------- D5 / G4
def union_datasets(frames: Sequence[DataFrame], sources: Sequence[str] | None = None,
                   source_col: str = "source", rank_col: str | None = "source_rank"
                   ) -> DataFrame:
    """Union by column name; columns missing on one side become NULL.

    ``sources`` tags each input; ``rank_col`` keeps the input position so a
    combined order ``(source_rank, row_ord)`` is available downstream.
    """
    if not frames:
        raise ValueError("union_datasets needs at least one DataFrame")
    tagged = []
    for i, f in enumerate(frames):
        if sources is not None:
            f = f.withColumn(source_col, F.lit(sources[i]))
        if rank_col:
            f = f.withColumn(rank_col, F.lit(i))
        tagged.append(f)
    out = tagged[0]
    for f in tagged[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


# --------------------------------------------------------------------- D6 / D7
def project(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols)


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename the columns present; absent names are ignored like pandas does."""
    present = {k: v for k, v in mapping.items() if k in df.columns}
    return df.withColumnsRenamed(present) if present else df


# --------------------------------------------------------------------- D8 / D9
#: Hex digits of the hash whose histogram finds a group's boundary: 65,536 buckets.
_PREFIX = 4


def stratified_split(df: DataFrame, frac: float, key_cols: Sequence[str] | str,
                     by: str | None = None, out_col: str = "split",
                     salt: str | None = None, held: str = "dev",
                     kept: str = "train") -> DataFrame:
    """Mark exactly ``ceil(n_g * frac)`` rows per group ``by`` as held out.

    The held-out rows of a group are those with the smallest MD5 of the key
    columns, then the smallest key; of rows that share the key of the cut, those
    with the smallest hash of the whole row, and of equal rows as many as it takes.
    So the split is reproducible and independent of partitioning; a NULL group is
    a group.

    No window runs over a whole group, and no copy of the data is stored.  A
    histogram of hash prefixes finds each group's boundary prefix; the keys below
    that prefix, counted first, give the group's cut (one row).  Only where the
    cut's key repeats are its rows stored and numbered.
    """
    if not 0 <= frac <= 1:
        raise ValueError("frac must be within [0, 1]")
    key_cols = [key_cols] if isinstance(key_cols, str) else list(key_cols)
    keys = [f"__key_{i}" for i in range(len(key_cols))]
    keyed = df.select("*", (F.col(by) if by is not None else F.lit(0)).alias("__g"), hash_key(key_cols, salt).alias("__h"),
                      *[F.col(c).alias(k) for c, k in zip(key_cols, keys)])
    slim = keyed.select("__g", F.substring("__h", 1, _PREFIX).alias("__p"), "__h", *keys)

    hist = slim.groupBy("__g", "__p").agg(F.count(F.lit(1)).alias("__n"))
    group = Window.partitionBy("__g")
    upto = F.sum("__n").over(group.orderBy("__p").rowsBetween(Window.unboundedPreceding, 0))
    bounds = (hist.withColumn("__k", F.ceil(F.sum("__n").over(group) * F.lit(float(frac)))).withColumn("__cum", upto)
              .where((F.col("__cum") >= F.col("__k")) & (F.col("__cum") - F.col("__n") < F.col("__k")))
              .select(F.col("__g").alias("__bg"), F.col("__p").alias("__bp"), (F.col("__k") - (F.col("__cum") - F.col("__n"))).alias("__rem")))
    # The distinct keys of the boundary prefixes with their numbers of rows: a key that repeats is one row here.
    edge = slim.join(bounds, F.col("__g").eqNullSafe(F.col("__bg")) & (F.col("__p") == F.col("__bp")))
    edge = edge.groupBy("__g", "__rem", "__h", *keys).agg(F.count(F.lit(1)).alias("__tied"))
    before = F.coalesce(F.sum("__tied").over(group.orderBy("__h", *keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = (edge.withColumn("__before", before).where((F.col("__before") < F.col("__rem")) & (F.col("__before") + F.col("__tied") >= F.col("__rem")))
            .select(F.col("__g").alias("__bg"), F.struct("__h", *keys).alias("__cut"), (F.col("__rem") - F.col("__before")).alias("__need"), "__tied"))
    cuts = stored(cuts, "split-cuts")
    own = F.struct("__h", *keys)
    marked = keyed.join(cuts, F.col("__g").eqNullSafe(F.col("__bg")), "left")
    whole = marked.withColumn(out_col, F.when(own <= F.col("__cut"), F.lit(held)).otherwise(F.lit(kept))).select(*df.columns, out_col)
    if cuts.where("__need < __tied").isEmpty():
        return whole
    at_cut = F.coalesce((own == F.col("__cut")) & (F.col("__need") < F.col("__tied")), F.lit(False))
    ties = marked.where(at_cut).select(*df.columns, "__g", "__need", F.struct(F.col("__g"), F.xxhash64(*df.columns).alias("r"), F.monotonically_increasing_id().alias("m")).alias("__o"))
    ties = stored(dense_row_number(ties, "__o", "__rn"), "split-ties")
    firsts = ties.groupBy(F.col("__g").alias("__of")).agg(F.min("__rn").alias("__first"))
    ties = ties.join(firsts, F.col("__g").eqNullSafe(F.col("__of")))
    side = F.when(F.col("__rn") - F.col("__first") < F.col("__need"), F.lit(held)).otherwise(F.lit(kept))
    return (marked.where(~at_cut).withColumn(out_col, F.when(own <= F.col("__cut"), F.lit(held)).otherwise(F.lit(kept))).select(*df.columns, out_col)
            .unionByName(ties.withColumn(out_col, side).select(*df.columns, out_col)))


def holdout_split(df: DataFrame, frac: float, key_cols: Sequence[str] | str,
                  out_col: str = "split", salt: str | None = None) -> DataFrame:
    """Exactly ``ceil(n * frac)`` rows held out, chosen by key hash."""
    return stratified_split(df, frac, key_cols, None, out_col, salt)


def split_frames(marked: DataFrame, out_col: str = "split",
                 held: str = "dev", kept: str = "train") -> tuple[DataFrame, DataFrame]:
    """Turn a marked frame into (kept, held) DataFrames."""
    rest = [c for c in marked.columns if c != out_col]
    return (marked.where(F.col(out_col) == kept).select(*rest),
            marked.where(F.col(out_col) == held).select(*rest))


# --------------------------------------------------------------------- D10-D15
def value_counts(df: DataFrame, col: str, count_col: str = "count") -> DataFrame:
    """Counts per value, NULL excluded, most frequent first (ties by value)."""
    return (df.where(F.col(col).isNotNull()).groupBy(col)
            .agg(F.count(F.lit(1)).alias(count_col))
            .orderBy(F.col(count_col).desc(), F.col(col).asc()))


def row_count(df: DataFrame) -> int:
    """The number of rows (one job)."""
    return df.count()


def preview(df: DataFrame, order: Sequence[str] | str, n: int = 5) -> DataFrame:
    """First ``n`` rows by an explicit order (top-k, not a full sort)."""
    order = [order] if isinstance(order, str) else list(order)
    return df.orderBy(*order).limit(n)


def distinct_labels(df: DataFrame, col: str, order_col: str, dropna: bool = True,
                    first_col: str = "first_ord") -> DataFrame:
    """Distinct values with their first appearance, in appearance order."""
    src = df.where(F.col(col).isNotNull()) if dropna else df
    return (src.groupBy(col).agg(F.min(order_col).alias(first_col))
            .orderBy(first_col))


def with_default_column(df: DataFrame, name: str, value="") -> DataFrame:
    """Add a constant column only when it is absent."""
    if name in df.columns:
        return df
    return df.withColumn(name, F.lit(value))


def filter_update(df: DataFrame, cond: Column, col: str, value) -> DataFrame:
    """``df.loc[cond, col] = value`` as one projection."""
    v = value if isinstance(value, Column) else F.lit(value)
    return df.withColumn(col, F.when(cond, v).otherwise(F.col(col)))


# --------------------------------------------------------------------- D16-D18
def duplicate_keys(df: DataFrame, key: Sequence[str] | str) -> DataFrame:
    key = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def align_by_id(pred: DataFrame, gold: DataFrame, key: Sequence[str] | str,
                check_unique: bool = True) -> DataFrame:
    """Pair predictions with gold rows by id (never by position)."""
    key = [key] if isinstance(key, str) else list(key)
    if check_unique and duplicate_keys(gold, key).limit(1).count() > 0:
        raise ValueError(f"gold has duplicate keys on {key}")
    return pred.join(gold, key, "inner")


def unmatched(pred: DataFrame, gold: DataFrame, key: Sequence[str] | str,
              side_col: str = "side") -> DataFrame:
    """Keys present on one side only, tagged 'prediction' or 'gold'."""
    key = [key] if isinstance(key, str) else list(key)
    p = pred.select(*key).join(gold.select(*key), key, "left_anti")
    g = gold.select(*key).join(pred.select(*key), key, "left_anti")
    return (p.withColumn(side_col, F.lit("prediction"))
            .unionByName(g.withColumn(side_col, F.lit("gold"))))


def shuffle_key(key_cols: Sequence[str] | str, seed: int | str) -> Column:
    """A seeded pseudo-random sort key (hex MD5 of key and seed)."""
    return hash_key(key_cols, str(seed))


def shuffle(df: DataFrame, key_cols: Sequence[str] | str, seed: int | str,
            key_out: str = "shuffle_key") -> DataFrame:
    """Rows in a reproducible random order (a range-partitioned sort)."""
    return df.withColumn(key_out, shuffle_key(key_cols, seed)).orderBy(key_out)

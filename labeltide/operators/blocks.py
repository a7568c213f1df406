"""Block dictionaries: values for the entries of a list column, without a row per entry in any exchange.

Rows are stored in blocks of consecutive rows (encoded texts in the blocks that encoded them).  A block's distinct entries (found before
the exchange) are joined with the lookup table and come back to the block as its own
dictionary; the entries are then replaced in place, a whole block at a time.  Neither
side has to fit anywhere as a whole, and a frequent entry is one row per block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored

BLOCK = "__block"
_BITS = 9  # 512 rows to a block


def blocked(df: DataFrame, name: str = "blocks") -> DataFrame:
    """``df`` stored, with the number of each row's block: the one that it brings (``encode_tokens``), or a new one."""
    if BLOCK in df.columns:
        return stored(df, name)
    return stored(df.withColumn(BLOCK, F.shiftright(F.monotonically_increasing_id(), _BITS)), name)


def replace_entries(rows: DataFrame, list_col: str, table: DataFrame, key_col: str,
                    make: Callable[["pyarrow.ListArray", "pyarrow.Table"], "pyarrow.Array"], out: T.StructField) -> DataFrame:
    """``rows`` (from :func:`blocked`) with ``list_col`` and the block number replaced by the column ``out``.

    ``make`` gets a block's lists (none is null) and the rows of ``table`` whose
    ``key_col`` occurs in them, and returns one value per list.  A row of ``table`` may come
    more than once, where a block lies in two file splits.
    """
    entry = T.StructType([T.StructField("__holder", T.LongType()), T.StructField("__entry", rows.schema[list_col].dataType.elementType)])
    entries = rows.select(BLOCK, list_col).mapInArrow(_distinct_entries, entry)
    values = [c for c in table.columns if c != key_col]
    found = entries.join(table, F.col("__entry") == F.col(key_col)).select("__holder", key_col, *values)
    return with_found(rows, list_col, found, make, out)


def _distinct_entries(batches: Iterator["pyarrow.RecordBatch"]) -> Iterator["pyarrow.RecordBatch"]:
    """(block, entry) of the blocks' distinct entries, block by block."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        block, lists = batch.column(0).to_numpy(), batch.column(1)
        starts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for first, end in zip(starts, starts[1:]):
            if end > first:
                own = lists.slice(first, end - first).flatten().unique()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), block[first])), own], names=["__holder", "__entry"])


def with_found(rows: DataFrame, list_col: str, found: DataFrame, make: Callable[["pyarrow.ListArray", "pyarrow.Table"], "pyarrow.Array"],
               out: T.StructField, keep_block: bool = False) -> DataFrame:
    """As :func:`replace_entries`, with each block's rows of the lookup table given: ``found``, by ``__holder``."""
    kept = [f for f in rows.schema.fields if f.name != list_col and (keep_block or f.name != BLOCK)]
    names = [f.name for f in kept]

    def run(left, right):
        import pyarrow as pa

        if not left.num_rows:
            return pa.table({f: [] for f in [*names, out.name]})
        lists = left.column(list_col).combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        return left.select(names).append_column(out.name, make(lists, right))

    full = rows.withColumn(list_col, F.coalesce(list_col, F.array().cast(rows.schema[list_col].dataType)))
    return full.groupBy(BLOCK).cogroup(found.groupBy("__holder")).applyInArrow(run, T.StructType([*kept, out]))

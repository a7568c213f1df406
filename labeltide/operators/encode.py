"""Vocabulary, token ids, truncation, padding and batches.

The reference feeds text to pretrained tokenizers; the data work around them
(vocabulary, ids, truncation, padding, attention mask, batching) is rebuilt
here over a corpus vocabulary.  Id 0 is padding and id 1 the unknown token.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pyspark.sql import types as T

from ..session import stored
from .blocks import BLOCK, with_found
from .ordering import dense_row_number

PAD_ID = 0
UNK_ID = 1
FIRST_TOKEN_ID = 2
# A block of rows with one dictionary holds about so many bytes of text, or one longer text; so much of the texts a task holds at once.
BLOCK_BYTES = 1 << 25


def _bytes(text_col: str) -> Column:
    return F.col(text_col).cast("string").cast("binary").alias("__text")


def _blocks_of(texts: "pyarrow.BinaryArray") -> Iterator[tuple[int, int, "pyarrow.StringArray", "numpy.ndarray", "numpy.ndarray"]]:
    """(first row, rows, distinct tokens, place of each token among them, ends of the rows' tokens) of the blocks of a batch.

    Tokens are those of ``str.split``, as ``functions.text.tokens`` gives them; a null text has none.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    total = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    if not len(total):
        return
    parts = max(1, -(-int(total[-1]) // BLOCK_BYTES))
    cuts = np.searchsorted(total, total[-1] * np.arange(1, parts) // parts)
    bounds = sorted({0, *cuts.tolist(), len(total)})
    for first, end in zip(bounds, bounds[1:]):
        part = texts.slice(first, end - first)
        try:
            part = part.cast(pa.string())
        except pa.ArrowInvalid:  # some text is no valid UTF-8
            part = pa.array([t and t.decode("utf-8", "replace") for t in part.to_pylist()], pa.string())
        # Blanks at a text's ends, and a blank text, leave empty tokens.
        lists = pc.utf8_split_whitespace(pc.fill_null(part, ""))
        ends = np.cumsum(pc.list_value_length(lists).to_numpy())
        coded = lists.flatten().dictionary_encode()
        words, places = coded.dictionary, coded.indices.to_numpy()
        empty = words.index("").as_py()
        if empty >= 0:
            solid = places != empty
            ends = np.concatenate(([0], np.cumsum(solid)))[ends]
            places = places[solid]
            places = places - (places > empty).astype(np.int32)
            words = pa.concat_arrays([words.slice(0, empty), words.slice(empty + 1)])
        yield first, end - first, words, places, ends


def _count_words(batches: Iterator["pyarrow.RecordBatch"]) -> Iterator["pyarrow.RecordBatch"]:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for _, _, words, places, _ in _blocks_of(batch.column(0)):
            yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(places, minlength=len(words)).astype(np.int64))], names=["token", "n"])


# --------------------------------------------------------------------- E1
def build_vocabulary(df: DataFrame, text_col: str, size: int | None = None,
                     min_count: int = 1) -> DataFrame:
    """``(token, token_id, count)`` for all tokens, or the ``size`` most frequent.

    Tokens are counted by batches of rows, then by token.  Ranking: count
    descending, then token.  With a ``size`` the top is a bounded top-k
    (``TakeOrderedAndProject``); the whole vocabulary is numbered in ranges of
    that order, so neither meets in one task.
    """
    counts = (df.select(_bytes(text_col)).mapInArrow(_count_words, "token string, n long")
              .groupBy("token").agg(F.sum("n").alias("count"))
              .where(F.col("count") >= min_count))
    if size is None:
        ranked = dense_row_number(counts.withColumn("__o", F.struct(-F.col("count"), F.col("token"))), "__o", "__rank")
        return ranked.select("token", (F.col("__rank") - 1 + FIRST_TOKEN_ID).cast("int").alias("token_id"),
                             F.col("count").cast("long").alias("count"))
    top = counts.orderBy(F.col("count").desc(), F.col("token").asc()).limit(size)
    rank = F.row_number().over(Window.orderBy(F.col("count").desc(), F.col("token").asc()))
    return top.select("token", (rank - 1 + FIRST_TOKEN_ID).cast("int").alias("token_id"),
                      F.col("count").cast("long").alias("count"))


# --------------------------------------------------------------------- E2
def _block_encoder(carried: Sequence[str]):
    """Rows by blocks: tokens as places in the dictionary of their block, of which every row holds an equal part."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            for first, n, words, places, ends in _blocks_of(batch.column("__text")):
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(places))
                cuts = pa.array((np.arange(n + 1) * len(words) // n).astype(np.int32))
                own = pa.ListArray.from_arrays(cuts, words)
                rows = batch.slice(first, n)
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in carried), pa.array(np.full(n, block)), cuts.slice(0, n), own, lists],
                                                 names=[*carried, BLOCK, "__from", "__words", "__places"])
                block += 1
    return run


def encode_tokens(df: DataFrame, vocab: DataFrame, text_col: str,
                  out_col: str = "input_ids", keep_text: bool = False, keep_block: bool = False) -> DataFrame:
    """Replace ``text_col`` by ``out_col`` ARRAY<INT>: ids in text order, unknown -> UNK_ID.

    One row out per row in, whatever ids the rows have.  By block dictionaries
    (``blocks``): rows are stored as places in the list of their block's distinct tokens
    (dealt over the block's rows), and only these lists are looked up, so no exchange carries a token per occurrence,
    whatever the size of the vocabulary.  ``keep_block`` keeps the number of the rows'
    block, for ``blocks.blocked``.
    """
    import numpy as np
    import pyarrow as pa

    carried = [f for f in df.schema.fields if keep_text or f.name != text_col]
    names = [f.name for f in carried]
    shape = T.StructType([*carried, T.StructField(BLOCK, T.LongType()), T.StructField("__from", T.IntegerType()), T.StructField("__words", T.ArrayType(T.StringType())),
                          T.StructField("__places", T.ArrayType(T.IntegerType()))])
    rows = stored(df.select(*names, _bytes(text_col)).mapInArrow(_block_encoder(names), shape), "tokens")
    placed = F.transform("__words", lambda word, place: F.struct((F.col("__from") + place).alias("__place"), word.alias("__word")))
    words = rows.select(F.col(BLOCK).alias("__holder"), F.explode(placed).alias("__w")).select("__holder", "__w.__place", "__w.__word")
    # A vocabulary's tokens are distinct, so its parts hash without skew and neither side is sorted.
    known = vocab.select(F.col("token").alias("__tok"), F.col("token_id").cast("int").alias("__tid")).hint("shuffle_hash")
    found = words.join(known, F.col("__word") == F.col("__tok")).select("__holder", "__place", "__tid")
    unknown = UNK_ID

    def ids(lists: pa.ListArray, known: pa.Table) -> pa.Array:
        places, at = lists.flatten().to_numpy(), known.column("__place").to_numpy()
        table = np.full(max(places.max(initial=-1), at.max(initial=-1)) + 1, unknown, np.int32)
        table[at] = known.column("__tid").to_numpy()
        starts = lists.offsets.to_numpy()
        return pa.ListArray.from_arrays(pa.array(starts - starts[0], pa.int32()), pa.array(table[places]))

    return with_found(rows.drop("__from", "__words"), "__places", found, ids, T.StructField(out_col, T.ArrayType(T.IntegerType())), keep_block)


# --------------------------------------------------------------------- E3
def truncate_tokens(df: DataFrame, n: int, col: str = "input_ids") -> DataFrame:
    return df.withColumn(col, F.slice(F.col(col), 1, n))


# --------------------------------------------------------------------- E4
def pad_and_mask(df: DataFrame, col: str = "input_ids", batch: str | None = None, length: int | None = None,
                 mask_col: str = "attention_mask") -> DataFrame:
    """Pad ``col`` with PAD_ID and add the mask: to ``length``, or to the longest row of each ``batch`` (E5).

    Batches are small by definition, so padding to their own longest row never
    multiplies the data by the longest document of the corpus.
    """
    if (batch is None) == (length is None):
        raise ValueError("give either a batch column or a length")
    size = F.size(col)
    if batch is not None:
        df = df.withColumn("__width", F.max(size).over(Window.partitionBy(batch)))
    else:
        df = df.withColumn("__width", F.lit(length))
    fill = F.greatest(F.col("__width") - size, F.lit(0))
    kept = F.least(size, F.col("__width"))
    return (df.withColumn(mask_col, F.concat(F.array_repeat(F.lit(1), kept), F.array_repeat(F.lit(0), fill)))
            .withColumn(col, F.concat(F.slice(F.col(col), F.lit(1), F.col("__width")), F.array_repeat(F.lit(PAD_ID), fill)))
            .drop("__width"))


# --------------------------------------------------------------------- E5
def assign_batches(df: DataFrame, size: int, order_col: str, out_col: str = "batch",
                   ranges: int | None = None) -> DataFrame:
    """``batch = (position - 1) div size`` by ``order_col`` (unique)."""
    numbered = dense_row_number(df, order_col, "__pos", ranges)
    return (numbered.withColumn(out_col, ((F.col("__pos") - 1) / size).cast("long"))
            .drop("__pos"))

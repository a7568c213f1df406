"""Incremental scoring of delimited files as they land.

The reference scores whole test files in batch; it has no streams, windows
or state.  This module only runs the same batch operators over a file
stream, so new test files are read, normalised, cleaned and scored once each,
with exactly-once output through the stream checkpoint:

    readStream.csv -> NULL tokens -> clean_text -> classifier -> parquet

Everything used here is stateless per row, so no watermark or state store
is involved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import clean_text
from ..sources.delimited import NULL_TOKENS, normalise_nulls


def read_delimited_stream(spark: SparkSession, path: str, names: Sequence[str],
                          sep: str = ",", header: bool = True,
                          encoding: str = "UTF-8") -> DataFrame:
    """A streaming DataFrame over the files arriving in ``path`` (string columns)."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = (spark.readStream.schema(schema).option("header", header).option("sep", sep)
          .option("encoding", encoding).option("multiLine", True)
          .option("quote", '"').option("escape", '"').csv(path))
    return normalise_nulls(df, tokens=NULL_TOKENS)


def clean_stream(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Drop NULL texts and clean the rest, as the batch path does."""
    return df.where(F.col(text_col).isNotNull()).withColumn(text_col, clean_text(F.col(text_col)))


def score_stream(df: DataFrame, model, text_col: str = "text",
                 pred_col: str = "prediction") -> DataFrame:
    """Apply a fitted Spark ML ``PipelineModel`` (L9) to a streaming frame."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(df)
    return out.select(*df.columns,
                      F.col("__pred").cast("int").cast("string").alias(pred_col),
                      vector_to_array("__prob").alias("probability"))


def start_scoring(spark: SparkSession, in_path: str, out_path: str, checkpoint: str,
                  model, names: Sequence[str], text_col: str = "text", sep: str = ",",
                  header: bool = True, available_now: bool = False) -> StreamingQuery:
    """Start the file-to-parquet scoring stream and return its handle."""
    stream = score_stream(clean_stream(read_delimited_stream(spark, in_path, names, sep, header),
                                       text_col), model, text_col)
    writer = (stream.writeStream.format("parquet").option("path", out_path)
              .option("checkpointLocation", checkpoint).outputMode("append"))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def clean_table_stream(spark: SparkSession, path: str, out_path: str, checkpoint: str,
                       id_col: str, text_col: str = "text") -> None:
    """Clean a Parquet table as a stream (files are picked up once each) into
    ``out_path``; runs until the files present now are processed."""
    import os

    schema = spark.read.parquet(path).select(id_col, text_col).schema
    source = path
    if not os.path.isdir(path):
        # A single table file: watch its folder through a glob that matches it.
        folder, name = os.path.split(path)
        source = os.path.join(folder, f"{name[:-1]}[{name[-1]}]")
    stream = clean_stream(spark.readStream.schema(schema).parquet(source).select(id_col, text_col),
                          text_col)
    q = (stream.writeStream.format("parquet").option("path", out_path)
         .option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()

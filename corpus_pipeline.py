"""The training-data pipeline: quality rules, near-duplicates, decontamination, mixing, token files.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet and reads it back as the next stage's documents.  All but
the last return the columns of ``documents``, whatever further columns there are.

Nulls and ties.  A null text is an empty one: the quality rules reject it.  A
null source or language is a value of its own.  Every row is a document of its
own, whatever its id: rows that share an id, or have none, go only as copies of
another row's text.  An empty table passes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labeltide.llm.common import Stage, table
from labeltide.llm.decontaminate import decontaminate
from labeltide.llm.mixing import mix_sources
from labeltide.llm.near_dedup import near_duplicates
from labeltide.llm.quality_rules import accepted
from labeltide.llm.queries import public_tokenizer
from labeltide.llm.token_store import token_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor a certified cutoff rejects."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Rows get a number each, in a stored copy, so that rows which share an id, or have none,
    are told apart; no column of the documents can clash with it.
    """
    numbered = Stage(spark, "numbered").put(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "rows")
    found = near_duplicates(numbered.select("doc.doc_id", "doc.text", "row"), size=5, percent=80, row_col="row")
    stays = found.where("stays").select("row")
    return numbered.join(stays.hint("merge"), "row", "left_semi").select("doc.*")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it."""
    return mix_sources(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and where each document lies in them: doc_id, start, n_tokens, ids_crc32."""
    return token_table(docs, public_tokenizer(), end_id=2, words=True)


STAGES = [
    ("quality rules", quality),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", mixed),
    ("token-ID output", tokens),
]

#: Near-duplicate grouping and the tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage, docs = Stage(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, step) in enumerate(STAGES):
        first = len(Stage.made)
        docs = stage.put(step(spark, docs, sf_dir), f"stage-{k}")
        if k:
            stage.drop(f"stage-{k - 1}")
        if k + 1 < len(STAGES):  # the last one's folder holds the token files
            Stage.clear(first)
    return docs

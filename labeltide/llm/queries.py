"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labeltide.llm import oracle
from labeltide.llm.collocations import mine_collocations
from labeltide.llm.common import table
from labeltide.llm.decontaminate import find_benchmark
from labeltide.llm.mixing import taken_words
from labeltide.llm.near_dedup import near_duplicates
from labeltide.llm.pii import find_pii
from labeltide.llm.quality_classifier import score_quality
from labeltide.llm.quality_rules import quality_rules
from labeltide.llm.secret_scan import ranked_words, scan_secrets
from labeltide.llm.sharding import shard_rows
from labeltide.llm.simhash_dedup import simhash_duplicates
from labeltide.llm.token_store import token_table
from labeltide.llm.warc import archive_digests
from labeltide.llm.whitening import whitening_report


def op1_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    may_learn = F.crc32(F.col("_id").cast("string")) % 3 != 1
    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), may_learn)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op2_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_digests(table(spark, sf_dir, "pages"))


def op3_bmw_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_plane_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(table(spark, sf_dir, "documents"), public_tokenizer(), end_id=2, words=True)


def op6_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_rows(table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op8_certified_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_guess_cost_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"), words=ranked_words(public_tokenizer()))


def op10_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents")).drop("found")


def op11_polarised_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening_report(table(spark, sf_dir, "embeddings"))


def op12_tiled_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_collocations(table(spark, sf_dir, "documents"))


def op13_multi_index_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nbsvm_quality": op1_nbsvm_quality,
    "op2_warc_index": op2_warc_index,
    "op3_bmw_benchmark": op3_bmw_benchmark,
    "op4_superminhash": op4_superminhash,
    "op5_plane_tokens": op5_plane_tokens,
    "op6_pareto_mixing": op6_pareto_mixing,
    "op7_kd_shards": op7_kd_shards,
    "op8_certified_rules": op8_certified_rules,
    "op9_guess_cost_secrets": op9_guess_cost_secrets,
    "op10_boosted_pii": op10_boosted_pii,
    "op11_polarised_whitening": op11_polarised_whitening,
    "op12_tiled_collocations": op12_tiled_collocations,
    "op13_multi_index_simhash": op13_multi_index_simhash,
}

ORACLE: dict[str, str] = {
    "op2_warc_index": oracle.OP2,
    "op6_pareto_mixing": oracle.OP6,
    "op8_certified_rules": oracle.OP8,
    "op12_tiled_collocations": oracle.OP12,
}

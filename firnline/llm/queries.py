"""One query per operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from firnline.llm import decontamination, hardneg, langid, linededup, mixing, prefixtrie, quality, sharding, simhash, sql, suffix, tokenbin, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op2_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.mark_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_zstd_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenbin.tokenize_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_simhash_pivot_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_report(_table(spark, sf_dir, "documents"))


def op6_ecoc_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_documents(_table(spark, sf_dir, "documents"))


def op7_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"))


def op8_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents"))


def op9_line_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(_table(spark, sf_dir, "documents"))


def op10_bucket_pointer_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.suffix_report(_table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.rebuilt_trie(_table(spark, sf_dir, "conversations"))


def op12_bit_sliced_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hardneg.hard_negatives(_table(spark, sf_dir, "embeddings"))


def op13_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_hash_tree_sharding, op2_ftrl_toxicity, op3_winnowing_decontamination, op4_zstd_token_frames, op5_simhash_pivot_tables, op6_ecoc_language_id, op7_repetition_coverage, op8_temperature_mixing, op9_line_hash_dedup, op10_bucket_pointer_suffixes, op11_prefix_trie, op12_bit_sliced_negatives, op13_warc_capture_index)}


def oracle_sql() -> dict[str, str]:
    return {"op3_winnowing_decontamination": sql.DECONTAMINATION, "op8_temperature_mixing": sql.MIXING, "op10_bucket_pointer_suffixes": sql.REPEATED_STRINGS, "op11_prefix_trie": sql.PREFIX_TRIE, "op12_bit_sliced_negatives": sql.HARD_NEGATIVES, "op13_warc_capture_index": sql.ARCHIVES}

"""The registered queries of this folder and the SQL of those that have one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..plans.workspace import work_folder
from . import (
    arc_warc,
    language_id,
    line_dedup,
    mixing,
    packing,
    periodic_runs,
    pii,
    quality_rules,
    simhash,
    substring_suffix,
    token_counts,
    topk,
    vector_codes,
)
from .common import read_table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return quality_rules.quality_rules(docs, labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), vocabulary)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_suffix.remove_repeats(read_table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read_table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_units(read_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as ARC archives, converted to WARC archives, which are read back."""
    arc, warc = work_folder(spark, "arc"), work_folder(spark, "warc")
    arc_warc.write_arc(read_table(spark, sf_dir, "pages"), arc)
    arc_warc.arc_to_warc(spark, arc, warc)
    return arc_warc.read_pages(spark, warc)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(read_table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress_vectors(read_table(spark, sf_dir, "embeddings"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.collapse_runs(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_best_fit_packing,
        op3_token_counts,
        op4_simhash,
        op5_topk,
        op6_suffix_dedup,
        op7_pii,
        op8_substring_dedup,
        op9_warc,
        op10_mixing,
        op11_language_id,
        op12_vector_codes,
        op13_periodic_runs,
    )
}
ORACLES: dict[str, str] = {
    "op5_topk": topk.SQL,
    "op8_substring_dedup": line_dedup.sql(),
    "op9_warc": arc_warc.SQL,
}

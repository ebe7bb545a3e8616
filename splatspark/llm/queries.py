"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontamination, license_scan, line_dedup, packing, pii, quality_rules, simhash, substring_dedup, token_counts
from .common import table

#: A production run brings its own secret.
PII_KEY = "demonstration key"


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    edited = token_counts.sample_edits(table(spark, sf_dir, "documents"))
    return token_counts.edited_counts(edited, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_measures(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymised(table(spark, sf_dir, "documents"), PII_KEY)
    return found.select("doc_id", "text", "n_found", "kinds")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.page_lines(table(spark, sf_dir, "pages"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scanned(table(spark, sf_dir, "documents")).drop("spans")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    probe = spark.range(2).select(
        F.lit(chat_format.PROBE_ID).cast("bigint"), F.col("id").cast(turns.schema["turn"].dataType), role, F.lit(chat_format.PROBE_TEXT)
    )
    return chat_format.digests(turns.union(probe))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("first_byte")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_simhash,
        op3_token_counts,
        op4_quality_rules,
        op5_pii,
        op6_line_dedup,
        op7_license_scan,
        op8_chat_format,
        op9_packing,
        op10_decontamination,
    )
}
ORACLE: dict[str, str] = {
    "op6_line_dedup": line_dedup.ORACLE,
    "op8_chat_format": chat_format.ORACLE,
    "op10_decontamination": decontamination.ORACLE,
}

"""The registered queries of the training-data operators: each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenery.llm import decontaminate, filter_audit, html_text, line_dedup, lm, mixing, near_dedup, oracles, pii, quality, sharding, substring_dedup, token_alignment, warc
from scenery.llm.common import materialise


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(documents(spark, sf_dir))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.clean(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", "removed", "text")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contaminated(documents(spark, sf_dir), items).drop("text_hash")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "lang", "source", "text")
    statistics = materialise(quality.base_statistics(docs).drop("text"), "quality-statistics")
    judged = quality.judge(statistics, quality.estimate(statistics))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return html_text.extract(pages).select("page_id", "url", "text", "n_chars")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir), "doc_id")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc.archive(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir).select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(documents(spark, sf_dir))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_decontaminate": op4_decontaminate,
    "op5_quality_rules": op5_quality_rules,
    "op6_html_text": op6_html_text,
    "op7_sharding": op7_sharding,
    "op8_pii": op8_pii,
    "op9_warc": op9_warc,
    "op10_mixing": op10_mixing,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_filter_audit": op12_filter_audit,
    "op13_token_alignment": op13_token_alignment,
}
ORACLES: dict[str, str] = {"op4_decontaminate": oracles.DECONTAMINATE, "op7_sharding": oracles.SHARDING, "op9_warc": oracles.WARC, "op11_substring_dedup": oracles.SUBSTRINGS, "op12_filter_audit": oracles.FILTER_AUDIT}

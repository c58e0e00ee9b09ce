"""The subpackage's queries, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from provlake.llm import byte_bpe, compression_quality, fill_in_middle, filter_audit, media, neardup, packing, paragraph_dedup, pii, quality_trees, simhash, suffix_dedup, token_files
from provlake.llm.common import documents


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_trees.judge(documents(spark, sf_dir), labels(spark, sf_dir))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_read(documents(spark, sf_dir))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(documents(spark, sf_dir)).drop("ids")


def op5_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_quality.classify(documents(spark, sf_dir), labels(spark, sf_dir))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(documents(spark, sf_dir))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(documents(spark, sf_dir)).drop("row", "root")


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(documents(spark, sf_dir))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir))


def op10_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.dedup(documents(spark, sf_dir)).drop("row", "kept")


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(documents(spark, sf_dir))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(documents(spark, sf_dir))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), labels(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_quality_rules": op2_quality_rules,
        "op3_token_files": op3_token_files,
        "op4_byte_bpe": op4_byte_bpe,
        "op5_compression_classifier": op5_compression_classifier,
        "op6_suffix_array_dedup": op6_suffix_array_dedup,
        "op7_minhash_near_dedup": op7_minhash_near_dedup,
        "op8_media_columns": op8_media_columns,
        "op9_personal_data": op9_personal_data,
        "pipeline": pipeline,
        "op10_paragraph_dedup": op10_paragraph_dedup,
        "op11_simhash_near_dedup": op11_simhash_near_dedup,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {"op12_fill_in_middle": fill_in_middle.SQL, "op13_filter_audit": filter_audit.SQL}

"""The corpus operators as queries over the tables of one folder, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import bpe_codec, decontaminate, language_id, line_dedup, quality_model, quality_rules, simhash, substring_dedup, token_counts, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark, sf_dir):
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_decontamination(spark, sf_dir):
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.with_verdict(found).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


def op3_quality_rules(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op4_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op5_line_dedup(spark, sf_dir):
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_simhash(spark, sf_dir):
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_language_id(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark, sf_dir):
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), digest=True)


def op9_bpe_codec(spark, sf_dir):
    return bpe_codec.encode_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_token_counts(spark, sf_dir):
    out = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > 512)


def queries():
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_decontamination": op2_decontamination,
        "op3_quality_rules": op3_quality_rules,
        "op4_url_filter": op4_url_filter,
        "op5_line_dedup": op5_line_dedup,
        "op6_simhash": op6_simhash,
        "op7_language_id": op7_language_id,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_bpe_codec": op9_bpe_codec,
        "op10_token_counts": op10_token_counts,
    }


def oracle_sql():
    return {
        "op3_quality_rules": quality_rules.oracle(),
        "op4_url_filter": url_filter.oracle(),
        "op5_line_dedup": line_dedup.oracle(),
    }

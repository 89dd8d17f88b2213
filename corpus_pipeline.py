"""Corpus pipeline: five stages over `documents`, each written as Parquet and reread as the next one's input.

1. quality rules: documents that fail, or whose host is rejected, go;
2. line dedup: later repeats of runs of 50 words or more go; documents that lose all their words go;
3. near-dedup: one document of each class stays; classes link texts whose five-word shingles have a Jaccard similarity of at least 0.8;
4. benchmark decontamination: contaminated documents go;
5. byte-level BPE: documents are encoded, and decoded for a round-trip digest.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe_codec, decontaminate, line_dedup, near_copies, quality_rules
from weftline.llm.common import shared_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.clean_lines(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the token ids, their number, and digests of ids and decoded bytes."""
    out = bpe_codec.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select(
        "doc_id",
        "token_ids",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("token_ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [("quality rules", quality), ("line dedup", lines), ("simhash near-dedup", near), ("decontamination", decontaminated), ("byte-level BPE", encoded)]

#: Classes of near copies can't be expressed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

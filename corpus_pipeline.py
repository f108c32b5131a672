"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

1. Language ID drops texts without letters.
2. SimHash near-dedup keeps one document of each component, the one of smallest id.
3. Substring dedup cuts passages of 20 words or more that stand earlier; a document left without words is dropped.
4. Decontamination drops documents that hold a benchmark window.
5. SentencePiece encoding adds the ids of each text (``ids``, ``n_pieces``) and decodes them again (``lossless``).

All but the last return the columns of ``documents``. Empty tables pass through as empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basketry.llm import decontaminate, langid, pieces, simhash, substring_dedup
from basketry.session import materialize

def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # No cut on the score: it depends on the text's length, and short clean texts and scripts that were not learned score low.
    return langid.accept(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.with_ids(docs)


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", passage_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding and decoding", sentencepiece),
]

# Language profiles, XXH64 fingerprints and piece scores have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
    return docs

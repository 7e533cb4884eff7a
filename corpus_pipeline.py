"""Corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing.

Each stage takes the documents its predecessor kept. Quality rules reject documents; line dedup rewrites texts (and drops documents
whose lines all went); near-dedup keeps one document of each group; mixing repeats documents so that every source
is read at least once and none more than twice as often as another; packing gives the places of token pieces. The stages define nulls, ties and empty
input in their modules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dropscope.llm import lines, minhash, mixing, packing, quality
from dropscope.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_documents(docs, host="source")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.filter_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_duplicates(docs, percent=80, width=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, max_repeats=2.0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_digests(docs, tokenizer_path(), capacity=4096)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", near_dedup),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack),
]
# Tokenizing is beyond SQL: tests/llm/test_methods.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what one stage leaves is written to the shared scratch folder and read by the next."""
    from dropscope.llm.common import keep

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: language, quality, near-duplicates, packing; every stage is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pageloom.llm import language, packing, quality, simhash
from pageloom.llm.common import written
from pageloom.llm.queries import byte_bpe


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which one language has a clear part; the model is learned from their own labels."""
    return language.with_a_language(docs, language.learn(docs))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean_rows(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of the SimHash operator: three-word shingles, links at two or fewer bits."""
    return simhash.without_near_duplicates(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, byte_bpe())


STAGES = [("language", language_stage), ("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("packing", packing_stage)]

# The language model, the fingerprints and the tokenizer have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

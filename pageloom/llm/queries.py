"""The queries of this folder; each takes (spark, sf_dir) and reads the tables there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import ann, bpe, language, licenses, matrices, maxent, packing, pivots, prefixes, quality, redirects, simhash, whitening
from pageloom.llm.common import is_held_out
from pageloom.llm.tokens import ModelFile

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def splitting_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def byte_bpe() -> ModelFile:
    return ModelFile(tokenizer_file("byte_bpe_50k.json"), splitting_pattern())


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode(documents(spark, sf_dir), tokenizer_file("byte_bpe_multi_50k.tiktoken"), splitting_pattern())
    decimal = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", "n_tokens", F.sha2(decimal.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), byte_bpe())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", is_held_out(F.col("doc_id"), 7))
    model, counts = maxent.learn(docs, ~F.col("held_out"))
    return maxent.score(docs, model, counts, ["doc_id", "held_out"])


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.with_quality(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", *[f"_quality.{c}" for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", is_held_out(F.col("doc_id"), 4))
    model = language.learn(docs, ~F.col("held_out"))
    return language.identify(docs, model, ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redirects.judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


def op8_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrices.matrices(documents(spark, sf_dir), byte_bpe())


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(documents(spark, sf_dir))
    base = F.array_sort(F.array_distinct("places.label"))
    every = F.array_sort(F.array_union("places.label", "found.label"))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.word").alias("first_word"),
        F.array_max("places.word").alias("last_word"), F.array_join(base, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.coalesce(F.array_max("found.score"), F.lit(0.0)).alias("score"))


def op11_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.similar_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_conversation_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_byte_bpe, op2_packing, op3_nearest_neighbours, op4_language_model, op5_quality_rules, op6_language_id, op7_url_filters,
    op8_token_matrices, op9_simhash, op10_license_scan, op11_embedding_near_duplicates, op12_embedding_whitening, op13_conversation_prefixes)}

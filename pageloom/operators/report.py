"""Size reports: how much text each representation of a page holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions import text as T
from pageloom.functions import urls as U
from pageloom.plans.convert import page_bodies, with_targets

METRICS = ["chars", "bytes", "words", "tokens"]
REPRESENTATIONS = ["html", "plaintext", "markdown"]


def sizes(text: Column) -> Column:
    """Struct of characters, UTF-8 bytes, words and estimated tokens."""
    words = T.word_count(text)
    return F.struct(
        T.char_count(text).alias("chars"), T.byte_count(text).alias("bytes"), words.alias("words"),
        T.token_estimate(words).alias("tokens"))


def page_sizes(pages: DataFrame, extractor: str = "heuristic") -> DataFrame:
    """(page_id, host, html, plaintext, markdown): sizes of the three representations, from one pass."""
    placed = with_targets(pages.select("page_id", "url", "html"), "single")
    placed = placed.withColumns({"html_size": sizes(F.col("html")), "host": U.netloc(F.col("url"))})
    bodies = page_bodies(placed, extractor, local_images=False, carry=("html_size", "host"), plain=True)
    return bodies.select(
        "page_id", "host", F.col("html_size").alias("html"), sizes(F.col("plaintext")).alias("plaintext"),
        sizes(F.col("body")).alias("markdown"))


def representation_report(pages: DataFrame, extractor: str = "heuristic") -> DataFrame:
    """(page_id, representation, chars, bytes, words, tokens): one row per page and representation."""
    each = F.explode(F.array(*[
        F.struct(F.lit(r).alias("representation"), *[F.col(f"{r}.{m}").alias(m) for m in METRICS]) for r in REPRESENTATIONS]))
    return page_sizes(pages, extractor).select("page_id", each.alias("r")).select("page_id", "r.*")


def compression(pages: DataFrame, extractor: str = "heuristic") -> DataFrame:
    """(page_id, chars, bytes, words, tokens): HTML to Markdown ratios as text, like 3.4x."""
    return page_sizes(pages, extractor).select(
        "page_id", *[T.ratio(F.col(f"html.{m}"), F.col(f"markdown.{m}")).alias(m) for m in METRICS])


def token_savings(pages: DataFrame, extractor: str = "heuristic") -> DataFrame:
    """(level, host, page_id, html_tokens, markdown_tokens, saved_tokens, saved_percent) per page, host and corpus."""
    each = page_sizes(pages, extractor).select(
        "host", "page_id", F.col("html.tokens").alias("h"), F.col("markdown.tokens").alias("m"))
    summed = each.rollup("host", "page_id").agg(
        F.grouping_id().alias("g"), F.sum("h").alias("html_tokens"), F.sum("m").alias("markdown_tokens"))
    saved = F.col("html_tokens") - F.col("markdown_tokens")
    level = F.when(F.col("g") == 0, "page").when(F.col("g") == 1, "host").otherwise("corpus")
    return summed.select(
        level.alias("level"), "host", "page_id", "html_tokens", "markdown_tokens", saved.alias("saved_tokens"),
        T.percent(saved, F.col("html_tokens")).alias("saved_percent"))

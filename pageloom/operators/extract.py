"""Which part of a page is its content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions import markup as M
from pageloom.functions import text as T
from pageloom.operators.tokens import doc_order, inside, nodes, with_attrs

EXTRACTORS = ("heuristic", "density", "full")


def rule_number(kind: Column, tag: Column, attrs: Column) -> Column:
    """1..5 for elements that may hold the content, in order of preference; null for others."""
    by_id = M.attribute(attrs, "id").rlike("(?i)content|main|article")
    by_class = M.attribute(attrs, "class").rlike("(?i)content|main|article|post-body")
    return F.when(kind == "open", (
        F.when(tag == "article", 1).when(tag == "main", 2)
        .when((tag == "div") & (M.attribute(attrs, "role") == "main"), 3)
        .when((tag == "div") & by_id, 4).when((tag == "div") & by_class, 5)))


def is_shown() -> Column:
    """Neither script, style, comment, declaration nor inside noscript."""
    return ~F.col("kind").isin("raw", "comment", "declaration") & (inside(F.col("tag") == "noscript") == 0)


def with_shown(rows: DataFrame) -> DataFrame:
    return rows.withColumn("shown", is_shown())


def with_region(rows: DataFrame, extractor: str = "heuristic", dense: DataFrame | None = None) -> DataFrame:
    """Add ``region``: struct(rule, start, end) of the page's content; rule 0 is the whole page.

    ``rows`` hold ``shown`` and ``attrs``; ``density`` takes its blocks from ``dense_blocks``.
    """
    if extractor not in EXTRACTORS:
        raise ValueError(f"extractor must be one of {EXTRACTORS}")
    page = F.struct(F.lit(0).alias("rule"), F.lit(-1).alias("start"), F.lit(2**31 - 1).alias("end"))
    if extractor == "heuristic":
        rule = F.when(F.col("shown"), rule_number(F.col("kind"), F.col("tag"), F.col("attrs")))
        rows = rows.withColumn("_rule", rule)
        found = F.when(F.col("_rule").isNotNull(), F.struct(
            F.col("_rule").alias("rule"), F.col("pos").alias("start"), F.col("mate").alias("end")))
        return rows.withColumn("region", F.coalesce(F.min(found).over(Window.partitionBy("page_id")), page)).drop("_rule")
    if extractor == "density":
        best = F.struct(F.lit(6).alias("rule"), F.col("start_pos").alias("start"), F.col("end_pos").alias("end"))
        chosen = rows.join(dense.select("page_id", "start_pos", "end_pos"), "page_id", "left")
        return chosen.withColumn("region", F.when(F.col("start_pos").isNotNull(), best).otherwise(page)).drop("start_pos", "end_pos")
    return rows.withColumn("region", page)


def regions(pages: DataFrame, extractor: str = "heuristic") -> DataFrame:
    """(page_id, rule, start_pos, end_pos): the content region each page is cut to."""
    rows = with_shown(nodes(pages).filter(F.col("pos").isNotNull()))
    dense = dense_blocks(pages) if extractor == "density" else None
    chosen = with_region(with_attrs(rows), extractor, dense)
    return chosen.filter(F.col("pos") == 0).select(
        "page_id", "region.rule", F.col("region.start").alias("start_pos"), F.col("region.end").alias("end_pos"))


def region_text(pages: DataFrame, extractor: str = "heuristic") -> DataFrame:
    """(page_id, text): visible text nodes of the content region, one per line."""
    rows = with_shown(nodes(pages))
    chosen = with_region(with_attrs(rows), extractor, dense_blocks(pages) if extractor == "density" else None)
    within = F.col("shown") & F.col("pos").between(F.col("region.start"), F.col("region.end"))
    text = F.when(within, T.strip(M.token_text(F.col("kind"), F.col("tok"))))
    return chosen.select("page_id", "pos", text.alias("t")).groupBy("page_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("t") != "", F.struct("pos", "t")))).alias("ts")
    ).select("page_id", F.array_join("ts.t", "\n").alias("text"))


# Public readability hints: class and id names that speak for or against a block.
_GOOD = r"(?i)article|body|content|entry|hentry|main|page|post|text|blog|story"
_BAD = (
    r"(?i)comment|combx|contact|foot|masthead|media|meta|promo|related|scroll|shoutbox|sidebar|sponsor|shopping"
    r"|tags|tool|widget|nav|menu|\bads?\b")
_BLOCKS = ["div", "section", "article", "main", "td", "blockquote", "body"]
LONG_PARAGRAPH = 25


def block_scores(pages: DataFrame) -> DataFrame:
    """(page_id, start_pos, end_pos, score): text density of the blocks that hold paragraphs.

    A paragraph of 25 or more characters of its own gives 1 + its commas + one per 100 characters (3 at most) to
    the block around it and half of that to the next block out. The sum counts by the share of the block's text
    that is not link text; telling class or id names add or take 25. A paragraph's own text ends where the next
    one starts, so unclosed paragraphs count like closed ones.
    """
    tag, opens = F.col("tag"), F.col("kind") == "open"
    is_block = tag.isin(_BLOCKS)
    rows = with_shown(nodes(pages).filter(F.col("pos").isNotNull()))
    rows = rows.withColumn("t", F.when(F.col("shown") & (F.col("kind") == "text"), T.strip(M.decode_references(F.col("tok")))))
    rows = rows.withColumn("chars", F.coalesce(F.char_length("t"), F.lit(0)))
    rows = rows.withColumns({
        "depth": inside(is_block), "in_p": inside(tag == "p") > 0, "in_a": inside(tag == "a") > 0})
    before = doc_order()
    rows = rows.withColumns({
        "par": F.max(F.when(opens & (tag == "p"), F.struct("pos", "depth"))).over(before),
        "all_chars": F.sum("chars").over(before),
        "link_chars": F.sum(F.when(F.col("in_a"), F.col("chars")).otherwise(0)).over(before)})

    # Paragraphs: own text, with the block depth they stand at.
    commas = F.regexp_count("t", F.lit("[,\uff0c\u3001]"))
    pars = rows.filter(F.col("in_p") & (F.col("t") != "")).groupBy(
        "page_id", F.col("par.pos").alias("pos"), F.col("par.depth").alias("level")).agg(
        F.sum("chars").alias("chars"), F.sum(commas).alias("commas"))
    pars = pars.filter(F.col("chars") >= LONG_PARAGRAPH).select(
        "page_id", "pos", "level", F.lit(None).cast("int").alias("block"),
        (1 + F.col("commas") + F.least(F.floor(F.col("chars") / 100), F.lit(3))).cast("double").alias("points"))

    # Blocks: extent, text inside, name hints.
    blocks = rows.filter(is_block & F.col("kind").isin("open", "close")).groupBy(
        "page_id", F.least("pos", "mate").alias("start_pos")).agg(
        F.max(F.greatest("pos", "mate")).alias("end_pos"), F.max("depth").alias("depth"), F.first("tok").alias("tok"),
        (F.max("all_chars") - F.min("all_chars")).alias("chars"), (F.max("link_chars") - F.min("link_chars")).alias("links"))

    # The block around a row is the last one opened at the row's depth. A block looks itself up one level out.
    opened = blocks.select("page_id", F.col("start_pos").alias("pos"), F.col("depth").alias("level"),
                           F.col("start_pos").alias("block"), F.lit(0.0).alias("points"), F.lit(True).alias("own"))
    outward = opened.withColumns({"level": F.col("level") - 1, "own": F.lit(False)})
    lookups = opened.unionByName(outward).unionByName(pars.withColumn("own", F.lit(False)))
    per_level = Window.partitionBy("page_id", "level").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = lookups.withColumn("around", F.last(F.when(F.col("own"), F.col("pos")), True).over(per_level)).filter(~F.col("own"))
    direct = placed.filter(F.col("block").isNull()).groupBy("page_id", F.col("around").alias("start_pos")).agg(F.sum("points").alias("points"))
    outer = placed.filter(F.col("block").isNotNull()).select("page_id", F.col("block").alias("start_pos"), "around")
    handed_up = direct.join(outer, ["page_id", "start_pos"]).select("page_id", F.col("around").alias("start_pos"), (F.col("points") / 2).alias("points"))
    points = direct.unionByName(handed_up).filter(F.col("start_pos").isNotNull()).groupBy("page_id", "start_pos").agg(F.sum("points").alias("points"))

    attrs = M.attributes(F.col("tok"))
    names = F.concat_ws(" ", M.attribute(attrs, "class"), M.attribute(attrs, "id"))
    hint = F.when(names.rlike(_GOOD), 25).otherwise(0) - F.when(names.rlike(_BAD), 25).otherwise(0)
    share = F.coalesce(F.col("links") / F.nullif(F.col("chars"), F.lit(0)), F.lit(0.0))
    return points.join(blocks, ["page_id", "start_pos"]).select(
        "page_id", "start_pos", "end_pos", (F.col("points") * (1 - share) + hint).alias("score"))


def dense_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, start_pos, end_pos): the densest block of each page that has one; the first on a tie."""
    best = F.max(F.struct("score", (-F.col("start_pos")).alias("first"), "end_pos")).alias("b")
    return block_scores(pages).groupBy("page_id").agg(best).select(
        "page_id", (-F.col("b.first")).alias("start_pos"), F.col("b.end_pos").alias("end_pos"))

"""Markdown from node rows.

Each token becomes a short string. Breaks and spaces that depend on what comes next are marker characters; once
the strings of a page stand in order, a few replacements settle them: a paragraph break swallows the spaces and
line breaks around it, a space at a line start goes, the text after a list marker starts at once. So rendering is
window context + one expression per token + one ordered aggregation per page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions import markup as M
from pageloom.functions import text as T
from pageloom.operators.code import fence
from pageloom.operators.tables import table_depth, table_places, with_entries
from pageloom.operators.tokens import doc_order

# Markers are Unicode noncharacters; page text is cleared of them first.
PARAGRAPH, LINE, ROW, SPACE, START, ANCHOR, QUOTE, UNQUOTE = (chr(0xFDE0 + n) for n in range(8))
_BREAKS = f"[{PARAGRAPH}-{SPACE}]"
_NONCHARACTERS = f"[{chr(0xFDD0)}-{chr(0xFDEF)}]"

HEADING = r"^h[1-6]$"
EMPHASIS = {"em": "_", "i": "_", "u": "_", "strong": "**", "b": "**", "del": "~~", "strike": "~~", "s": "~~"}
CODE = ["code", "tt", "kbd"]
LISTS = ["ul", "ol"]


def clean(text: Column) -> Column:
    return F.when(text.rlike(_NONCHARACTERS), F.regexp_replace(text, _NONCHARACTERS, "")).otherwise(text)


def escape(text: Column) -> Column:
    """Escape what Markdown would take for structure: backslashes, and list markers at a line start."""
    line = r"(?m)(^|(?<=[&<>]))"
    e = F.regexp_replace(text, r"(\\)(?=[\\`*_{}\[\]()#+\-.!])", r"\\$1")
    e = F.regexp_replace(e, line + r"([ \t\r\f ]*\d+)(\.)(?=\s)", r"$1$2\\$3")
    e = F.regexp_replace(e, line + r"([ \t\r\f ]*)(\+)(?=\s)", r"$1$2\\$3")
    return F.regexp_replace(e, line + r"([ \t\r\f ]*)(-)(?=\s|-)", r"$1$2\\$3")


def _inside(condition: Column) -> Column:
    """Like ``tokens.inside``, counting only what opens in the content region."""
    within = F.col("in_body")
    step = (
        F.when(within & condition & (F.col("kind") == "open"), 1)
        .when(within & condition & (F.col("kind") == "close"), -1).otherwise(0))
    return F.sum(step).over(doc_order()) - F.least(step, F.lit(0))


def with_context(rows: DataFrame) -> DataFrame:
    """Add what the rendering of a token depends on: open lists, quotes, links, cells; the tags before it.

    Also adds the entries of tables. ``rows`` hold ``attrs``, ``in_body``, ``latex`` and ``in_formula``. All windows
    share one ordering and are asked for in two steps, as the second needs the first: two passes over the rows.
    """
    tag, kind, within = F.col("tag"), F.col("kind"), F.col("in_body")
    before = doc_order().rowsBetween(Window.unboundedPreceding, -1)
    is_tag = kind.isin("open", "close", "empty")
    stress = F.when(kind.isin("text", "rcdata"), "text").when((kind == "open") & tag.isin(list(EMPHASIS)), "stress")
    block_end = F.max(F.when(within & (kind == "open") & (tag == "pre"), F.col("mate"))).over(before)
    rows = rows.withColumns({
        "table_depth": table_depth(within),
        "lists": _inside(tag.isin(LISTS)), "quotes": _inside(tag == "blockquote"), "links": _inside(tag == "a"),
        "cells": _inside(tag.isin("td", "th")), "codes": _inside(tag.isin(CODE)),
        # The head is silent; an unclosed one ends where the body starts.
        "heads": F.when(F.max(F.when(tag == "body", 1)).over(doc_order()) == 1, 0).otherwise(_inside(tag == "head")),
        "in_pre": F.coalesce(block_end >= F.col("pos"), F.lit(False)),
        "tag_before": F.last(F.when(within & is_tag, tag), True).over(before),
        "stressed": F.coalesce(F.last(F.when(within, stress), True).over(before) == "stress", F.lit(False)),
    })
    after_stress = F.last(F.when(within & kind.isin("text", "rcdata"), F.col("stressed")), True).over(before)
    return with_entries(rows.withColumns({"after_stress": F.coalesce(after_stress, F.lit(False)), **table_places()}))


def with_words(rows: DataFrame) -> DataFrame:
    """Add ``words``: the escaped text of text rows in the content region, whitespace runs as single spaces."""
    shown = F.col("in_body") & ~F.col("in_formula") & ~F.col("in_pre") & F.col("kind").isin("text", "rcdata")
    raw = F.when(shown, clean(M.token_text(F.col("kind"), F.col("tok"))))
    rows = rows.withColumn("words", raw)
    raw = F.col("words")
    spaced = F.col("after_stress") & raw.rlike(r"^[^\]\[(){}\s.!?]") & ~F.col("tag_before").isin("a", "code", "pre")
    rows = rows.withColumn("words", F.when(F.col("stressed"), T.strip(raw)).when(spaced, F.concat(F.lit(" "), raw)).otherwise(raw))
    structural = F.col("words").contains("\\") | F.col("words").rlike(r"(?:\A|[\n&<>])[ \t\r\f]*(?:\d+\.|[+\-])")
    plain = (F.col("codes") > 0) | ~structural
    return rows.withColumn("words", T.collapse(F.when(plain, F.col("words")).otherwise(escape(F.col("words")))))


def with_markdown(rows: DataFrame, image_md: Column | None = None) -> DataFrame:
    """Add ``md``: the Markdown piece of each row, '' for those without. ``image_md`` replaces local images."""
    tag, kind = F.col("tag"), F.col("kind")
    opens, closes = kind == "open", kind == "close"
    attr = lambda name: M.attribute(F.col("attrs"), name)
    rows = with_words(rows)
    spaced = F.col("words").startswith(" ")
    words = F.when(spaced, F.substring("words", 2, 2**31 - 1)).otherwise(F.col("words"))

    href, in_link = attr("href"), F.col("links") > 0
    automatic = href.rlike(r"^[a-zA-Z+]+://") & (href == F.col("text"))
    title = F.when(T.strip(attr("title")) != "", F.concat(F.lit(' "'), attr("title"), F.lit('"'))).otherwise("")
    link_end = F.when(automatic, ">").otherwise(F.concat(F.lit("]("), href, title, F.lit(")")))
    alt = F.regexp_replace(F.coalesce(attr("alt"), F.lit("")), r"([\\\[\]()])", r"\\$1")
    remote = F.when(attr("src").isNotNull(), F.concat(F.lit("!["), alt, F.lit("]("), attr("src"), F.lit(")")))
    image = remote if image_md is None else F.coalesce(image_md, remote)

    level = F.substring(tag, 2, 1).try_cast("int")
    numbered = M.tag_name(F.col("parent_tok")) == "ol"
    first = F.coalesce(F.regexp_extract("parent_tok", r"(?i)\sstart\s*=\s*[\"']?(-?\d+)", 1).try_cast("int"), F.lit(1))
    marker = F.when(numbered, F.concat((first + F.col("nth") - 1).cast("string"), F.lit(". "))).otherwise("* ")
    item = F.concat(F.repeat(F.lit("  "), F.col("lists").cast("int")), marker)
    outermost = F.col("lists") == 1
    is_heading = tag.rlike(HEADING) & ~in_link
    is_block = tag.isin("p", "div") & ~in_link & (F.col("cells") == 0)
    emphasis = F.lit(None).cast("string")
    for mark in dict.fromkeys(EMPHASIS.values()):
        emphasis = F.when(tag.isin([t for t, m in EMPHASIS.items() if m == mark]), mark).otherwise(emphasis)
    in_nested = F.col("table_depth") > 1

    # What goes before the piece (markers), the piece itself, what follows it (markers).
    none = F.lit("")
    tagged = opens | closes
    pre = (
        F.when(F.col("latex").isNotNull(), F.when(F.col("is_block"), PARAGRAPH).otherwise(""))
        .when(kind.isin("text", "rcdata"), F.when(in_nested | spaced, SPACE).otherwise(""))
        .when(in_nested, SPACE)
        .when(tagged & (is_heading | is_block), PARAGRAPH)
        .when(opens & tag.isin("blockquote", "dl", "pre"), PARAGRAPH)
        .when(closes & (tag == "blockquote"), PARAGRAPH)
        .when(tag == "hr", PARAGRAPH)
        .when(tagged & (tag == "li"), LINE)
        .when(opens & tag.isin(LISTS) & outermost & ~F.coalesce(F.col("tag_before").isin(LISTS), F.lit(False)), PARAGRAPH)
        .when(closes & tag.isin("dt", "dd"), LINE)
        .when(closes & (tag == "tr"), ROW)
        .when(opens & (tag == "a") & href.isNotNull() & ~automatic, ANCHOR)
        .otherwise(none))
    data = (
        F.when(F.col("latex").isNotNull(), F.when(
            F.col("is_block"), F.concat(F.lit("$$"), F.col("latex"), F.lit("$$"))).otherwise(
            F.concat(F.lit("$"), F.col("latex"), F.lit("$"))))
        .when(kind.isin("text", "rcdata"), F.when(in_nested, T.strip(words)).otherwise(words))
        .when(in_nested, none)
        .when(opens & is_heading, F.concat(F.repeat(F.lit("#"), F.coalesce(level, F.lit(1))), F.lit(" ")))
        .when(tag == "br", F.when(F.col("quotes") > 0, "  \n> ").otherwise("  \n"))
        .when(tag == "hr", "* * *")
        .when(opens & (tag == "blockquote"), "> ")
        .when(tagged & emphasis.isNotNull(), emphasis)
        .when(tagged & tag.isin(CODE), "`")
        .when(tagged & (tag == "q"), '"')
        .when(closes & (tag == "a") & href.isNotNull(), link_end)
        .when(opens & (tag == "a") & automatic, "<")
        .when((tag == "img") & (kind == "empty"), F.coalesce(image, none))
        .when(closes & tag.isin(LISTS) & outermost, "\n")
        .when(opens & (tag == "li"), item)
        .when(opens & (tag == "dd"), "    ")
        .when(opens & (tag == "pre"), clean(fence(F.col("markup"))))
        .otherwise(none))
    post = (
        F.when(F.col("latex").isNotNull(), F.when(F.col("is_block"), PARAGRAPH).otherwise(""))
        .when(in_nested, SPACE)
        .when((tag == "hr") | (tag == "pre"), PARAGRAPH)
        .when(opens & tag.isin("blockquote", "li"), START)
        .otherwise(none))
    depth = F.when(opens & (tag == "blockquote"), F.col("quotes") - 1).otherwise(F.col("quotes")).cast("int")
    gap = F.when(opens & (tag == "blockquote"), "").otherwise(" ")
    rows = rows.withColumn("_data", data)
    data = F.col("_data")
    quoted = F.when(
        (depth > 0) & (data != ""), F.concat(F.lit(QUOTE), F.repeat(F.lit(">"), depth), gap, F.lit(UNQUOTE))).otherwise("")
    silent = ~F.col("in_body") | F.col("in_formula") | F.col("in_pre") | ((F.col("heads") > 0) & F.col("latex").isNull())
    md = F.when(silent, "").otherwise(F.concat(pre, quoted, data, post))
    definition = F.when(
        F.col("in_body") & opens & (tag == "abbr") & attr("title").isNotNull(),
        F.concat(F.lit("  *["), T.collapse(F.col("text")), F.lit("]: "), attr("title")))
    return rows.withColumns({"md": md, "definition": definition}).drop("_data", "words")


def table_pieces(grid: Column) -> Column:
    """Cell separators, and the rule under the first row, as array<struct<pos, sub, md>>."""
    def separators(n: Column) -> Column:
        return F.repeat(F.lit("| "), n)

    def row(r: Column, n: Column) -> Column:
        # Runs to columns: each cell that is not filled, with the number of columns before it.
        placed = F.aggregate(r["cells"], F.struct(F.lit(0).alias("j"), F.array().cast("array<struct<j:int,pos:int>>").alias("own")), lambda acc, c: F.struct(
            (acc["j"] + c["n"]).alias("j"), F.when(c["filled"], acc["own"]).otherwise(
                F.concat(acc["own"], F.array(F.struct(acc["j"].alias("j"), c["pos"].cast("int").alias("pos"))))).alias("own")))
        indexed, width = placed["own"], placed["j"]
        # A real cell is preceded by one separator per column since the real cell before it.
        starts = F.transform(indexed, lambda c, m: F.struct(
            c["pos"].alias("pos"), F.lit(0).alias("sub"),
            separators(c["j"] - F.coalesce(F.get(F.transform(indexed, lambda d: d["j"]), m - 1), F.lit(0))).alias("md")))
        last = F.coalesce(F.element_at(F.transform(indexed, lambda d: d["j"]), -1), F.lit(0))
        is_first = (n == 0) | (F.get(grid, n - 1)["table_pos"] != r["table_pos"])
        rule = F.when(is_first & (width > 0), F.concat(F.lit(ROW), F.array_join(F.array_repeat(F.lit("---"), width), "|"))).otherwise("")
        # A row that was never closed ends where the next one starts.
        following = F.get(grid, n + 1)
        early = F.coalesce((following["table_pos"] == r["table_pos"]) & (following["tr"] < r["row_end"]), F.lit(False))
        end = F.array(F.struct(
            F.when(early, following["tr"]).otherwise(r["row_end"]).alias("pos"), F.lit(0).alias("sub"),
            F.concat(separators(F.greatest(width - 1 - last, F.lit(0))), rule, F.when(early, ROW).otherwise("")).alias("md")))
        return F.concat(F.when(F.size(indexed) > 0, starts).otherwise(F.slice(starts, 1, 0)), F.when(
            r["row_end"].isNotNull() & (width > 0), end).otherwise(F.slice(end, 1, 0)))

    return F.filter(F.flatten(F.transform(grid, row)), lambda p: p["md"] != "")


def settle(text: Column) -> Column:
    """Turn the markers of a page into breaks and spaces."""
    t = F.regexp_replace(text, f"{ANCHOR}([{PARAGRAPH}{LINE}{ROW}]*+)", "$1[")
    t = F.regexp_replace(t, f"({START}){_BREAKS}*+", "$1")
    t = F.regexp_replace(t, START, "")
    quote = f"({QUOTE}[^{UNQUOTE}]*+{UNQUOTE})?"
    some = f"(?={_BREAKS})"  # a cheap test first: most characters are no markers
    # A paragraph break is two line ends, the others one; after a table row line ends carry two spaces.
    row_paragraph = f"{some}(?=[{LINE}{SPACE}{ROW}]*+{PARAGRAPH})(?=[{LINE}{SPACE}{PARAGRAPH}]*+{ROW}){_BREAKS}++{quote}"
    t = F.regexp_replace(t, row_paragraph, "  \n$1  \n$1")
    t = F.regexp_replace(t, f"{some}(?=[{LINE}{SPACE}]*+{PARAGRAPH}){_BREAKS}++{quote}", "\n$1\n$1")
    t = F.regexp_replace(t, f"{some}(?=[{LINE}{SPACE}]*+{ROW}){_BREAKS}++{quote}", "  \n$1")
    t = F.regexp_replace(t, f"{some}(?={SPACE}*+{LINE}){_BREAKS}++{quote}", "\n$1")
    t = F.regexp_replace(t, f"\n{SPACE}++", "\n")
    t = F.regexp_replace(t, f"{SPACE}++", " ")
    # Quote prefixes stand where a line starts; elsewhere they vanish.
    t = F.regexp_replace(t, f"(?<=\n){QUOTE}([^{UNQUOTE}]*+){UNQUOTE}", "$1")
    t = F.regexp_replace(t, f"{QUOTE}[^{UNQUOTE}]*+{UNQUOTE}", "")
    return T.strip(t)

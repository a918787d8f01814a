"""Code blocks: language hints and verbatim text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions import markup as M
from pageloom.operators.tokens import nodes

# Class names taken as a language when no language- or lang- class is there.
LANGUAGES = [
    "python", "javascript", "typescript", "java", "c", "cpp", "csharp",
    "go", "rust", "ruby", "php", "swift", "kotlin", "scala", "html",
    "css", "sql", "bash", "shell", "json", "xml", "yaml", "toml",
    "markdown", "r", "matlab", "perl", "lua", "haskell", "elixir",
]
PRE = ["pre"]


def code_tag(markup: Column) -> Column:
    """Start tag of the first <code> in a <pre>, '' without one."""
    return F.regexp_extract(markup, M.CODE_TAG, 0)


def code_lang(tag: Column) -> Column:
    """Language of a code tag from its classes, null when none is named."""
    classes = M.classes(M.tag_attribute(tag, "class"))
    # A prefixed class comes first wherever it stands, then the first known name.
    hints = F.transform(classes, lambda c: F.when(c.rlike("^lang(?:uage)?-"), F.struct(
        F.lit(0).alias("order"), F.regexp_replace(c, "^lang(?:uage)?-", "").alias("lang"))).when(
        F.lower(c).isin(LANGUAGES), F.struct(F.lit(1).alias("order"), F.lower(c).alias("lang"))))
    best = F.array_sort(F.filter(F.transform(hints, lambda h, i: F.when(
        h["lang"] != "", F.struct(h["order"].alias("order"), i.alias("i"), h["lang"].alias("lang")))), lambda h: h.isNotNull()))
    return F.when(tag != "", F.get(best, 0)["lang"])


def verbatim(markup: Column) -> Column:
    """All text of a fragment exactly as written, character references decoded."""
    return F.array_join(M.texts(M.split_tokens(markup)), "")


def fence(markup: Column) -> Column:
    """A <pre> as a fenced block; languages that are not one word give a bare fence."""
    lang = F.regexp_extract(F.coalesce(code_lang(code_tag(markup)), F.lit("")), r"^(\w+)$", 1)
    body = F.regexp_replace(F.regexp_replace(verbatim(markup), r"^\r?\n", ""), r"[\r\n]++\z", "")
    return F.concat(F.lit("```"), lang, F.lit("\n"), body, F.lit("\n```"))


def code_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, n, lang, code, lines): the <pre><code> blocks of each page, numbered from 1."""
    rows = nodes(pages, markup_of=PRE).filter(F.col("markup").isNotNull() & (code_tag(F.col("markup")) != ""))
    code = F.regexp_replace(verbatim(F.col("markup")), r"[\r\n]++\z", "")
    found = rows.select("page_id", "pos", code_lang(code_tag(F.col("markup"))).alias("lang"), code.alias("code"))
    numbered = found.withColumn("n", F.row_number().over(Window.partitionBy("page_id").orderBy("pos")))
    lines = F.regexp_count("code", F.lit("\n")) + 1
    return numbered.select("page_id", "n", "lang", "code", lines.alias("lines"))


def language_counts(pages: DataFrame) -> DataFrame:
    return code_blocks(pages).groupBy(F.coalesce("lang", F.lit("")).alias("lang")).agg(
        F.count("*").alias("blocks"), F.sum("lines").alias("lines"))

"""The token table of a page corpus and its element structure.

``raw_tokens`` is a plain scan -> explode: no shuffle. ``nodes`` adds the element tree (mate, parent, sibling
number). Which end tag closes which element, with unclosed and stray tags, is the work of a stack; no fixed
number of window passes gives it, so one small Arrow-batched function turns each page's tag names (not its
markup) into position arrays. Everything else stays in built-in expressions.

Token arrays are hash-partitioned by ``page_id`` *before* the explode: an array is about a third of the size of
its exploded rows, and every window or grouping per page afterwards finds its partitioning in place, so there
is one exchange however many of them follow. Script and style bodies nobody reads are dropped before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions import markup as M
from pageloom.functions import text as T
from pageloom.operators.balance import balance_pages

def raw_tokens(pages: DataFrame) -> DataFrame:
    """(page_id, pos, kind, tag, tok): every token as written, in order. Narrow: no shuffle."""
    tokens = pages.select("page_id", F.posexplode(M.split_tokens(F.col("html"))).alias("pos", "tok"))
    return tokens.select("page_id", "pos", M.kind(F.col("tok")).alias("kind"), M.tag_name(F.col("tok")).alias("tag"), "tok")


def tag_tokens(pages: DataFrame, pattern: str, *keep: str) -> DataFrame:
    """Tokens matching a pattern, with their attributes: (page_id, pos, kind, tag, tok, attrs).

    The others never leave the token array. Narrow, and a page without a match keeps one row of nulls. A token is one
    tag (with its body for scripts and the like), whatever its quoted values hold, so patterns may look at all of it: what
    they let through too much is decided by the attributes.
    """
    found = F.filter(
        F.transform(M.split_tokens(F.col("html")), lambda t, i: F.struct(i.alias("pos"), t.alias("tok"))),
        lambda s: s["tok"].rlike(pattern),
    )
    tokens = pages.select("page_id", *keep, F.explode_outer(found).alias("t")).select("page_id", *keep, "t.pos", "t.tok")
    start = F.regexp_extract(F.col("tok"), M.START_TAG, 0)
    return tokens.select(
        "page_id", *keep, "pos", M.kind(F.col("tok")).alias("kind"), M.tag_name(F.col("tok")).alias("tag"), "tok",
        M.attributes(start).alias("attrs"))


def _mark(kind: Column, name: Column, text: Column) -> Column:
    return (
        F.when(kind == "text", F.when(text == "", "").otherwise("#"))
        .when(kind == "open", name)
        .when(kind == "close", F.concat(F.lit("/"), name))
        .when(kind == "rcdata", F.concat(name, F.when(text == "", "!!").otherwise("!")))
        .when(kind.isin("empty", "raw"), F.concat(name, F.lit("!!")))
        .otherwise("")
    )


def node_arrays(pages: DataFrame, *keep: str) -> DataFrame:
    """One row per page: tokens, their kinds and names, visible texts, and the position arrays of the tree."""
    split = pages.select("page_id", *keep, M.split_tokens(F.col("html")).alias("toks"))
    read = split.select(
        "*", F.transform("toks", M.kind).alias("kinds"), F.transform("toks", M.tag_name).alias("names"),
        F.transform(M.texts(F.col("toks")), lambda t: F.coalesce(T.strip(t), F.lit(""))).alias("all_texts"))
    marks = F.transform("kinds", lambda k, i: _mark(k, F.get("names", i), F.get("all_texts", i)))
    return read.select(
        "page_id", *keep, F.transform("toks", _slim).alias("toks"), "kinds", "names",
        F.filter("all_texts", lambda t: t != "").alias("texts"), balance_pages(marks).alias("tree"),
    ).select("page_id", *keep, "toks", "kinds", "names", "texts", "tree.*")


def _slim(token: Column) -> Column:
    """Empty the bodies no operator reads: comments, styles, scripts other than JSON-LD and TeX."""
    used = token.rlike(r"(?is)^<script[\s/>].*(?:ld\+json|math/tex)")
    return (
        F.when(token.startswith("<!--"), "<!---->")
        .when(token.rlike(r"(?i)^<style[\s/>]"), "<style></style>")
        .when(token.rlike(r"(?i)^<script[\s/>]") & ~used, "<script></script>").otherwise(token))


def _name_at(position: Column) -> Column:
    return F.get("names", F.get("src", position))


def _texts_inside(start: Column, separator: str, limit: Column | int | None) -> Column:
    begin = F.get("seen", start)
    count = F.get("seen", F.get("mate", start)) - begin
    count = count if limit is None else F.least(count, F.lit(limit) if isinstance(limit, int) else limit)
    return F.array_join(F.slice("texts", begin + 1, count), separator)


def _markup(start: Column) -> Column:
    """Balanced source of an element; end tags repeat the attributes of their start tag."""
    def piece(at: Column) -> Column:
        opener = F.get("mate", at)
        start_tag = F.get("toks", F.get("src", opener))
        return F.when((opener >= 0) & (opener < at), F.concat(F.lit("</"), F.substring(start_tag, F.lit(2), F.char_length(start_tag)))).otherwise(
            F.get("toks", F.get("src", at)))

    return F.array_join(F.transform(F.sequence(start, F.get("mate", start)), piece), "")


def nodes(
    pages: DataFrame,
    *keep: str,
    text_of: dict[str, int | str | None] | None = None,
    separator: str = "",
    markup_of: list[str] | None = None,
    markup_class: str | None = None,
    parents: bool = False,
) -> DataFrame:
    """Balanced tokens: (page_id, pos, src, kind, tag, tok, mate, parent, nth, ...).

    Every ``open`` row has its ``close`` row; a close row carries its element's start tag in ``tok``. ``nth``
    numbers same-named siblings from 1. A page without tokens keeps one row with null ``pos``.

    text_of        tag name -> most text nodes to join (None: all, "tag": as many as its start tag has characters); fills ``text`` on start rows (links: on
                   end rows too), every node stripped, empty ones dropped, joined by ``separator``
    markup_of      tag names; fills ``markup`` on start rows with the element's balanced source
    markup_class   does the same for elements with a class containing this word
    parents        fills ``parent_tok`` on img and li rows and ``parent_text`` on img rows
    """
    arrays = node_arrays(pages, *keep).repartition(F.col("page_id"))

    def item(src: Column, i: Column) -> Column:
        mate = F.get("mate", i)
        closing = (mate >= 0) & (mate < i)
        at = F.when(closing, F.get("src", mate)).otherwise(src)
        tok = F.get("toks", at)
        written = F.get("kinds", at)
        kind = F.when(mate > i, "open").when(closing, "close").when(written == "open", "empty").otherwise(written)
        fields = [
            kind.alias("kind"), F.get("names", at).alias("tag"),
            i.alias("pos"), src.alias("src"), mate.alias("mate"), F.get("parent", i).alias("parent"),
            F.get("nth", i).alias("nth"), tok.alias("tok"),
        ]
        name = F.get("names", at)
        if text_of:
            text = F.lit(None).cast("string")
            for limit in sorted(set(text_of.values()), key=str):
                wanted = (mate >= 0) & name.isin([t for t, n in text_of.items() if n == limit]) & (~closing | (name == "a"))
                text = F.when(wanted, _texts_inside(F.least(i, mate), separator, F.char_length(tok) if limit == "tag" else limit)).otherwise(text)
            fields.append(text.alias("text"))
        if markup_of or markup_class:
            wanted = name.isin(markup_of or [])
            if markup_class:
                wanted = wanted | (tok.contains(markup_class) & tok.rlike(rf"""(?is)^<[a-z].*[\s"']class\s*=\s*(?:"[^"]*|'[^']*|[^\s"'>]*){markup_class}"""))
            fields.append(F.when((mate > i) & wanted, _markup(i)).alias("markup"))
        if parents:
            up = F.get("parent", i)
            is_img = (name == "img") & (up >= 0)
            fields.append(F.when(is_img | ((name == "li") & (up >= 0)), F.get("toks", F.get("src", up))).alias("parent_tok"))
            # A text node has at least one character, so this many nodes tell whether the text is short.
            fields.append(F.when(is_img, _texts_inside(up, "", F.char_length(tok) + 5)).alias("parent_text"))
        return F.struct(*fields)

    return arrays.select("page_id", *keep, F.inline_outer(F.transform("src", item)))


# Start tags whose attributes some operator reads; a token ends with its tag, quoted '>' included.
READ_ATTRIBUTES = (
    r"(?is)^<(?:a|abbr|html|img|link|math|meta|mjx-container|source|time)[\s/>]|^<script[\s/>].*(?:ld\+json|math/tex)"
    r"|^<t[dh][\s/].*span|^<div[\s/].*(?:content|main|article|post-body)|^<[a-z].*(?:katex|\bstyle\s*=)")


def with_attrs(rows: DataFrame) -> DataFrame:
    """Add ``attrs`` on rows of ``READ_ATTRIBUTES``: array<struct<name, value>>, end rows like their start rows."""
    start = F.regexp_extract("tok", M.START_TAG, 0)
    return rows.withColumn("attrs", F.when(F.col("tok").rlike(READ_ATTRIBUTES), M.attributes(start)))


def doc_order():
    """Rows of a page in document order, up to the current one."""
    return Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)


def inside(condition: Column) -> Column:
    """How many elements meeting ``condition`` are open at a row (start and end rows of one included)."""
    step = F.when(condition & (F.col("kind") == "open"), 1).when(condition & (F.col("kind") == "close"), -1).otherwise(0)
    # An end row still counts as inside its own element.
    return F.sum(step).over(doc_order()) - F.least(step, F.lit(0))


def element_spans(pages: DataFrame, tags: list[str]) -> DataFrame:
    """(page_id, tag, start_pos, end_pos, depth): depth counts enclosing namesakes, 1 = outermost."""
    marked = nodes(pages).filter(F.col("tag").isin(tags) & F.col("kind").isin("open", "close"))
    per_name = Window.partitionBy("page_id", "tag").orderBy("pos")
    return marked.withColumn("depth", F.sum(F.when(F.col("kind") == "open", 1).otherwise(-1)).over(per_name)).filter(
        F.col("kind") == "open").select("page_id", "tag", F.col("pos").alias("start_pos"), F.col("mate").alias("end_pos"), "depth")


def element_text(pages: DataFrame, tags: list[str], separator: str = "") -> DataFrame:
    """(page_id, tag, pos, text) of every element with one of these names; title comes from its rcdata token."""
    rows = nodes(pages, text_of=dict.fromkeys(tags), separator=separator)
    rows = rows.filter(F.col("tag").isin(tags) & F.col("kind").isin("open", "rcdata"))
    own = T.strip(M.token_text(F.col("kind"), F.col("tok")))
    return rows.select("page_id", "tag", "pos", F.when(F.col("kind") == "rcdata", own).otherwise(F.col("text")).alias("text"))


def attribute_rows(pages: DataFrame, tags: list[str]) -> DataFrame:
    """(page_id, pos, tag, name, value): attributes of start tags, the last duplicate kept."""
    rows = tag_tokens(pages, rf"(?i)^<(?:{'|'.join(tags)})[\s/>]")
    each = rows.select("page_id", "pos", "tag", F.posexplode("attrs").alias("n", "a"))
    return each.groupBy("page_id", "pos", "tag", F.col("a.name").alias("name")).agg(F.max_by("a.value", "n").alias("value"))


def visible(rows: DataFrame) -> DataFrame:
    """Node rows without scripts, styles, comments, declarations and noscript content."""
    hidden = inside(F.col("tag") == "noscript")
    return rows.withColumn("_hidden", hidden).filter(
        F.col("pos").isNull() | ((F.col("_hidden") == 0) & ~F.col("kind").isin("raw", "comment", "declaration"))
    ).drop("_hidden")


def plaintext(pages: DataFrame) -> DataFrame:
    """(page_id, plaintext): visible text nodes, stripped, one per line. Pages without text give ''."""
    # Hidden rows stay in: a page of nothing else is still a page.
    shown = ~F.col("kind").isin("raw", "comment", "declaration") & (inside(F.col("tag") == "noscript") == 0)
    rows = nodes(pages).withColumn("shown", shown)
    rows = rows.select("page_id", "pos", F.when(F.col("shown"), T.strip(M.token_text(F.col("kind"), F.col("tok")))).alias("t"))
    return rows.groupBy("page_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("t") != "", F.struct("pos", "t")))).alias("ts")
    ).select("page_id", F.array_join("ts.t", "\n").alias("plaintext"))

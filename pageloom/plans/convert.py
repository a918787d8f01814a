"""Pages to Markdown documents in one pass.

Scan -> token arrays -> one exchange by page -> node rows -> windows in document order -> one aggregation per
page -> document. Metadata, formulas, tables, code, images and text all ride on the same rows, so the pages are
read and tokenised once and shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions import markup as M
from pageloom.functions import text as T
from pageloom.functions import urls as U
from pageloom.operators import code, extract, images, mathml, render, staged, tables
from pageloom.operators import metadata as meta
from pageloom.operators.tokens import nodes, with_attrs

LAYOUTS = ("site", "single")


def with_targets(pages: DataFrame, layout: str = "site") -> DataFrame:
    """Add the normalised URL and the path of the Markdown file; ``url`` becomes the one shown in the document.

    site    normalised URL, file below a folder per site
    single  URL as given, file named after the last path segment
    """
    if layout not in LAYOUTS:
        raise ValueError(f"layout must be one of {LAYOUTS}")
    given = U.ensure_scheme(F.col("url"))
    placed = staged(pages, url=given, norm_url=U.normalize_url(given))
    path = U.site_file_path(F.col("norm_url")) if layout == "site" else U.page_file_path(F.col("norm_url"))
    placed = staged(placed, file_path=path)
    return placed.withColumn("url", F.col("norm_url")) if layout == "site" else placed


def markdown_rows(pages: DataFrame, extractor: str = "heuristic", local_images: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """Node rows of pages (page_id, url, file_path, html) with their Markdown pieces and page facts.

    ``carry`` names further page columns; like the URL they stay on the first row of a page only.
    """
    # The text of a link is only compared with its address, which its start tag holds.
    rows = nodes(
        pages, "url", "file_path", *carry, text_of={**images.HEADING_TEXT, "a": "tag", "abbr": None},
        markup_of=mathml.FORMULA_TAGS + code.PRE, markup_class=mathml.FORMULA_CLASS, parents=True)
    is_image = F.col("tok").rlike(images.IMAGE_TOKENS) & F.col("kind").isin("open", "empty")
    first = F.coalesce(F.col("pos") == 0, F.lit(True))
    facts = first | F.coalesce(is_image, F.lit(False))
    rows = rows.withColumns({
        **{c: F.when(first, F.col(c)) for c in carry},
        "has_image": F.coalesce(is_image, F.lit(False)),
        "url": F.when(facts, F.col("url")), "file_path": F.when(facts, F.col("file_path"))})
    rows = mathml.with_formulas(with_attrs(rows))
    # Windows cost a pass over the rows each; those asked for together share one.
    rows = rows.withColumns({
        "shown": extract.is_shown(), "in_formula": mathml.in_formula(), "heading": images.nearest_heading()})
    rows = rows.withColumn("latex", F.when(~F.col("in_formula"), F.col("latex")))
    dense = extract.dense_blocks(pages) if extractor == "density" else None
    rows = extract.with_region(rows, extractor, dense)
    in_region = F.col("pos").between(F.col("region.start"), F.col("region.end"))
    kept = F.col("shown") | (F.col("latex").isNotNull() & (F.col("kind") == "raw"))
    rows = rows.withColumn("in_body", F.coalesce(in_region & kept, F.lit(False))).drop("region")
    image_md = None
    if local_images:
        refs = F.when(F.col("has_image"), images.localized(images.image_refs(F.col("tag"), F.col("attrs")), F.col("url"), F.col("file_path")))
        rows = rows.withColumn("refs", refs)
        rows = rows.withColumn("alt", F.when(F.col("has_image"), T.strip(M.attribute(F.col("attrs"), "alt"))))
        rel = F.get(F.filter("refs", lambda r: r["via"] == "src"), 0)["rel_path"]
        rows = rows.withColumn("src_rel", F.when(F.col("tag") == "img", rel))
        image_md = images.md_image(images.image_alt(F.col("alt"), F.col("src_rel")), F.col("src_rel"))
    return render.with_markdown(render.with_context(rows), image_md)


def _page_images(pages: DataFrame) -> DataFrame:
    """Reduce ``image_rows`` to ``places``: the images of a page, each once, in document order."""
    flat = F.flatten(F.transform("image_rows", lambda im: F.transform(im["refs"], lambda r: F.struct(
        r["url"].alias("url"), (r["via"] != "src").alias("indirect"), im["pos"].alias("pos"), r["rel_path"].alias("rel_path"),
        F.when(r["via"] == "src", im["alt"]).alias("alt"), F.when(r["via"] == "src", im["heading"]).alias("heading")))))
    pages = staged(pages, found=F.array_sort(flat))
    once = F.filter("found", lambda x, i: (i == 0) | (F.get("found", i - 1)["url"] != x["url"]))
    places = F.transform(once, lambda x: F.struct(
        x["pos"].alias("pos"), x["url"].alias("url"), x["rel_path"].alias("rel_path"),
        images.md_image(images.image_alt(x["alt"], x["rel_path"]), x["rel_path"]).alias("md_img"),
        F.coalesce(x["heading"], F.lit("")).alias("heading")))
    return staged(pages, places=F.array_sort(places)).drop("found", "image_rows")


def place_images(body: Column, places: Column) -> Column:
    """Put images the body lacks behind their heading, or at the end.

    Behind the first occurrence of the heading's first 40 characters that has no image in the next 200.
    """
    def place(text: Column, im: Column) -> Column:
        needle = F.concat(F.lit(r"\Q"), F.replace(F.left(im["heading"], F.lit(40)), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
        head = F.coalesce(F.regexp_substr(text, F.concat(F.lit("(?s)^.*?"), needle, F.lit(r"(?!.{0,198}!\[)"))), F.lit(""))
        at = F.when(F.char_length(im["heading"]) > 5, F.char_length(head)).otherwise(0)
        image = F.concat(F.lit("\n\n"), im["md_img"])
        return (
            F.when(text.contains(im["rel_path"]), text)
            .when(at > 0, F.concat(F.left(text, at), image, F.lit("\n\n"), F.substring(text, at + 1, F.char_length(text))))
            .otherwise(F.concat(text, image)))

    return F.when(F.size(places) > 0, F.aggregate(places, body, place)).otherwise(body)


def page_bodies(
    pages: DataFrame, extractor: str = "heuristic", local_images: bool = True, carry: tuple[str, ...] = (), plain: bool = False,
) -> DataFrame:
    """(page_id, url, file_path, metadata fields, html_title, body) from pages (page_id, url, file_path, html).

    ``carry`` columns come along; ``plain`` adds ``plaintext``, the visible text of the whole page.
    """
    rows = meta.with_head_columns(markdown_rows(pages, extractor, local_images, carry))
    visible = []
    if plain:
        rows = rows.withColumn("_t", F.when(F.col("shown"), T.strip(M.token_text(F.col("kind"), F.col("tok")))))
        visible = [F.array_sort(F.collect_list(F.when(F.col("_t") != "", F.struct("pos", F.col("_t").alias("t"))))).alias("visible")]
    empty = F.array().cast("array<struct<pos:int,alt:string,heading:string,refs:array<struct<via:string,url:string,rel_path:string>>>>")
    image_row = F.struct("pos", "alt", "heading", "refs") if local_images else None
    wanted = F.col("has_image") & F.col("latex").isNull()
    found = rows.groupBy("page_id").agg(
        F.max("url").alias("url"), F.max("file_path").alias("file_path"),
        F.collect_list(F.when(F.col("md") != "", F.struct("pos", F.lit(1).alias("sub"), "md"))).alias("pieces"),
        F.sort_array(F.collect_list(F.when(F.col("in_body"), F.col("entry")))).alias("entries"),
        F.array_sort(F.collect_list(F.when(F.col("definition").isNotNull(), F.struct("pos", "definition")))).alias("definitions"),
        (F.collect_list(F.when(wanted, image_row)) if local_images else F.first(empty)).alias("image_rows"),
        *[F.max(c).alias(c) for c in carry], *visible, *meta.metadata_aggregates())
    found = _page_images(tables.with_grid(found))
    text = F.array_join(F.transform(
        F.array_sort(F.concat("pieces", render.table_pieces(F.col("grid")))), lambda p: p["md"]), "")
    found = staged(found.withColumn("text", text).drop("pieces", "grid"), text=render.settle(F.col("text")))
    defined = F.array_join(F.array_distinct(F.transform("definitions", lambda d: d["definition"])), "\n")
    noted = F.when(F.size("definitions") > 0, T.strip(F.concat("text", F.lit("\n"), defined))).otherwise(F.col("text"))
    found = staged(found.withColumn("text", noted), body=place_images(F.col("text"), F.col("places")))
    found = found.withColumn("keywords", meta.keyword_list(F.col("keyword_line")))
    extra = [F.array_join("visible.t", "\n").alias("plaintext")] if plain else []
    return found.select("page_id", "url", "file_path", *carry, *meta.FIELDS, "html_title", "body", *extra)


def document(bodies: DataFrame, metadata: bool = True) -> DataFrame:
    """(page_id, url, file_path, content, word_count, estimated_tokens): front matter, title, source line, body."""
    sized = bodies.withColumn("word_count", T.word_count(F.col("body")))
    sized = sized.withColumn("estimated_tokens", T.token_estimate(F.col("word_count")))
    title = F.coalesce("title", "html_title") if metadata else F.col("html_title")
    front = meta.front_matter(
        {k: F.col(k) for k in meta.FIELDS}, F.col("url"), F.col("word_count"), F.col("estimated_tokens"), F.col("html_title"))
    has_title = F.regexp_replace("body", rf"^[{T.WS}]+", "").startswith("# ")
    parts = F.concat_ws(
        "\n\n", front if metadata else F.lit(None).cast("string"),
        F.when(title.isNotNull() & ~has_title, F.concat(F.lit("# "), title)),
        F.concat(F.lit("> Source: <"), F.col("url"), F.lit(">")), F.lit(""), F.col("body"))
    return sized.select(
        "page_id", "url", "file_path", F.concat(parts, F.lit("\n")).alias("content"), "word_count", "estimated_tokens")


def convert(
    pages: DataFrame, extractor: str = "heuristic", metadata: bool = True, images: bool = True, layout: str = "site",
) -> DataFrame:
    """One Markdown document per page: (page_id, url, file_path, content, word_count, estimated_tokens)."""
    placed = with_targets(pages.select("page_id", "url", "html"), layout)
    return document(page_bodies(placed, extractor, images), metadata)

"""Images of captured pages: where they are, where they go, what stands before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom import session
from pageloom.functions import markup as M
from pageloom.functions import text as T
from pageloom.functions import urls as U
from pageloom.operators import staged
from pageloom.operators.tokens import doc_order, nodes, tag_tokens, with_attrs

IMAGE_TOKENS = r"(?is)^<(?:img|source)[\s/>]|^<[a-z].*[\s\"']style\s*="
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
_BACKGROUND = r"""(?i)background-image:\s*url\(['"]?([^'"()]+)['"]?\)"""


def image_refs(tag: Column, attrs: Column) -> Column:
    """References of one tag as array<struct<via, ref>>: img attributes, srcset candidates, CSS backgrounds."""
    def plain(name: str) -> Column:
        return F.array(F.struct(F.lit(name).alias("via"), F.when(tag == "img", M.attribute(attrs, name)).alias("ref")))

    candidates = F.transform(
        F.split(F.coalesce(F.when(tag.isin("img", "source"), M.attribute(attrs, "srcset")), F.lit("")), ","),
        lambda p: F.struct(F.lit("srcset").alias("via"), F.get(F.split(T.strip(p), f"[{T.WS}]+"), 0).alias("ref")))
    backgrounds = F.transform(
        F.regexp_extract_all(F.coalesce(M.attribute(attrs, "style"), F.lit("")), F.lit(_BACKGROUND), F.lit(1)),
        lambda u: F.struct(F.lit("background").alias("via"), u.alias("ref")))
    found = F.concat(plain("src"), plain("data-src"), plain("data-lazy-src"), plain("data-original"), candidates, backgrounds)
    kept = F.filter(found, lambda r: r["ref"].isNotNull() & (r["ref"] != "") & ~r["ref"].startswith("data:"))
    return F.transform(kept, lambda r: F.struct(r["via"].alias("via"), T.strip(r["ref"]).alias("ref")))


def image_candidates(pages: DataFrame) -> DataFrame:
    """(page_id, pos, via, url): every image reference, resolved. Narrow: no shuffle."""
    rows = tag_tokens(pages, IMAGE_TOKENS, "url").filter(F.col("kind").isin("open", "empty"))
    refs = rows.select("page_id", "pos", F.col("url").alias("page_url"), F.inline(image_refs(F.col("tag"), F.col("attrs"))))
    return staged(refs, url=U.url_join(F.col("page_url"), F.col("ref"))).select("page_id", "pos", "via", "url")


def image_set(pages: DataFrame) -> DataFrame:
    """(page_id, url): the distinct images of each page."""
    return image_candidates(pages).select("page_id", "url").distinct()


def image_manifest(pages: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(url, path, status, collides): each image of the corpus once; ``existing`` has a ``path`` column.

    What is known of a path is one row, combined before any shuffle. Only paths that collide or exist are joined back to
    the URLs, both sides written first, so that a path of very many URLs is split over tasks by AQE.
    """
    spark = pages.sparkSession
    urls = image_candidates(pages).select("url").distinct()
    placed = session.write_through(staged(urls, path=U.image_path(F.col("url"))), session.new_folder(spark, "images"))
    facts = placed.groupBy("path").agg((F.count("*") > 1).alias("collides"))
    if existing is None:
        facts = facts.withColumn("stored", F.lit(False))
    else:
        stored = existing.select("path").distinct().withColumn("stored", F.lit(True))
        facts = facts.join(stored, "path", "left").fillna({"stored": False})
    known = session.write_through(facts.filter("collides or stored"), session.new_folder(spark, "image-paths"))
    out = placed.join(known, "path", "left")
    status = F.when(F.coalesce("stored", F.lit(False)), "exists").otherwise("to fetch")
    return out.select("url", "path", status.alias("status"), F.coalesce("collides", F.lit(False)).alias("collides"))


def manifest_counts(manifest: DataFrame) -> DataFrame:
    return manifest.agg(
        F.count("*").alias("images"), F.count_if(F.col("status") == "to fetch").alias("to_fetch"),
        F.count_if(F.col("status") == "exists").alias("existing"), F.count_if("collides").alias("collisions"))


def nearest_heading() -> Column:
    """The nearest heading starting before a row, else the beginning of the nearest paragraph.

    An as-of lookup: the last qualifying text in document order, over nodes with heading and p text.
    """
    opens, length = F.col("kind") == "open", F.char_length("text")
    title = F.when(opens & F.col("tag").isin(HEADINGS) & (length > 3), F.col("text"))
    paragraph = F.when(opens & (F.col("tag") == "p") & (length > 20), F.left("text", F.lit(60)))
    before = doc_order().rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.last(title, True).over(before), F.last(paragraph, True).over(before), F.lit(""))


# Of a paragraph only the first 60 characters count, and a text node has at least one.
HEADING_TEXT = {**dict.fromkeys(HEADINGS), "p": 61}


def images(pages: DataFrame, file_path: Column | None = None) -> DataFrame:
    """(page_id, pos, url, rel_path, alt, heading, md_img): each image of a page once, first occurrence.

    ``rel_path`` leads from the page's Markdown file to the image. Alt text and heading belong to the img whose
    ``src`` is the image; other references get their file name as alt text and no heading.
    """
    placed = staged(pages.select("page_id", "url", "html"), norm_url=U.normalize_url(F.col("url")))
    placed = staged(placed, file_path=U.site_file_path(F.col("norm_url")) if file_path is None else file_path)
    rows = nodes(placed, "url", "file_path", text_of=HEADING_TEXT).withColumn("heading", nearest_heading())
    rows = rows.filter(F.col("tok").rlike(IMAGE_TOKENS) & F.col("kind").isin("open", "empty"))
    rows = with_attrs(rows)
    each = rows.select(
        "page_id", "pos", F.col("url").alias("page_url"), "file_path", "heading",
        T.strip(M.attribute(F.col("attrs"), "alt")).alias("alt"), F.inline(image_refs(F.col("tag"), F.col("attrs"))))
    each = staged(each, url=U.url_join(F.col("page_url"), F.col("ref")))
    is_src = F.col("via") == "src"
    once = each.groupBy("page_id", "url").agg(
        F.min("pos").alias("pos"), F.first("file_path").alias("file_path"),
        F.min_by("alt", F.when(is_src, F.col("pos"))).alias("alt"),
        F.coalesce(F.min_by("heading", F.when(is_src, F.col("pos"))), F.lit("")).alias("heading"))
    once = staged(once, target=image_target(F.col("url"), F.col("file_path")))
    once = staged(once, rel_path=U.relative_path(F.col("target"), F.col("file_path")))
    alt = image_alt(F.col("alt"), F.col("rel_path"))
    return once.select(
        "page_id", "pos", "url", "rel_path", alt.alias("alt"), "heading", md_image(alt, F.col("rel_path")).alias("md_img"))


def image_target(url: Column, file_path: Column) -> Column:
    """Where an image is stored: in the folder of the site its page belongs to."""
    root = F.when(F.instr(file_path, "/") > 0, F.concat(F.substring_index(file_path, "/", 1), F.lit("/"))).otherwise("")
    return F.concat(root, U.image_path(url))


def localized(refs: Column, page_url: Column, file_path: Column) -> Column:
    """``image_refs`` resolved: array<struct<via, url, rel_path>>."""
    # One step per transform: each binds its result, so no step's expression is repeated in the next.
    urls = F.transform(refs, lambda r: F.struct(r["via"].alias("via"), U.url_join(page_url, r["ref"]).alias("url")))
    targets = F.transform(urls, lambda r: F.struct(
        r["via"].alias("via"), r["url"].alias("url"), image_target(r["url"], file_path).alias("target")))
    return F.transform(targets, lambda r: F.struct(
        r["via"].alias("via"), r["url"].alias("url"), U.relative_path(r["target"], file_path).alias("rel_path")))


def image_alt(alt: Column, rel_path: Column) -> Column:
    return F.coalesce(F.nullif(alt, F.lit("")), U.base_name_words(rel_path))


def md_image(alt: Column, target: Column) -> Column:
    return F.concat(F.lit("!["), alt, F.lit("]("), target, F.lit(")"))

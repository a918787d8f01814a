"""Page metadata: one conditional aggregation per page over its meta, link, title, time and JSON-LD tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions import markup as M
from pageloom.functions import text as T
from pageloom.operators.tokens import tag_tokens
from pageloom.session import take_last_keys

HEAD_TAGS = r"(?is)^<(?:(?:meta|link|html|time|title)[\s/>]|script[\s/>].*ld\+json)"

# JSON-LD types that describe the page itself.
PAGE_TYPES = ["Article", "BlogPosting", "NewsArticle", "TechArticle", "WebPage", "ScholarlyArticle"]

FIELDS = [
    "title", "description", "author", "published", "modified", "canonical_url", "language", "keywords",
    "site_name", "image", "schema_type",
]


def _attr(name: str) -> Column:
    return M.attribute(F.col("attrs"), name)


def json_ld(tok: Column) -> Column:
    """The parsed payload of a JSON-LD script, the last of repeated keys kept; null when it is not valid JSON."""
    return F.try_parse_json(F.nullif(T.strip(M.raw_content(tok)), F.lit("")))


def is_json_ld() -> Column:
    return (F.col("tag") == "script") & (F.col("kind") == "raw") & (_attr("type") == "application/ld+json")


def _string(v: Column, path: str) -> Column:
    return F.nullif(F.try_variant_get(v, path, "string"), F.lit(""))


def _author(item: Column) -> Column:
    author = F.try_variant_get(item, "$.author", "variant")
    shape = F.schema_of_variant(author)
    listed = F.filter(
        F.transform(
            F.try_variant_get(author, "$", "array<variant>"),
            lambda a: F.when(F.schema_of_variant(a) == "STRING", F.try_variant_get(a, "$", "string"))
            .when(F.schema_of_variant(a).startswith("OBJECT"), _string(a, "$.name"))),
        lambda n: n.isNotNull())
    return (
        F.when(shape == "STRING", F.try_variant_get(author, "$", "string"))
        .when(shape.startswith("OBJECT"), F.try_variant_get(author, "$.name", "string"))
        .when(shape.startswith("ARRAY") & (F.size(listed) > 0), F.array_join(listed, ", ")))


def _described_item(payload: Column) -> Column:
    """The first top-level item of a script with a page type."""
    items = F.coalesce(F.try_variant_get(payload, "$", "array<variant>"), F.array(payload))
    return F.try_element_at(
        F.filter(items, lambda x: F.try_variant_get(x, "$['@type']", "string").isin(PAGE_TYPES)), F.lit(1))


def with_head_columns(rows: DataFrame) -> DataFrame:
    """Add the JSON-LD payload and its described item to token rows with ``attrs``; null on the others."""
    take_last_keys(rows.sparkSession)
    rows = rows.withColumn("payload", F.when(is_json_ld(), json_ld(F.col("tok"))))
    return rows.withColumn("item", F.when(F.col("payload").isNotNull(), _described_item(F.col("payload"))))


def metadata_aggregates() -> list[Column]:
    """The fields of ``FIELDS`` (keywords still one line) and ``html_title`` as aggregates over head rows."""
    pos, tag, item = F.col("pos"), F.col("tag"), F.col("item")
    opening = F.col("kind").isin("open", "empty")

    def first(value: Column, condition: Column) -> Column:
        return F.min_by(value, F.when(condition, pos))

    def named(key: str, value: str) -> Column:
        is_it = opening & (tag == "meta") & (_attr(key) == value)
        return F.nullif(T.strip(first(_attr("content"), is_it)), F.lit(""))

    def from_json_ld(value: Column) -> Column:
        return F.max_by(value, F.when(value.isNotNull(), pos))

    title_text = F.nullif(T.strip(first(
        M.decode_references(M.raw_content(F.col("tok"))), (F.col("kind") == "rcdata") & (tag == "title"))), F.lit(""))
    canonical = F.array_contains(M.classes(_attr("rel")), "canonical")
    return [
        F.coalesce(from_json_ld(_string(item, "$.headline")), named("property", "og:title"),
                   named("name", "twitter:title"), title_text).alias("title"),
        F.coalesce(from_json_ld(_string(item, "$.description")), named("property", "og:description"),
                   named("name", "twitter:description"), named("name", "description")).alias("description"),
        F.coalesce(from_json_ld(_author(item)), named("name", "author"), named("property", "article:author")).alias("author"),
        F.coalesce(from_json_ld(_string(item, "$.datePublished")), named("property", "article:published_time"),
                   named("name", "date"), named("name", "publish_date"),
                   first(_attr("datetime"), opening & (tag == "time") & _attr("datetime").isNotNull())).alias("published"),
        F.coalesce(from_json_ld(_string(item, "$.dateModified")), named("property", "article:modified_time"),
                   named("name", "last-modified")).alias("modified"),
        F.nullif(first(_attr("href"), opening & (tag == "link") & canonical), F.lit("")).alias("canonical_url"),
        F.nullif(first(_attr("lang"), opening & (tag == "html")), F.lit("")).alias("language"),
        named("name", "keywords").alias("keyword_line"),
        named("property", "og:site_name").alias("site_name"),
        named("property", "og:image").alias("image"),
        from_json_ld(_string(item, "$['@type']")).alias("schema_type"),
        title_text.alias("html_title"),
    ]


def keyword_list(line: Column) -> Column:
    keywords = F.filter(F.transform(F.split(line, ","), T.strip), lambda k: k != "")
    return F.when(F.size(keywords) > 0, keywords)


def metadata(pages: DataFrame) -> DataFrame:
    """One row per page with the fields of ``FIELDS``; absent values are null. ``html_title`` is <title>."""
    rows = with_head_columns(tag_tokens(pages, HEAD_TAGS))
    found = rows.groupBy("page_id").agg(*metadata_aggregates())
    return found.withColumn("keywords", keyword_list(F.col("keyword_line"))).select("page_id", *FIELDS, "html_title")


def json_ld_items(pages: DataFrame) -> DataFrame:
    """(page_id, script_no, schema_type, headline, description, author, published, modified) per described script."""
    rows = with_head_columns(tag_tokens(pages, HEAD_TAGS)).filter(F.col("item").isNotNull())
    item = F.col("item")
    return rows.select(
        "page_id", "pos", _string(item, "$['@type']").alias("schema_type"), _string(item, "$.headline").alias("headline"),
        _string(item, "$.description").alias("description"), _author(item).alias("author"),
        _string(item, "$.datePublished").alias("published"), _string(item, "$.dateModified").alias("modified"))


_QUOTED = r"""[:"'\n#\[\]{}]"""


def _scalar_line(key: str, value: Column) -> Column:
    escaped = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    shown = F.when(value.rlike(_QUOTED), F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(value)
    return F.concat(F.lit(f"{key}: "), shown)


def _list_line(key: str, values: Column) -> Column:
    item = F.transform(values, lambda v: F.concat(
        F.lit("  - "), F.when(v.rlike(_QUOTED), F.concat(F.lit('"'), v, F.lit('"'))).otherwise(v)))
    return F.concat(F.lit(f"{key}:\n"), F.array_join(item, "\n"))


def front_matter(
    columns: dict[str, Column], url: Column, word_count: Column, estimated_tokens: Column, fallback_title: Column | None = None
) -> Column:
    """YAML block of the present fields in fixed order; a fallback title follows the other fields."""
    lines = [F.lit("---")]
    for key in FIELDS:
        lines.append(_list_line(key, columns[key]) if key == "keywords" else _scalar_line(key, columns[key]))
    if fallback_title is not None:
        lines.append(F.when(columns["title"].isNull(), _scalar_line("title", fallback_title)))
    lines += [
        _scalar_line("url", url), F.concat(F.lit("word_count: "), word_count.cast("string")),
        F.concat(F.lit("estimated_tokens: "), estimated_tokens.cast("string")), F.lit("---")]
    return F.array_join(F.array(*lines), "\n")


def present_fields(meta: DataFrame) -> DataFrame:
    """(page_id, n, key, value): the present metadata fields in output order; lists joined by '|'."""
    pairs = F.array(*[
        F.struct(F.lit(n).alias("n"), F.lit(key).alias("key"),
                 (F.array_join(key, "|") if key == "keywords" else F.col(key)).alias("value"))
        for n, key in enumerate(FIELDS)])
    return meta.select("page_id", F.inline(F.filter(pairs, lambda p: p["value"].isNotNull())))

"""Links of captured pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions import markup as M
from pageloom.functions import text as T
from pageloom.functions import urls as U
from pageloom.operators import metadata as meta
from pageloom.operators import staged
from pageloom.operators.tokens import tag_tokens
from pageloom.session import take_last_keys

LINK_TOKENS = r"(?is)^<(?:a[\s/>]|[a-z].*[\s\"']data-href|script[\s/>].*ld\+json)"

# JSON-LD keys whose string values are page URLs.
_JSON_URL = r'(?<!\\)"(?:url|@id|mainEntityOfPage|itemListElement)":"(http(?:[^"\\]|\\.)*+)"'


def json_urls(payload: Column) -> Column:
    """URLs below the known keys of a JSON value, at any depth.

    The value is written back as compact JSON first. There an unescaped quote only delimits, so one pattern
    finds the key-value pairs of all levels.
    """
    found = F.regexp_extract_all(F.to_json(payload), F.lit(_JSON_URL), F.lit(1))
    return F.transform(found, lambda u: F.get(F.from_json(F.concat(F.lit('["'), u, F.lit('"]')), "array<string>"), 0))


def link_candidates(pages: DataFrame) -> DataFrame:
    """(page_id, url, via, target): absolute targets before site filtering. Narrow: no shuffle."""
    take_last_keys(pages.sparkSession)
    rows = tag_tokens(pages, LINK_TOKENS, "url")
    started = F.col("kind").isin("open", "empty", "raw", "rcdata")
    href = F.when(started & (F.col("tag") == "a"), M.attribute(F.col("attrs"), "href"))
    data_href = F.when(started, M.attribute(F.col("attrs"), "data-href"))
    payload = F.when(meta.is_json_ld(), meta.json_ld(F.col("tok")))
    refs = F.concat(
        F.array(
            F.struct(F.lit("href").alias("via"), T.strip(href).alias("ref")),
            F.struct(F.lit("data-href").alias("via"), T.strip(data_href).alias("ref"))),
        F.transform(
            F.coalesce(json_urls(payload), F.array().cast("array<string>")),
            lambda u: F.struct(F.lit("json-ld").alias("via"), u.alias("ref"))))
    each = rows.select("page_id", "url", F.inline(F.filter(refs, lambda r: r["ref"].isNotNull() & ~r["ref"].rlike(U.NON_LINK))))
    target = F.when(F.col("via") == "json-ld", F.col("ref")).otherwise(U.url_join(F.col("url"), F.col("ref")))
    return staged(each, target=target).drop("ref")


def links(pages: DataFrame, site: Column | None = None, prefix: str | None = None, via: list[str] | None = None) -> DataFrame:
    """(page_id, url): distinct normalised links of a page to pages of its own site."""
    found = link_candidates(pages)
    if via:
        found = found.filter(F.col("via").isin(via))
    site = U.netloc(F.col("page_url")) if site is None else site
    found = staged(found.withColumnRenamed("url", "page_url"), url=U.normalize_url(F.col("target")))
    return found.filter(U.is_internal(F.col("url"), site, prefix) & ~U.should_skip(F.col("url"))).select("page_id", "url").distinct()


def link_counts(pages: DataFrame, visited: DataFrame | None = None) -> DataFrame:
    """(page_id, found, enqueued): links per page, and those not yet in ``visited(url)``."""
    found = links(pages)
    if visited is None:
        marked = found.withColumn("new", F.lit(1))
    else:
        marked = found.join(visited.select("url", F.lit(0).alias("new")).distinct(), "url", "left").fillna({"new": 1})
    counted = marked.groupBy("page_id").agg(F.count("*").alias("found"), F.sum("new").alias("enqueued"))
    return pages.select("page_id").join(counted, "page_id", "left").fillna(0, ["found", "enqueued"])

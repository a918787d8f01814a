"""The user-facing jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

import pageloom
from pageloom import session
from pageloom.operators import crawl as walks
from pageloom.operators import images as pictures
from pageloom.operators import staged
from pageloom.functions import urls as U
from pageloom.plans.convert import document, page_bodies, with_targets
from pageloom.sources import captures, store


def convert_pages(
    pages: DataFrame, extractor: str = "heuristic", metadata: bool = True, images: bool = True,
    existing: DataFrame | None = None, overwrite: bool = False, layout: str = "site",
) -> DataFrame:
    """Documents of pages, under paths with the host, so that pages of two hosts never collide; ``layout`` "single" names
    them by the last part of the URL alone. Without ``overwrite`` pages stored in ``existing`` (file_path) are left out, and
    of pages with the same path the first counts; with it, the last."""
    placed = with_targets(captures.html_only(pages), layout)
    if not overwrite:
        placed = store.skip_existing(placed, existing)
    placed = store.resolve_collisions(placed, "last" if overwrite else "first")
    return document(page_bodies(placed, extractor, images), metadata)


def crawl_site(
    pages: DataFrame, start_url: str, prefix: str | None = None, max_pages: int | None = None, recursive: bool = True,
    existing: DataFrame | None = None, expand_existing: bool = False, extractor: str = "heuristic",
    metadata: bool = True, images: bool = True, overwrite: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """The walk over a captured site and the documents of its saved pages."""
    walk = walks.crawl(pages, start_url, prefix, max_pages, recursive, existing, expand_existing, overwrite)
    saved = walk.filter(F.col("status") == "saved").select("page_id", "rank", F.col("url").alias("norm_url"), "file_path")
    placed = pages.select("page_id", "html").join(saved, "page_id").withColumn("url", F.col("norm_url"))
    placed = store.resolve_collisions(placed, "last" if overwrite else "first", "rank")
    return walk, document(page_bodies(placed, extractor, images), metadata)


def job_result(spark: SparkSession, success: bool, data: dict | None = None, error: str | None = None, metadata: dict | None = None) -> DataFrame:
    """One row (success, data, error, metadata) describing a run."""
    def text(values: dict | None) -> dict | None:
        return None if values is None else {k: None if v is None else str(v) for k, v in values.items()}

    return spark.createDataFrame(
        [(success, text(data), error, text(metadata or {}))],
        "success boolean, data map<string,string>, error string, metadata map<string,string>")


def build_corpus(
    spark: SparkSession, source: str, target: str, start_url: str | None = None, *, prefix: str | None = None,
    max_pages: int | None = None, recursive: bool = True, extractor: str = "heuristic", metadata: bool = True,
    images: bool = True, overwrite: bool = False, save_html: bool = False, expand_existing: bool = False, format: str = "parquet",
) -> DataFrame:
    """Read captures, walk the site of ``start_url`` (or take every page), store the documents; one result row."""
    about = {"start_url": start_url, "version": pageloom.__version__}
    session.tune(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(session.shuffles_for(spark, source)))
        pages = captures.read_pages(spark, source, format)
        stored = store.read_documents(spark, target)
        if start_url is None:
            documents = convert_pages(pages, extractor, metadata, images, stored, overwrite, "site")
        else:
            _, documents = crawl_site(
                pages, start_url, prefix, max_pages, recursive, stored, expand_existing, extractor, metadata, images, overwrite)
        if save_html:
            documents = store.with_raw_html(documents, pages)
        counted = Observation("saved")
        documents = documents.observe(
            counted, F.count("*").alias("pages_saved"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("total_words"),
            F.coalesce(F.sum("estimated_tokens"), F.lit(0)).alias("total_tokens"))
        if overwrite:
            store.overwrite_documents(documents, target)
        else:
            store.write_markdown(documents, target)
        return job_result(spark, True, {**counted.get, "output_dir": target}, None, about)
    except Exception as problem:  # a failed run is a result, not a crash of the caller
        return job_result(spark, False, None, str(problem), about)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def manifest(pages: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Images of a corpus to fetch (see ``image_manifest``), for pages under their normalised URL."""
    normal = staged(pages, url=U.normalize_url(U.ensure_scheme(F.col("url"))))
    return pictures.image_manifest(normal, existing)

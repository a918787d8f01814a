"""The stored corpus: Markdown documents as a table partitioned by site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom import session
from pageloom.functions import urls as U

SCHEMA = (
    "page_id long, url string, file_path string, content string, word_count long, estimated_tokens long,"
    " html_path string, html string, site string")


def site_of(url: Column) -> Column:
    return U.site_dir(U.netloc(url))


def html_path(file_path: Column) -> Column:
    """Where the raw HTML of a document lies: its path with the last extension replaced."""
    return F.regexp_replace(file_path, r"\.[^./]*$", ".html")


def with_raw_html(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Add ``html_path`` and ``html`` beside the Markdown."""
    return documents.join(pages.select("page_id", "html"), "page_id", "left").withColumn("html_path", html_path(F.col("file_path")))


def read_documents(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored documents, None when nothing is stored yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return spark.read.schema(SCHEMA).parquet(path)


def _stored_columns(documents: DataFrame) -> DataFrame:
    for name in ("html_path", "html"):
        if name not in documents.columns:
            documents = documents.withColumn(name, F.lit(None).cast("string"))
    documents = documents.withColumn("site", site_of(F.col("url")))
    return documents.select(*[c.strip().split(" ")[0] for c in SCHEMA.split(",")])


def write_markdown(documents: DataFrame, path: str, mode: str = "append") -> None:
    """Store documents partitioned by site. The rebalance splits a large site over tasks and merges small ones."""
    _stored_columns(documents).hint("rebalance", "site").write.mode(mode).partitionBy("site").parquet(path)


MOST_SITES = 4096  # partitions named in a filter; more sites than that and all partitions are read


def stored_of(placed: DataFrame, stored: DataFrame) -> DataFrame:
    """The stored documents that can have a path of ``placed``: those in the partitions of its sites.

    Paths below a folder named after their site are stored in that site's partition only. Sites are named in a filter, so
    the scan lists their folders alone; paths of another layout, or a great many sites, leave ``stored`` as it is.
    """
    if "site" not in stored.columns or "url" not in placed.columns:
        return stored
    site = site_of(F.col("url"))
    at_home = F.startswith("file_path", F.concat(site, F.lit("/")))
    found = placed.select(F.when(at_home, site).alias("site")).distinct().limit(MOST_SITES + 1).collect()
    if len(found) > MOST_SITES or any(r["site"] is None for r in found):
        return stored
    return stored.filter(F.col("site").isin([r["site"] for r in found]))


def skip_existing(placed: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Drop pages whose ``file_path`` is stored already.

    Only the partitions of the sites concerned are read. Paths are compared without the markup; the pages then keep the
    few new ids, so that an incremental run does not move the markup of pages it skips.
    """
    if stored is None:
        return placed
    fresh = placed.select("page_id", "file_path").join(stored_of(placed, stored).select("file_path"), "file_path", "left_anti")
    return placed.join(fresh.select("page_id"), "page_id", "left_semi")


def existing_counts(placed: DataFrame, stored: DataFrame) -> DataFrame:
    """(already_exists, remaining): how many pages a run without overwriting would skip and convert."""
    known = stored.select("file_path", F.lit(1).alias("known")).distinct()
    return placed.join(known, "file_path", "left").agg(
        F.count("known").alias("already_exists"), F.count_if(F.col("known").isNull()).alias("remaining"))


def collision_losers(placed: DataFrame, keep: str = "first", order: str = "page_id") -> DataFrame:
    """(page_id): pages that give way to another page of the same ``file_path``.

    Paths are counted by an aggregate over ids alone, combined before the shuffle; only paths used more than
    once go on.
    """
    pick = {"first": F.min, "last": F.max}[keep]
    ids = placed.select("file_path", "page_id", F.col(order).alias("place"))
    shared = ids.groupBy("file_path").agg(pick(F.struct("place", "page_id")).alias("winner"), F.count("*").alias("n"))
    return ids.join(shared.filter(F.col("n") > 1), "file_path").filter(
        F.struct("place", "page_id") != F.col("winner")).select("page_id")


def resolve_collisions(placed: DataFrame, keep: str = "first", order: str = "page_id") -> DataFrame:
    """One page per ``file_path``: the first saved one, or with overwriting the last."""
    return placed.join(collision_losers(placed, keep, order), "page_id", "left_anti")


def overwrite_documents(documents: DataFrame, path: str) -> None:
    """Replace stored documents of the same path; only the partitions of the sites concerned are read and rewritten.

    A table cannot be read while it is overwritten, so what stays of those sites is set aside once, and the new
    documents once; both then go to their place in one write.
    """
    spark = documents.sparkSession
    ready = session.write_through(_stored_columns(documents), session.new_folder(spark, "fresh"))
    stored = read_documents(spark, path)
    if stored is not None:
        of_sites = stored_of(ready, stored).join(ready.select("site").distinct(), "site", "left_semi")
        kept = of_sites.join(ready.select("file_path"), "file_path", "left_anti").select(*ready.columns)
        ready = ready.unionByName(session.write_through(kept, session.new_folder(spark, "kept")))
    ready.hint("rebalance", "site").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("site").parquet(path)

"""Breadth-first walk of a captured site.

The link graph of the site is extracted once and written to the shared folder; it is a small fraction of the
markup, and so is what is known of each URL (path, capture, stored already, path shared with another URL). Each level
then is one job: join the frontier with the edges, keep each target once, drop the visited ones, number the rest in
discovery order, write the level. Edges are rewritten now and then without those whose ends were visited, after which
older levels need not be read again: what a level reads does not grow with the depth. Levels are read back from the
folder, so neither the plan nor the lineage grows, and a lost executor costs one level at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageloom import session
from pageloom.functions import urls as U
from pageloom.operators import staged
from pageloom.operators.images import manifest_counts
from pageloom.operators.links import links
from pageloom.sources.captures import outcomes


def global_rank(df: DataFrame, *keys: str, name: str = "rank") -> DataFrame:
    """Number rows 1, 2, ... in key order without a one-task window.

    Rows are range-sorted and written once; a row's number is its place in its partition plus the size of the
    partitions before. Only one count per partition meets in the window below.
    """
    spark = df.sparkSession
    placed = df.orderBy(*keys).withColumn("_id", F.monotonically_increasing_id())
    placed = session.write_through(placed, session.new_folder(spark, "rank"))
    part = F.shiftright("_id", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    numbered = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return numbered.withColumn(name, F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1).drop("_id", "_part", "_before")


def normal_start(spark: SparkSession, start_url: str) -> tuple[str, str]:
    """Normalised start URL and its site."""
    start = U.normalize_url(U.ensure_scheme(F.lit(start_url)))
    row = spark.range(1).select(start.alias("url"), U.netloc(start).alias("site")).first()
    return row["url"], row["site"]


def site_captures(pages: DataFrame, site: str) -> DataFrame:
    """Pages of one site under their normalised URL, with ``ok`` telling usable HTML."""
    url = U.ensure_scheme(F.col("url"))
    own = pages.filter(U.netloc(url) == site)
    own = outcomes(own).withColumn("ok", F.col("status") == "ok")
    return staged(own.select("page_id", "html", "ok", "url"), url=U.normalize_url(url))


def one_per_url(captures: DataFrame) -> DataFrame:
    """(url, page_id, ok): the first usable capture of each URL, else the first; pre-aggregated, so a URL captured often
    is no hot spot."""
    first = F.min(F.struct((~F.col("ok")).alias("failed"), "page_id", "ok")).alias("c")
    return captures.groupBy("url").agg(first).select("url", "c.page_id", "c.ok")


def crawl(
    pages: DataFrame,
    start_url: str,
    prefix: str | None = None,
    max_pages: int | None = None,
    recursive: bool = True,
    existing: DataFrame | None = None,
    expand_existing: bool = False,
    overwrite: bool = False,
    rewrite_after: int = 1 << 16,
) -> DataFrame:
    """(rank, depth, url, status, page_id, file_path) in the order a queue would visit the URLs.

    Status is ``saved``, ``skipped`` (not captured or not HTML) or ``exists``: ``file_path`` is in ``existing``, or a
    page saved earlier in this walk has it. Such pages are not expanded unless ``expand_existing``. With ``overwrite``
    nothing counts as existing, and pages of one path are all saved. The walk ends after ``max_pages`` saved pages;
    None or 0 mean no limit. Pages found together are ordered by the rank of their finder, then by URL.

    Edges are rewritten when at least `rewrite_after` URLs, and a quarter as many as edges, were visited since.
    """
    spark = pages.sparkSession
    start, site = normal_start(spark, start_url)
    folder = session.new_folder(spark, "crawl")
    captures = site_captures(pages, site)
    known = session.write_through(one_per_url(captures), f"{folder}/captures")
    urls = known.select("url").unionAll(spark.range(1).select(F.lit(start)))
    if recursive:
        found = links(captures.filter("ok").select("page_id", "url", "html"), F.lit(site), prefix)
        sources = known.filter("ok").select("page_id", F.col("url").alias("source"))
        edges = session.write_through(found.join(sources, "page_id").select("source", "url"), f"{folder}/edges/0")
        urls, n_edges = urls.unionAll(edges.select("url")), edges.count()
    facts = session.write_through(url_facts(urls, known, None if overwrite else existing), f"{folder}/urls")

    saved = 0
    depth = 0
    since, since_rows, rewritten, taken = [], 0, 0, []
    frontier = spark.range(1).select(F.lit(start).alias("url"), F.lit(0).cast("long").alias("finder"))
    while True:
        ordered = frontier.orderBy("finder", "url").select("url", "finder", F.monotonically_increasing_id().alias("ord"))
        earlier = spark.read.schema("file_path string").parquet(*taken) if taken else None
        level = _with_status(ordered, facts, earlier, overwrite).withColumn("depth", F.lit(depth))
        level = session.write_through(level, f"{folder}/level/{depth}")
        counts = level.groupBy("status", "shared").count().collect()
        saved += sum(r["count"] for r in counts if r["status"] == "saved")
        if not counts or not recursive or (max_pages and saved >= max_pages):
            break
        open_status = ["saved", "exists"] if expand_existing else ["saved"]
        here = level.filter(F.col("status").isin(open_status)).select(F.col("url").alias("source"), "ord")
        targets = here.join(edges, "source").groupBy("url").agg(F.min("ord").alias("finder"))
        since.append(f"{folder}/level/{depth}")
        since_rows += sum(r["count"] for r in counts)
        visited = spark.read.schema(level.schema).parquet(*since).select("url")
        frontier = targets.join(visited, "url", "left_anti")
        # Only a path that several URLs have can be met again.
        if any(r["status"] == "saved" and r["shared"] for r in counts):
            taken.append(f"{folder}/taken/{depth}")
            level.filter("status = 'saved' and shared").select("file_path").write.parquet(taken[-1])
        if since_rows >= max(rewrite_after, n_edges // 4):
            frontier = session.write_through(frontier, f"{folder}/frontier/{depth}")
            left = edges.join(visited, "url", "left_anti").join(visited.withColumnRenamed("url", "source"), "source", "left_anti")
            # The URLs found but not yet visited keep the edges out of them; those into them have done their work.
            left = left.join(frontier.select("url"), "url", "left_anti").select("source", "url")
            since = [f"{folder}/frontier/{depth}"]
            rewritten += 1
            edges = session.write_through(left, f"{folder}/edges/{rewritten}")
            n_edges, since_rows = edges.count(), 0
        depth += 1

    rows = spark.read.schema(level.schema).parquet(*[f"{folder}/level/{d}" for d in range(depth + 1)])
    ranked = global_rank(rows.drop("shared"), "depth", "ord")
    if max_pages and saved > max_pages:
        last = global_rank(ranked.filter("status = 'saved'"), "rank", name="nth").filter(F.col("nth") == max_pages).first()
        ranked = ranked.filter(F.col("rank") <= last["rank"])
    return ranked.select("rank", "depth", "url", "status", "page_id", "file_path")


def url_facts(urls: DataFrame, known: DataFrame, existing: DataFrame | None) -> DataFrame:
    """(url, file_path, page_id, ok, stored, shared) of every URL a walk can meet, worked out once.

    ``stored`` tells whether ``existing`` has the path, ``shared`` whether another URL has it too; a path of many URLs is
    combined before the shuffle and is no hot spot but for the join back, which is left to AQE.
    """
    placed = staged(urls.distinct(), file_path=U.site_file_path(F.col("url"))).join(known, "url", "left")
    of_path = placed.groupBy("file_path").agg((F.count("*") > 1).alias("shared"))
    if existing is None:
        of_path = of_path.withColumn("stored", F.lit(False))
    else:
        stored = existing.select("file_path").distinct().withColumn("stored", F.lit(True))
        of_path = of_path.join(stored, "file_path", "left").fillna({"stored": False})
    noted = of_path.filter("shared or stored")
    return placed.join(noted, "file_path", "left").select(
        "url", "file_path", "page_id", F.coalesce("ok", F.lit(False)).alias("ok"), F.coalesce("stored", F.lit(False)).alias("stored"),
        F.coalesce("shared", F.lit(False)).alias("shared"))


def _with_status(urls: DataFrame, facts: DataFrame, taken: DataFrame | None, overwrite: bool) -> DataFrame:
    """``urls`` (url, finder, ord) of a level with path, capture and status; ``taken`` holds shared paths saved before."""
    placed = urls.join(facts, "url", "left")
    exists: Column = F.col("stored")
    if not overwrite:
        if taken is not None:
            placed = placed.join(taken.select("file_path", F.lit(True).alias("met")).distinct(), "file_path", "left")
            exists = exists | F.coalesce("met", F.lit(False))
        # One row per path, pre-aggregated, so a path many URLs share is no hot spot before the join.
        first = placed.filter("ok and shared").groupBy("file_path").agg(F.min(F.struct("finder", "url")).alias("first"))
        placed = placed.join(first, "file_path", "left")
        exists = exists | F.coalesce(F.struct("finder", "url") > F.col("first"), F.lit(False))
    status = F.when(exists, "exists").when(F.col("ok"), "saved").otherwise("skipped")
    return placed.select("url", "ord", "file_path", "page_id", status.alias("status"), "shared")


def crawl_summary(walk: DataFrame, converted: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """One row: pages saved, skipped, already stored, and the words and tokens of the saved ones.

    With the ``manifest`` of their images also how many there are, how many to fetch and stored already, and how many
    share a path with another.
    """
    sizes = converted.select("page_id", "word_count", "estimated_tokens")
    found = walk.join(sizes, "page_id", "left").agg(
        F.count_if(F.col("status") == "saved").alias("saved"), F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("status") == "exists").alias("already_exists"),
        F.coalesce(F.sum(F.when(F.col("status") == "saved", F.col("word_count"))), F.lit(0)).alias("total_words"),
        F.coalesce(F.sum(F.when(F.col("status") == "saved", F.col("estimated_tokens"))), F.lit(0)).alias("total_tokens"))
    if manifest is None:
        return found
    counts = manifest_counts(manifest).select(
        "images", F.col("to_fetch").alias("images_to_fetch"), F.col("existing").alias("images_existing"), F.col("collisions").alias("image_collisions"))
    return found.join(counts)  # one row each

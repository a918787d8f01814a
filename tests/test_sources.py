"""Byte captures, ids by file and row, captures in streams, and what an incremental run reads."""

from pyspark.sql import functions as F

from pageloom.operators import crawl, images
from pageloom.sources import captures, store
from pageloom.streaming import ingest

PAGE = "<html><body><article><h1>{}</h1><p>some text</p></article></body></html>"


def test_byte_captures_with_declared_charsets(spark, tmp_path):
    rows = [
        ("https://h/1", PAGE.format("é").encode("cp1252"), "windows-1252", None), ("https://h/2", PAGE.format("日本").encode("shift_jis"), None, "text/html; charset=Shift_JIS"),
        ("https://h/3", PAGE.format("é").encode(), "", "text/html"), ("https://h/4", None, "utf-8", "text/html"),
        ("https://h/5", b"\xef\xbb\xbf" + PAGE.format("ü").encode(), None, None), ("https://h/6", PAGE.format("я").encode("koi8-r"), "utf-8 ".replace("utf-8", "koi8-r"), 'text/html; charset="latin1"')]
    spark.createDataFrame(rows, "url string, content binary, charset string, content_type string").write.parquet(str(tmp_path / "a"))
    pages = captures.read_pages(spark, str(tmp_path / "a"))
    assert "content" not in pages.columns
    found = {r.url[-1]: r.html for r in pages.collect()}
    assert [found[k] if found[k] is None else found[k].split("h1>")[1][:-2] for k in "123456"] == ["é", "日本", "é", None, "ü", "я"]
    assert {r.url[-1] for r in captures.html_only(pages).collect()} == {"2", "3"} | set("6")
    spark.createDataFrame([("https://h/1", PAGE.format("é").encode("cp1252"))], "url string, html binary").write.parquet(str(tmp_path / "b"))
    assert "é" in captures.read_pages(spark, str(tmp_path / "b")).first().html


def test_ids_do_not_depend_on_how_files_are_split(spark, tmp_path):
    df = spark.range(4000).select(F.concat(F.lit("https://h/"), "id").alias("url"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 20).alias("html"))
    df.repartition(3).write.option("parquet.block.size", 200_000).parquet(str(tmp_path / "a"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    found = []
    for size in ("128m", "256k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        pages = captures.read_pages(spark, str(tmp_path / "a"))
        found.append((pages.rdd.getNumPartitions(), {r.url: r.page_id for r in pages.select("url", "page_id").collect()}))
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found[0][1] == found[1][1] and len(set(found[0][1].values())) == 4000


def test_streams_honour_content_type_and_errors(spark, tmp_path):
    arrived, target, checkpoint = (str(tmp_path / n) for n in ("arrived", "documents", "checkpoint"))
    schema = "page_id long, url string, html string, content_type string, error string"

    def arrive(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(arrived)
        ingest.ingest(spark, arrived, target, checkpoint, metadata=False, images=False).awaitTermination()
        stored = store.read_documents(spark, target)
        return {r.url[-1]: r.page_id for r in stored.collect()} if stored is not None else {}

    page = PAGE.format("x")
    assert arrive((1, "https://h.org/1", page, "text/html", None), (2, "https://h.org/2", page, "application/pdf", None), (3, "https://h.org/3", page, "text/html", "timeout")) == {"1": 1}
    assert arrive((4, "https://h.org/3", page, "text/html", None), (5, "https://h.org/1", page, "text/html", None), (6, "https://i.org/4", page, "text/html", None)) == {"1": 1, "3": 4, "4": 6}


def test_an_incremental_run_reads_the_partitions_of_its_sites(spark, tmp_path):
    target = str(tmp_path / "documents")
    rows = [(k, f"https://s{k % 5}.org/p{k}", f"s{k % 5}.org/p{k}.md", "text", 1, 1) for k in range(50)]
    docs = spark.createDataFrame(rows, "page_id long, url string, file_path string, content string, word_count long, estimated_tokens long")
    store.write_markdown(docs.filter("page_id < 30"), target)
    stored = store.read_documents(spark, target)
    placed = docs.filter("page_id % 5 = 2")
    fresh = store.skip_existing(placed, stored)
    assert sorted(r.page_id for r in fresh.collect()) == [32, 37, 42, 47]
    few = store.stored_of(placed, stored)
    assert {f.split("site=")[1].split("/")[0] for f in few.inputFiles()} == {f"s{k}.org" for k in range(5)}  # listed, then pruned:
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(site" in plan and "s2.org" in plan and few.count() == 6
    # Paths of another layout say nothing about sites.
    flat = placed.withColumn("file_path", F.element_at(F.split("file_path", "/"), -1))
    assert store.stored_of(flat, stored) is stored


def test_one_image_path_of_very_many_urls(spark, pages):
    html = [f'<html><img src="https://c{k}.org/i/logo.png"><img src="/own{k}.png">' for k in range(120)]
    found = images.image_manifest(pages(*html), spark.createDataFrame([("images/i/logo.png",), ("nothing",)], "path string"))
    paths = {r.path: (r.n, r.hit) for r in found.groupBy("path").agg(F.count("*").alias("n"), F.max("collides").alias("hit")).collect()}
    assert sorted(paths.values(), key=str)[-1] == (120, True) and len(paths) == 121
    assert images.image_manifest(pages("<html>")).count() == 0


def test_a_long_chain_is_walked_with_edges_that_shrink(spark, monkeypatch):
    """60 levels; every page links to the next, to the first and to one before. Edges are rewritten on the way."""
    rows = [(k, f"https://h/{k}", f'<html><a href="/{k + 1}">n</a><a href="/0">f</a><a href="/{k // 2}">b</a>') for k in range(60)]
    sizes, plain = [], crawl.session.write_through

    def counted(df, folder):
        out = plain(df, folder)
        if "/edges/" in folder:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(crawl.session, "write_through", counted)
    walk = crawl.crawl(spark.createDataFrame(rows, "page_id long, url string, html string"), "https://h/0", rewrite_after=12)
    found = [(r.depth, r.url, r.status) for r in walk.orderBy("rank").collect()]
    assert found == [(k, f"https://h/{k}", "saved" if k < 60 else "skipped") for k in range(61)]
    assert len(sizes) >= 3 and all(b < a for a, b in zip(sizes, sizes[1:], strict=False)) and sizes[-1] < 15

import pytest
from pyspark.sql import functions as F

from pageloom.fixtures import pages_x
from pageloom.operators import crawl, links
from pageloom.plans import corpus
from pageloom.plans.convert import convert, page_bodies, with_targets
from pageloom.sources import captures, store
from pageloom.streaming import ingest

PAGES = "/root/testdata/sf0.001/pages.parquet"
START = "https://site0.example.org/p/0"


@pytest.fixture(scope="module")
def enriched(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("captures") / "pages")
    pages_x(spark.read.parquet(PAGES)).write.parquet(folder)
    return folder


def bodies(df, **options):
    return [r["body"] for r in page_bodies(with_targets(df), **options).orderBy("page_id").collect()]


def test_markdown_rules(spark, pages):
    html = [
        "<h1> A  title</h1><p>one\n two</p><p>a<br>b &lt;c&gt;</p>",
        "<ul><li>a</li><li><p>b</p><ol start=3><li>c<li>d</ol></li></ul><p>end</p>",
        '<p><a href="/x" title="t">in <b>bold</b></a> <a href="http://u.org/">http://u.org/</a> <a href="y"></a></p>',
        "<blockquote><p>q1</p><blockquote>q2<br>q3</blockquote></blockquote><hr>",
        "<pre><code class='language-c++'>a &lt; b\n  c\n</code></pre><p>x <code>a*b_c</code> <kbd>k</kbd></p>",
        "<table><tr><th>a<th colspan=2>b</tr><tr><td rowspan=2>c<td>d<td>e</tr><tr><td><p>f</p><td>g<table><tr><td>n</table></tr></table>",
        "<p>1. x</p><p>+ y</p><p>- z\n- w</p><p>2.5 ok</p><p>a\\*b</p>",
        '<dl><dt>t</dt><dd>d</dd></dl><p><em> e </em>x<del>s</del></p><abbr title="Long">L</abbr>',
        '<head><title>T</title></head><body><img src="a b.png" alt="x[1]"><noscript><p>n</p></noscript><script>s</script>',
        '<p>i $5 <math display="block" alttext="x_1"></math> j</p>', "", None,
    ]
    assert bodies(pages(*html), local_images=False) == [
        "#  A title\n\none two\n\na  \nb <c>",
        "* a\n  * b\n\n    3. c\n    4. d\n\n\n\nend",
        '[in **bold**](/x "t") <http://u.org/> [](y)',
        "> q1\n>\n>> q2  \n> q3\n\n* * *",
        "```\na < b\n  c\n```\n\nx `a*b_c` `k`",
        "a| b|   \n---|---|---  \nc| d| e  \n| f| g n",
        "1\\. x\n\n\\+ y\n\n\\- z \\- w\n\n2.5 ok\n\na\\\\*b",
        "t\n    d\n\n_e_ x~~s~~\n\nL\n  *[L]: Long",
        "![x\\[1\\]](a b.png)",
        "i $5 \n\n$$x_1$$\n\nj", "", ""]


def test_documents(spark, pages):
    df = pages("<html lang=en><head><title>Example Domain</title></head><body><p>Hello <a href='/m'>more</a></p>", url="example.com/a/")
    row = convert(df, layout="single").first()
    assert row["file_path"] == "a.md"
    assert row["content"] == (
        '---\ntitle: Example Domain\nlanguage: en\nurl: "https://example.com/a/"\nword_count: 2\nestimated_tokens: 2\n---\n\n'
        "# Example Domain\n\n> Source: <https://example.com/a/>\n\n\n\nHello [more](/m)\n")
    bare = convert(df, layout="site", metadata=False).first()
    assert (bare["url"], bare["file_path"]) == ("https://example.com/a", "example.com/a.md")


def test_images_are_placed_behind_their_heading(spark, pages):
    html = ('<h2>The first heading</h2><img src="/a.png"><article><h2>The first heading</h2><p>' + "x" * 250 + '</p><img src="/b.png" alt="B"></article>'
            '<div style="background-image: url(/c.png)"></div>')
    assert bodies(pages(html)) == [
        "## The first heading\n\n![a](../images/a.png)\n\n\n\n" + "x" * 250 + "\n\n![B](../images/b.png)\n\n![c](../images/c.png)"]


def test_conversion_is_stable(spark, enriched):
    df = spark.read.parquet(enriched)
    one, many = convert(df.coalesce(1)), convert(df.repartition(5))
    assert one.exceptAll(many).count() == 0 and one.count() == df.count()


def test_walk_order_and_limits(spark, enriched):
    df = spark.read.parquet(enriched)
    rows = crawl.crawl(df, START, prefix="/p/").orderBy("rank").collect()
    queue, seen, order = [START], {START}, []
    known = {r["url"] for r in df.collect()}
    found = {}
    for r in links.links(df, F.lit("site0.example.org"), "/p/").join(df.select("page_id", F.col("url").alias("source")), "page_id").collect():
        found.setdefault(r["source"], []).append(r["url"])
    while queue:
        url = queue.pop(0)
        order.append((url, "saved" if url in known else "skipped"))
        for link in sorted(found.get(url, [])) if url in known else []:
            if link not in seen:
                seen.add(link)
                queue.append(link)
    assert [(r["url"], r["status"]) for r in rows] == order
    limited = crawl.crawl(df, START, prefix="/p/", max_pages=4).orderBy("rank").collect()
    cut = [i for i, (_, s) in enumerate(order) if s == "saved"][3]
    assert [(r["url"], r["status"]) for r in limited] == order[: cut + 1]
    assert crawl.crawl(df, START, prefix="/p/", max_pages=0).count() == len(order)


def test_hot_url_and_hot_target(spark):
    """A third of the captures are one URL, and every page links to it."""
    rows = [(i, "https://h/hot" if i % 3 == 0 else f"https://h/{i}", f'<html><a href="/hot">h</a><a href="/{i + 1}">n</a>') for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    walk = crawl.crawl(df, "https://h/hot", prefix="/").collect()
    assert {r["url"]: (r["page_id"], r["status"]) for r in walk}["https://h/hot"] == (0, "saved")
    assert store.resolve_collisions(with_targets(df)).count() == 201


def test_global_rank(spark):
    ranked = crawl.global_rank(spark.range(1000).withColumn("key", F.pmod(F.col("id") * 7919, F.lit(1000))).repartition(9), "key")
    assert ranked.filter(F.col("rank") != F.col("key") + 1).count() == 0


def test_stored_runs(spark, enriched, tmp_path):
    target = str(tmp_path / "corpus")
    first = corpus.build_corpus(spark, enriched, target, START, max_pages=5, images=False).first()
    assert first["success"] and first["data"]["pages_saved"] == "5"
    again = corpus.build_corpus(spark, enriched, target, images=False, save_html=True).first()
    assert again["data"]["pages_saved"] == "45"
    stored = store.read_documents(spark, target)
    assert stored.count() == 50 and stored.filter("html is not null").count() == 45
    over = corpus.build_corpus(spark, enriched, target, START, prefix="/p/", images=False, metadata=False, overwrite=True).first()
    assert over["success"] and store.read_documents(spark, target).count() == 50
    assert store.read_documents(spark, target).filter("content like '---%'").count() == 50 - int(over["data"]["pages_saved"])
    failed = corpus.build_corpus(spark, str(tmp_path / "nothing"), target).first()
    assert not failed["success"] and "nothing" in failed["error"]


def test_ingest_adds_only_new_pages(spark, enriched, tmp_path):
    arrived, target, checkpoint = (str(tmp_path / n) for n in ("arrived", "documents", "checkpoint"))
    df = spark.read.parquet(enriched)
    df.filter("page_id < 30").write.parquet(arrived)
    ingest.ingest(spark, arrived, target, checkpoint, metadata=False, images=False).awaitTermination()
    assert store.read_documents(spark, target).count() == 30
    df.filter("page_id >= 20").withColumn("page_id", F.col("page_id") + 1000).write.mode("append").parquet(arrived)
    ingest.ingest(spark, arrived, target, checkpoint, metadata=False, images=False).awaitTermination()
    assert store.read_documents(spark, target).count() == 50


def test_stream_state_holds_repeats_across_restarts(spark, tmp_path):
    """Three runs of one stream over a folder of captures: new, repeated within the delay, late, without a time."""
    arrived, passed, checkpoint = (str(tmp_path / n) for n in ("arrived", "passed", "checkpoint"))
    schema = "page_id long, url string, html string, error string, fetched_at timestamp"

    def run(*rows):
        df = spark.createDataFrame([(i, f"https://h/{u}", "<html>", e, t) for i, u, e, t in rows], schema.replace("timestamp", "string"))
        df.withColumn("fetched_at", F.to_timestamp("fetched_at")).write.mode("append").parquet(arrived)
        first = ingest.first_captures(spark.readStream.schema(schema).parquet(arrived), "2 days", "site")
        query = first.writeStream.format("parquet").option("path", passed).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        dropped = sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])
        return sorted(r["page_id"] for r in spark.read.parquet(passed).collect()), dropped

    assert run((1, "a", None, "2024-01-01 10:00:00"), (2, "b", "timeout", "2024-01-01 10:00:00")) == ([1], 0)
    # a again within the delay; b's first good capture; c twice in one batch
    passing, _ = run((3, "a/", None, "2024-01-02 10:00:00"), (4, "b", None, "2024-01-02 10:00:00"), (5, "c", None, "2024-01-20 10:00:00"), (6, "c", None, "2024-01-20 10:00:00"))
    assert passing in ([1, 4, 5], [1, 4, 6])
    # d is later than the watermark allows, e has no time, a is forgotten, c is not
    again, dropped = run((7, "d", None, "2024-01-03 10:00:00"), (8, "e", None, None), (9, "a", None, "2024-01-20 11:00:00"), (10, "c", None, "2024-01-20 12:00:00"))
    assert again == sorted([*passing, 8, 9]) and dropped == 1
    with pytest.raises(ValueError):
        ingest.ingest(spark, arrived, passed, checkpoint, schema="page_id long, url string, html string", repeats_within="2 days")


def test_overwrite_reads_and_writes_its_sites_only(spark, tmp_path):
    target = str(tmp_path / "documents")
    schema = "page_id long, url string, file_path string, content string, word_count long, estimated_tokens long"
    rows = [(i, f"https://s{i % 3}/p{i}", f"s{i % 3}/p{i}.md", "old", 1, 1) for i in range(12)]
    store.write_markdown(spark.createDataFrame(rows, schema), target)
    before = {f for f in spark.read.parquet(target).inputFiles() if "site=s1" not in f}
    store.overwrite_documents(spark.createDataFrame([(r[0], *r[1:3], "new", 2, 2) for r in rows if r[0] in (1, 4)] + [(20, "https://s1/n", "s1/n.md", "new", 2, 2)], schema), target)
    found = {r["file_path"]: r["content"] for r in store.read_documents(spark, target).collect()}
    assert found == {r[2]: "new" if r[0] in (1, 4) else "old" for r in rows} | {"s1/n.md": "new"}
    assert before <= set(spark.read.parquet(target).inputFiles())


def test_saved_html_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.html").write_text("<html><h1>é</h1>", encoding="utf-8")
    (tmp_path / "b.html").write_bytes("<meta charset=windows-1252><html><h1>é</h1>".encode("cp1252"))
    rows = captures.read_html_folder(spark, str(tmp_path), "https://h/x").collect()
    assert {r["url"]: "é" in r["html"] for r in rows} == {"https://h/x/sub/a.html": True, "https://h/x/b.html": True}


def test_one_exchange_per_conversion(spark):
    plan = convert(spark.read.parquet(PAGES))._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning" in line for line in plan.splitlines()) == 1

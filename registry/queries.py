"""One query per operator; each takes (spark, sf_dir) and reads the tables there.

Names ending in ``_x`` run on the enriched pages of ``pageloom.fixtures``, derived from the same pages table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageloom import session
from pageloom.fixtures import pages_x
from pageloom.functions import markup as M
from pageloom.functions import text as T
from pageloom.functions import urls as U
from pageloom.operators import code, crawl, extract, images, links, mathml, report, staged, tables, tokens
from pageloom.operators import metadata as meta
from pageloom.plans import convert as plan
from pageloom.plans import corpus
from pageloom.sources import captures, store
from pageloom.streaming import ingest

START = "https://site0.example.org/p/0"

# Derived columns both engines compute alike.
CONTENT_TYPE = (
    "CASE page_id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'application/xhtml+xml'"
    " ELSE 'text/html; charset=utf-8' END")
SHARED_PATH = "CASE WHEN page_id % 3 = 0 THEN 'hot.md' ELSE 'p' || CAST(page_id % 20 AS STRING) || '.md' END"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Callable[[DataFrame], DataFrame]], Callable[[DataFrame], DataFrame]]:
    """Register a function of the pages (names with ``_x``: of the enriched pages)."""
    def register(build: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        enriched = name.endswith("_x")
        QUERIES[name] = lambda spark, sf_dir: build(enriched_pages(spark, sf_dir) if enriched else raw_pages(spark, sf_dir))
        return build

    return register


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures.read_pages(session.tune(spark), f"{sf_dir}/pages.parquet")


def enriched_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_x(raw_pages(spark, sf_dir))


def count(name: str, condition: Column) -> Column:
    return F.count_if(condition).alias(name)


def in_order(df: DataFrame, *partition: str, by: str = "pos") -> DataFrame:
    return df.withColumn("n", F.row_number().over(Window.partitionBy(*partition).orderBy(by)))


# Sources

@query("src1_page_source")
def _(pages):
    return pages.select("page_id", "url", F.length("html").cast("long").alias("chars"))


@query("src2_html_only")
def _(pages):
    return captures.html_only(pages.withColumn("content_type", F.expr(CONTENT_TYPE))).select("page_id", "content_type")


@query("src3_decode_charset")
def _(pages):
    wide = F.col("page_id") % 2 == 1
    content = F.when(wide, F.encode("html", "UTF-16LE")).otherwise(F.encode("html", "UTF-8"))
    declared = F.when(wide, "utf-16le").otherwise("ISO-8859-1")
    return pages.select("page_id", captures.decode_charset(content, declared).alias("html"))


@query("src4_fetch_outcome")
def _(pages):
    return captures.outcome_counts(pages.withColumns({
        "content_type": F.expr(CONTENT_TYPE), "html": F.when(F.col("page_id") % 7 != 0, F.col("html"))}))


# Stored corpus

def _placed(pages):
    return plan.with_targets(pages.select("page_id", "url", "html"), "site")


def _plain_documents(pages):
    """Documents of which only path and a short content matter."""
    return _placed(pages).select(
        "page_id", "url", "file_path", F.concat(F.lit("old "), F.col("page_id").cast("string")).alias("content"),
        F.lit(2).cast("long").alias("word_count"), F.lit(2).cast("long").alias("estimated_tokens"))


@query("snk1_write_markdown_x")
def _(pages):
    folder = session.new_folder(pages.sparkSession, "documents")
    store.write_markdown(plan.convert(pages), folder)
    stored = store.read_documents(pages.sparkSession, folder)
    return stored.select("page_id", "site", "file_path", "content")


@query("snk2_write_raw_html_x")
def _(pages):
    docs = store.with_raw_html(_plain_documents(pages), pages)
    return docs.select("page_id", "html_path", F.md5("html").alias("html_md5"))


@query("snk3_skip_existing_x")
def _(pages):
    placed = _placed(pages)
    stored = placed.filter("page_id % 4 = 0").select("file_path")
    return store.skip_existing(placed, stored).select("page_id", "file_path")


@query("snk3_existing_counts_x")
def _(pages):
    placed = _placed(pages)
    return store.existing_counts(placed, placed.filter("page_id % 4 = 0").select("file_path"))


@query("snk4_overwrite_x")
def _(pages):
    folder = session.new_folder(pages.sparkSession, "documents")
    docs = _plain_documents(pages)
    store.write_markdown(docs, folder)
    store.overwrite_documents(docs.filter("page_id % 2 = 0").withColumn("content", F.replace("content", F.lit("old"), F.lit("new"))), folder)
    return store.read_documents(pages.sparkSession, folder).select("page_id", "file_path", "content")


@query("snk5_path_collision")
def _(pages):
    placed = pages.select("page_id", F.expr(SHARED_PATH).alias("file_path"))
    first = store.resolve_collisions(placed, "first").select("file_path", F.col("page_id").alias("first_page"))
    last = store.resolve_collisions(placed, "last").select("file_path", F.col("page_id").alias("last_page"))
    return first.join(last, "file_path")


@query("snk6_stream_ingest_x")
def _(pages):
    spark = pages.sparkSession
    folder = session.new_folder(spark, "stream")
    pages.write.parquet(f"{folder}/arrived")
    for _run in range(2):
        stream = ingest.ingest(spark, f"{folder}/arrived", f"{folder}/documents", f"{folder}/checkpoint", metadata=False, images=False)
        stream.awaitTermination()
    return store.read_documents(spark, f"{folder}/documents").select("page_id", "site", "file_path")


@query("snk6_stream_repeats_x")
def _(pages):
    """Pages captured again within a day, in a later batch: state drops them before the store is asked."""
    spark = pages.sparkSession
    folder = session.new_folder(spark, "stream")
    seen = pages.withColumn("fetched_at", F.timestamp_seconds(F.col("page_id") * 60))
    again = seen.filter("page_id % 2 = 0").withColumn("page_id", F.col("page_id") + 1_000_000).withColumn("fetched_at", F.col("fetched_at") + F.expr("interval 1 hour"))
    for arrived in (seen.filter("page_id % 3 <> 0"), seen.filter("page_id % 3 = 0").unionByName(again)):
        arrived.write.mode("append").parquet(f"{folder}/arrived")
        stream = ingest.ingest(
            spark, f"{folder}/arrived", f"{folder}/documents", f"{folder}/checkpoint", repeats_within="36500 days", metadata=False, images=False)
        stream.awaitTermination()
    return store.read_documents(spark, f"{folder}/documents").select(F.pmod("page_id", F.lit(1_000_000)).alias("page_id"), "site", "file_path")


# URLs

@query("url1_ensure_scheme")
def _(pages):
    given = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("url", "^https?://", "")).otherwise(F.col("url"))
    return pages.select("page_id", U.ensure_scheme(given).alias("url"))


@query("url2_url_parts")
def _(pages):
    return pages.select("page_id", U.url_parts(F.col("url")).alias("p")).select("page_id", "p.*")


@query("url3_normalize_url")
def _(pages):
    return pages.select("page_id", U.normalize_url(F.col("url")).alias("norm_url"))


@query("url4_urljoin")
def _(pages):
    return in_order(links.link_candidates(pages).select("page_id", "target"), "page_id", by="target").select("page_id", "n", "target")


@query("url5_is_internal_x")
def _(pages):
    found = links.link_candidates(pages).select("page_id", "url", "target").distinct()
    return found.select("page_id", "target", U.is_internal(F.col("target"), U.netloc(F.col("url"))).cast("string").alias("internal"))


@query("url6_should_skip_x")
def _(pages):
    found = links.link_candidates(pages).select("page_id", "target").distinct()
    return found.select("page_id", "target", U.should_skip(F.col("target")).cast("string").alias("skipped"))


@query("url7_site_file_path")
def _(pages):
    return staged(pages.select("page_id", "url"), norm=U.normalize_url(F.col("url"))).select(
        "page_id", U.site_file_path(F.col("norm")).alias("file_path"))


@query("url8_page_file_name")
def _(pages):
    return staged(pages.select("page_id", "url"), norm=U.normalize_url(F.col("url"))).select(
        "page_id", U.page_file_name(F.col("norm")).alias("file_name"))


@query("url9_sanitize_filename")
def _(pages):
    title = F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)
    return pages.select("page_id", U.sanitize_filename(title).alias("file_name"))


@query("url10_image_path_x")
def _(pages):
    return images.image_set(pages).select("page_id", "url", U.image_path(F.col("url")).alias("image_path"))


@query("url11_relative_path_x")
def _(pages):
    return images.images(pages).select("page_id", "url", "rel_path")


@query("url12_site_dir")
def _(pages):
    port = F.concat(U.netloc(F.col("url")), F.lit(":8080"))
    return pages.select("page_id", U.site_dir(port).alias("site_dir"))


# Tokens

@query("tok1_round_trip")
def _(pages):
    joined = F.sort_array(F.collect_list(F.struct("pos", "tok")))
    return tokens.raw_tokens(pages).groupBy("page_id").agg(F.array_join(joined["tok"], "").alias("html"))


@query("tok1_token_kinds")
def _(pages):
    kinds = ["text", "open", "close", "comment", "raw", "rcdata", "declaration"]
    return tokens.raw_tokens(pages).groupBy("page_id").agg(*[count(f"n_{k}", F.col("kind") == k) for k in kinds])


@query("tok2_attrs_x")
def _(pages):
    rows = in_order(tokens.attribute_rows(pages, ["a"]), "page_id").filter(F.col("name") == "href")
    return rows.select("page_id", "n", "value")


@query("tok2_quoted_gt")
def _(pages):
    """Attributes behind a quoted '>': the region, a column span, a link and a JSON-LD type of each page."""
    opened = F.concat(F.lit('<div title="a>b" id="content"><table><tr><td title="1 > 0" colspan=3>w</td></tr></table><span title="x > y" data-href="/s">s</span>'))
    built = pages.withColumn("html", F.replace(F.replace("html", F.lit("<article>"), opened), F.lit("</article>"), F.lit("</div>")))
    rule = extract.regions(built).select("page_id", "rule")
    wide = tables.table_cells(built).groupBy("page_id").agg(F.max("col_no").alias("columns"))
    named = links.link_candidates(built).filter("via = 'data-href'").groupBy("page_id").agg(F.count("*").alias("n_links"))
    return rule.join(wide, "page_id").join(named, "page_id")


@query("tok3_entities")
def _(pages):
    return tokens.element_text(pages, ["footer"]).select("page_id", "text")


@query("tok4_element_span")
def _(pages):
    spans = tokens.element_spans(pages, ["nav", "ul", "li", "article"])
    width = F.sum(F.col("end_pos") - F.col("start_pos"))
    return spans.groupBy("page_id", "tag").agg(F.count("*").alias("spans"), F.max("depth").alias("depth"), width.alias("width"))


@query("tok5_element_text")
def _(pages):
    return in_order(tokens.element_text(pages, ["title", "h1", "li"]), "page_id", "tag").select("page_id", "tag", "n", "text")


@query("tok6_strip_boilerplate")
def _(pages):
    rows = tokens.visible(tokens.nodes(pages)).withColumn("t", T.strip(M.token_text(F.col("kind"), F.col("tok"))))
    return rows.groupBy("page_id").agg(F.array_join(F.sort_array(F.collect_list(F.when(F.col("t") != "", F.struct("pos", "t"))))["t"], "\n").alias("text"))


@query("tok7_plaintext")
def _(pages):
    return tokens.plaintext(pages)


# Content extraction

@query("ext1_heuristic")
def _(pages):
    return extract.region_text(pages, "heuristic")


@query("ext1_heuristic_rule_x")
def _(pages):
    return extract.regions(pages, "heuristic").select("page_id", "rule")


@query("ext2_density")
def _(pages):
    return extract.region_text(pages, "density")


@query("ext2_density_scored")
def _(pages):
    """Pages of three blocks whose paragraphs, commas, links and names follow from the page: the text of the densest."""
    k, n = F.col("page_id"), F.length("html")
    def times(text: str, count: Column) -> Column:
        return F.repeat(F.lit(text), count.cast("int"))

    body = F.concat(
        F.lit('<html><body><div id="a">'), F.repeat(F.concat(F.lit("<p>"), times("abcd,", 6 + n % 8), F.lit("</p>")), (1 + k % 3).cast("int")), F.lit("</div>"),
        F.lit('<div class="sidebar">'), F.repeat(F.concat(F.lit("<p>"), times("z", 30 + k % 400), F.lit("</p>")), (1 + k % 13).cast("int")), F.lit("</div>"),
        F.lit('<div class="post"><p>'), times("y", 40 + n % 9), F.lit("<a href=/l>"), times("x", 1 + k % 50), F.lit("</a></p></div></body></html>"))
    return extract.region_text(pages.withColumn("html", body), "density")


@query("ext3_full")
def _(pages):
    return extract.region_text(pages, "full")


@query("ext4_extract_fallback_x")
def _(pages):
    whole = extract.regions(pages, "heuristic").filter("rule = 0").select("page_id")
    return extract.region_text(pages.join(whole, "page_id", "left_semi"), "heuristic").select("page_id", F.startswith("text", F.lit("T")).cast("string").alias("from_top"))


@query("ext4_extract_fallback")
def _(pages):
    """The text of pages whose content no rule finds, which is all they show."""
    return extract.region_text(pages.withColumn("html", F.regexp_replace("html", "(</?)article>", "$1section>")), "heuristic")


@query("ext5_title")
def _(pages):
    return meta.metadata(pages).select("page_id", F.coalesce("title", "html_title").alias("title"))


# Metadata

def _metadata_query(name: str, *columns: str) -> None:
    @query(name)
    def _(pages):
        shown = [F.array_join(c, "|").alias(c) if c == "keywords" else F.col(c) for c in columns]
        return meta.metadata(pages).select("page_id", *shown)


_metadata_query("mta1_title", "title")
_metadata_query("mta1_title_x", "title")
_metadata_query("mta2_description_x", "description")
_metadata_query("mta3_author_x", "author")
_metadata_query("mta4_published_x", "published")
_metadata_query("mta5_modified_x", "modified")
_metadata_query("mta6_canonical_url_x", "canonical_url")
_metadata_query("mta7_language", "language")
_metadata_query("mta8_keywords_x", "keywords")
_metadata_query("mta9_site_name_image_x", "site_name", "image")
_metadata_query("mta12_schema_type_x", "schema_type")


@query("mta10_jsonld_override_x")
def _(pages):
    items = meta.json_ld_items(pages)
    return items.select("page_id", "schema_type", "headline", "description", "published", "modified")


@query("mta10_repeated_keys")
def _(pages):
    k = F.col("page_id").cast("string")
    script = F.concat(
        F.lit('<script data-x="a>b" type="application/ld+json">{"@type":"Article","headline":"no","headline":"H'), k, F.lit('","author":{"name":"x","name":"A'), k,
        F.lit('"},"url":"https://a.example.org/no","url":"https://a.example.org/'), k, F.lit('"}</script>'))
    built = pages.withColumn("html", F.concat(script, "html"))
    found = links.link_candidates(built).filter("via = 'json-ld'").select("page_id", "target")
    return meta.json_ld_items(built).select("page_id", "headline", "author").join(found, "page_id")


@query("mta11_jsonld_author_x")
def _(pages):
    return meta.json_ld_items(pages).select("page_id", "author")


@query("mta13_null_drop_x")
def _(pages):
    return meta.present_fields(meta.metadata(pages)).select("page_id", F.col("n").cast("long").alias("n"), "key", "value")


@query("mta14_front_matter_x")
def _(pages):
    found = meta.metadata(pages).join(pages.select("page_id", "url"), "page_id")
    block = meta.front_matter({k: F.col(k) for k in meta.FIELDS}, F.col("url"), F.col("page_id"), F.col("page_id") + 1)
    return found.select("page_id", block.alias("front_matter"))


# Links and the walk

@query("lnk1_extract_links")
def _(pages):
    return links.links(pages)


@query("lnk1_extract_links_x")
def _(pages):
    return links.links(pages, prefix="/p/", via=["href"])


@query("lnk2_data_href_x")
def _(pages):
    return links.links(pages, via=["data-href"])


@query("lnk3_jsonld_links_x")
def _(pages):
    return links.links(pages, via=["json-ld"])


@query("lnk4_link_counts_x")
def _(pages):
    own = staged(pages.select("url"), url=U.normalize_url(F.col("url")))
    return links.link_counts(pages, own)


def _walk(walk: DataFrame) -> DataFrame:
    return walk.select("rank", "depth", "url", "status", F.coalesce("page_id", F.lit(-1)).alias("page_id"))


@query("crl1_crawl_x")
def _(pages):
    return _walk(crawl.crawl(pages, START))


@query("crl2_max_pages_x")
def _(pages):
    return _walk(crawl.crawl(pages, START, prefix="/p/", max_pages=10))


@query("crl3_prefix_x")
def _(pages):
    return _walk(crawl.crawl(pages, START, prefix="/p/"))


@query("crl4_single_x")
def _(pages):
    return _walk(crawl.crawl(pages, START, recursive=False))


@query("crl5_missing_pages")
def _(pages):
    start = pages.filter("page_id = 0").first()["url"]
    return crawl.crawl(pages, start).select("depth", "url", "status")


@query("crl6_resume_x")
def _(pages):
    stored = staged(pages.filter("page_id % 12 = 3").select("url"), file_path=U.site_file_path(F.col("url")))
    return _walk(crawl.crawl(pages, START, prefix="/p/", existing=stored.select("file_path")))


@query("crl7_crawl_summary_x")
def _(pages):
    walk, documents = corpus.crawl_site(pages, START, prefix="/p/", images=False, metadata=False)
    return crawl.crawl_summary(walk, documents)


@query("crl7_crawl_images_x")
def _(pages):
    """The images of a walk's saved pages beside its pages; those of every second page are stored already."""
    walk = crawl.crawl(pages, START, prefix="/p/")
    saved = walk.filter("status = 'saved'").select("page_id", F.col("url").alias("norm_url"))
    own = pages.join(saved, "page_id").withColumn("url", F.col("norm_url"))
    stored = images.image_set(own.filter("page_id % 2 = 0")).select(U.image_path(F.col("url")).alias("path"))
    none = pages.select("page_id", F.lit(0).cast("long").alias("word_count"), F.lit(0).cast("long").alias("estimated_tokens"))
    found = crawl.crawl_summary(walk, none, images.image_manifest(own, stored))
    return found.select("saved", "skipped", "images", "images_to_fetch", "images_existing", "image_collisions")


# Images

def _image_query(name: str, *via: str) -> None:
    @query(name)
    def _(pages):
        found = images.image_candidates(pages).filter(F.col("via").isin(list(via)))
        return found.select("page_id", "via", "url").distinct()


_image_query("img1_img_urls_x", "src", "data-src", "data-lazy-src", "data-original")
_image_query("img2_srcset_urls_x", "srcset")
_image_query("img3_css_background_x", "background")


@query("img4_image_set_x")
def _(pages):
    return images.image_set(pages)


@query("img5_image_manifest_x")
def _(pages):
    stored = images.image_set(pages.filter("page_id % 2 = 0")).select(U.image_path(F.col("url")).alias("path"))
    found = images.image_manifest(pages, stored)
    return found.select("url", "path", "status", F.col("collides").cast("string").alias("collides"))


@query("img6_alt_text_x")
def _(pages):
    return images.images(pages).select("page_id", "url", "alt")


@query("img7_image_heading_x")
def _(pages):
    return images.images(pages).select("page_id", "url", "heading")


@query("img8_inline_image_x")
def _(pages):
    rows = plan.markdown_rows(plan.with_targets(pages)).select("page_id", "in_body", "tag", "latex", "md")
    rows = staged(rows, in_body=F.col("in_body"), latex=F.col("latex"), md=F.col("md"))
    shown = rows.filter(F.col("in_body") & (F.col("tag") == "img") & F.col("latex").isNull() & (F.col("md") != ""))
    return shown.select("page_id", "md")


def _lines(documents: DataFrame, pattern: str) -> DataFrame:
    """(page_id, n, line): lines of the documents that match, in order."""
    lines = documents.select("page_id", F.posexplode(F.split("content", "\n")).alias("pos", "line"))
    return in_order(lines.filter(F.col("line").rlike(pattern)), "page_id").select("page_id", "n", "line")


@query("img9_place_image_x")
def _(pages):
    return _lines(plan.convert(pages), r"^!\[")


# Formulas

@query("mth1_mathml_alttext_x")
def _(pages):
    return _formulas(pages, "source = 'mathml'")


def _formulas(pages: DataFrame, which: str) -> DataFrame:
    found = mathml.formulas(pages).filter(which)
    return found.select("page_id", "source", F.col("is_block").cast("string").alias("is_block"), "latex")


@query("mth2_mathjax_script_x")
def _(pages):
    return _formulas(pages, "source = 'script'")


@query("mth3_katex")
def _(pages):
    span = F.concat(
        F.lit('<span class="katex'), F.when(F.col("page_id") % 2 == 0, "-display").otherwise(""), F.lit('"><span class="katex">'),
        F.lit('<math><semantics><mi>x</mi><annotation encoding="application/x-tex"> v_{'), F.col("page_id").cast("string"),
        F.lit('} </annotation></semantics></math><span class="katex-html">v</span></span></span>'))
    built = pages.withColumn("html", F.replace("html", F.lit("<article>"), F.concat(F.lit("<article>"), span)))
    return _formulas(built, "true")


@query("mth4_mjx_container_x")
def _(pages):
    return _formulas(pages, "source = 'mathjax'")


@query("mth5_equation_image_x")
def _(pages):
    return _formulas(pages, "source = 'image'")


@query("mth6_mathml_fold")
def _(pages):
    k = F.col("page_id").cast("string")
    formula = F.concat(
        F.lit("<math><mfrac><mrow><msup><mi>a</mi><mn>"), k, F.lit("</mn></msup><mo>&#8722;</mo><msqrt><mi>b</mi></msqrt></mrow><mfenced><mi>c"),
        F.lit("</mi><mn>"), k, F.lit("</mn></mfenced></mfrac><mo>&#8804;</mo><munderover><mo>&#8721;</mo><mi>i</mi><mi>max</mi></munderover></math>"))
    built = pages.withColumn("html", F.replace("html", F.lit("<article>"), F.concat(F.lit("<article>"), formula)))
    return _formulas(built, "true").select("page_id", "latex")


# Tables and code

@query("tbl1_flatten_nested")
def _(pages):
    k = F.col("page_id").cast("string")
    nested = F.concat(F.lit("<table><tr><td>a"), k, F.lit("<table><tr><td>n"), k, F.lit("</td><td><b>m</b></td></tr></table>z</td><td>b</td></tr></table>"))
    built = pages.withColumn("html", F.replace("html", F.lit("<article>"), F.concat(F.lit("<article>"), nested)))
    return tables.table_cells(built).select("page_id", "table_no", "row_no", "col_no", "text")


@query("tbl2_colspan_x")
def _(pages):
    cells = tables.table_cells(pages).filter("row_no = 1")
    return cells.select("page_id", "col_no", F.col("filled").cast("string").alias("filled"), "text")


@query("tbl3_rowspan_x")
def _(pages):
    cells = tables.table_cells(pages).filter("row_no = 3")
    return cells.select("page_id", "col_no", F.col("filled").cast("string").alias("filled"), "text")


@query("tbl2_wide_colspan")
def _(pages):
    wide = F.concat(F.lit('<article><table><tr><td colspan="'), (F.col("page_id") % 600 + 1000).cast("string"), F.lit('">w</td><td>v</td></tr></table>'))
    cells = tables.table_cells(pages.withColumn("html", F.replace("html", F.lit("<article>"), wide)))
    return cells.groupBy("page_id").agg(F.count("*").alias("n_cells"), count("n_filled", F.col("filled")), F.max(F.when(F.col("text") == "v", F.col("col_no"))).alias("v_col"))


@query("tbl3_tall_spans")
def _(pages):
    """A table per page in whose rows one cell spans 2 or 3 rows: all cells as laid out."""
    k = F.col("page_id")
    tall = F.transform(F.sequence(F.lit(1), F.lit(20)), lambda r: F.concat(
        F.lit('<tr><td rowspan="'), (F.lit(2) + (r + k) % 2).cast("string"), F.lit('">t'), r.cast("string"), F.lit("</td><td>p"), r.cast("string"), F.lit("</td></tr>")))
    built = pages.withColumn("html", F.concat(F.lit("<table>"), F.array_join(tall, ""), F.lit("</table>")))
    cells = tables.table_cells(built)
    return cells.groupBy("page_id", "row_no").agg(
        F.count("*").alias("n_cells"), F.max(F.when(F.startswith("text", F.lit("t")), F.col("col_no"))).alias("t_col"), F.max(F.when(F.startswith("text", F.lit("p")), F.col("col_no"))).alias("p_col"))


@query("tbl4_table_cells_x")
def _(pages):
    return tables.table_cells(pages).select(
        "page_id", "table_no", "row_no", "col_no", F.col("is_header").cast("string").alias("is_header"),
        F.col("filled").cast("string").alias("filled"), "text")


@query("cod1_code_lang_x")
def _(pages):
    return code.code_blocks(pages).select("page_id", F.coalesce("lang", F.lit("")).alias("lang"))


@query("cod2_code_fence_x")
def _(pages):
    rows = tokens.nodes(pages, markup_of=code.PRE).filter(F.col("markup").isNotNull())
    return rows.select("page_id", code.fence(F.col("markup")).alias("fence"))


@query("cod3_code_blocks_x")
def _(pages):
    return code.code_blocks(pages).select("page_id", "n", F.coalesce("lang", F.lit("")).alias("lang"), "code", "lines")


@query("cod3_language_counts_x")
def _(pages):
    return code.language_counts(pages)


# Markdown

def _line_query(name: str, pattern: str, **options) -> None:
    @query(name)
    def _(pages):
        return _lines(plan.convert(pages, metadata=False, **options), pattern)


_line_query("md1_headings", "^#")
_line_query("md1_headings_x", "^#")
_line_query("md4_line_break", r"  $", images=False)
_line_query("md5_links_x", r"^\[L\]", images=False)
_line_query("md6_images_x", r"^!\[Alt")
_line_query("md7_lists_x", r"^ +(?:\d+\.|\*) (?:one|two|sub)", images=False)
_line_query("md8_tables_x", r"^(?:h\||---\||r\d+\||\| w)", images=False)
_line_query("md9_code_x", r"^(?:```|p\(|_em_)", images=False)
_line_query("md10_blockquote_hr_x", r"^(?:>  ?quote|> quote|\* \* \*)", images=False)
_line_query("md11_escape_x", r"^(?:\d\\\.|\\-)", images=False)
_line_query("md12_abbr_x", r"^ *\*\[AB", images=False)


@query("md2_paragraphs")
def _(pages):
    bodies = plan.page_bodies(plan.with_targets(pages), local_images=False)
    parts = bodies.select("page_id", F.posexplode(F.split("body", "\n\n")).alias("pos", "paragraph"))
    return parts.select("page_id", (F.col("pos") + 1).cast("long").alias("n"), "paragraph")


@query("md3_emphasis")
def _(pages):
    bodies = plan.page_bodies(plan.with_targets(pages), local_images=False)
    strong = F.regexp_extract_all("body", F.lit(r"(?s)\*\*(.*?)\*\*"), F.lit(1))
    return bodies.select("page_id", F.posexplode(strong).alias("pos", "strong")).select("page_id", (F.col("pos") + 1).cast("long").alias("n"), "strong")


@query("md5_links_full")
def _(pages):
    return plan.page_bodies(plan.with_targets(pages), "full", local_images=False).select("page_id", "body")


@query("md13_assemble")
def _(pages):
    return plan.convert(pages, layout="single").select("page_id", "file_path", "content")


@query("md14_convert")
def _(pages):
    return plan.convert(pages)


@query("md14_convert_x")
def _(pages):
    return plan.convert(pages)


# Measures and reports

def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


QUERIES["txt1_word_count"] = lambda spark, sf_dir: _documents(spark, sf_dir).select(
    "doc_id", T.word_count(F.col("text")).alias("words"))
QUERIES["txt2_token_estimate"] = lambda spark, sf_dir: _documents(spark, sf_dir).select(
    "doc_id", T.token_estimate(T.word_count(F.col("text"))).alias("tokens"))
QUERIES["txt3_sizes"] = lambda spark, sf_dir: _documents(spark, sf_dir).select(
    "doc_id", T.char_count(F.col("text")).alias("chars"), T.byte_count(F.col("text")).alias("bytes"))


@query("rpt1_representation_report")
def _(pages):
    return report.representation_report(pages)


@query("rpt2_compression")
def _(pages):
    return report.compression(pages)


@query("rpt3_token_savings")
def _(pages):
    found = report.token_savings(pages)
    return found.withColumns({"host": F.coalesce("host", F.lit("")), "page_id": F.coalesce("page_id", F.lit(-1))})


QUERIES["rpt4_job_result"] = lambda spark, sf_dir: corpus.build_corpus(
    spark, f"{sf_dir}/pages.parquet", session.new_folder(spark, "corpus")).select(
    F.col("success").cast("string").alias("success"), F.col("data")["pages_saved"].alias("pages_saved"),
    F.col("data")["total_words"].alias("total_words"), F.coalesce("error", F.lit("")).alias("error"))


# User-facing jobs

@query("api1_convert_pages_x")
def _(pages):
    stored = plan.with_targets(pages.filter("page_id % 3 = 1"), "site").select("file_path")
    return corpus.convert_pages(pages, existing=stored).select("page_id", "url", "file_path")


@query("api2_crawl_site_x")
def _(pages):
    _, documents = corpus.crawl_site(pages, START, prefix="/p/", images=False)
    return documents.select("page_id", "url", "file_path")


def _build(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = session.new_folder(spark, "corpus")
    enriched_pages(spark, sf_dir).write.parquet(f"{folder}/captures")
    for _run in range(2):
        corpus.build_corpus(spark, f"{folder}/captures", f"{folder}/documents", START, prefix="/p/", images=False)
    return store.read_documents(spark, f"{folder}/documents").select("page_id", "site", "file_path")


QUERIES["api3_build_corpus_x"] = _build

"""Losses that small pages do not show: charsets, failed captures, equal paths, long references."""

import pytest
from pyspark.sql import functions as F

from pageloom.functions import markup
from pageloom.operators import crawl, tables, tokens
from pageloom.plans import corpus
from pageloom.sources import captures
from pageloom.streaming import ingest


@pytest.mark.parametrize("content,declared,text", [
    ("中文".encode("gbk"), "gbk", "中文"), ("Привет".encode("cp1251"), "Windows-1251", "Привет"), ("日本".encode("cp932"), "shift_jis", "日本"),
    ("한국".encode("cp949"), "euc-kr", "한국"), (b"\xff\xfe" + "aé".encode("utf-16le"), None, "aé"), (b"\xfe\xff" + "aé".encode("utf-16be"), "utf-16", "aé"),
    (b"\xef\xbb\xbfa\xc3\xa9", None, "aé"), (b"x" * 5000 + b'<meta charset="koi8-r">' + "да".encode("koi8-r"), None, "x" * 5000 + '<meta charset="koi8-r">да'),
    (b"\x93a\x94", "no-such-charset", "“a”"), (b"caf\xe9", "iso-8859-1", "café")])
def test_charsets(spark, content, declared, text):
    df = spark.createDataFrame([(bytearray(content), declared)], "c binary, d string")
    assert df.select(captures.decode_charset(F.col("c"), F.col("d")).alias("t")).first()["t"] == text


def test_long_hexadecimal_references(spark):
    df = spark.createDataFrame([("&#x00000000000041;&#0000000000000066;&#xFFFFFFFFFFFFFFFFFF;",)], "t string")
    assert df.select(markup.decode_references(F.col("t"))).first()[0] == "AB�"


def test_pages_of_many_hosts_all_stay(spark):
    pages = spark.createDataFrame([(i, f"https://h{i}.example.org/index.html", "<html><body><p>Text</p></body></html>") for i in range(12)], "page_id long, url string, html string")
    assert corpus.convert_pages(pages, metadata=False, images=False).select("page_id").count() == 12


def test_a_good_capture_wins_over_an_earlier_failed_one(spark):
    rows = spark.createDataFrame([("u", 1, False), ("u", 5, True), ("u", 7, True), ("v", 2, False)], "url string, page_id long, ok boolean")
    assert sorted(map(tuple, crawl.one_per_url(rows).collect())) == [("u", 5, True), ("v", 2, False)]


def test_unknown_ingest_options_are_refused(spark, tmp_path):
    with pytest.raises(TypeError):
        ingest.ingest(spark, str(tmp_path), str(tmp_path), str(tmp_path), extractr="full")


def test_equal_paths_within_a_walk(spark):
    def page(*targets):
        return "<html><body>" + "".join(f'<a href="{t}">x</a>' for t in targets) + "</body></html>"

    found = {"https://h/s": page("/a", "/a.html"), "https://h/a": page("/b"), "https://h/a.html": page("/z"), "https://h/b": page(), "https://h/z": page()}
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(found.items())], "page_id long, url string, html string")
    walk, documents = corpus.crawl_site(pages, "https://h/s", metadata=False, images=False)
    by_path = [(r.file_path, r.status) for r in walk.orderBy("rank").collect()]
    assert [s for _, s in by_path] == ["saved", "saved", "exists", "saved"] and by_path[1][0] == by_path[2][0]
    assert documents.select("page_id").count() == 3
    limited = crawl.crawl(pages, "https://h/s", max_pages=3).filter("status = 'saved'").select("url").collect()
    assert {r.url for r in limited} == {"https://h/s", "https://h/a", "https://h/b"}
    again = crawl.crawl(pages, "https://h/s", overwrite=True)
    assert again.filter("status = 'saved'").count() == 5


def test_links_nobody_closed_hold_no_text_of_the_rest(spark):
    def total(n):
        html = "<html><body><article>" + "".join(f"<a name=n{i}>some words in a line {i} " for i in range(n)) + "</article></body></html>"
        df = spark.createDataFrame([(1, html)], "page_id long, html string")
        return tokens.nodes(df, text_of={"a": "tag"}).agg(F.sum(F.char_length("text"))).first()[0]

    assert total(400) < 2.5 * total(200)


def test_text_of_cells_nobody_closed(spark):
    html = "<table><tr><td>a<td>b <b>c</b><table><tr><td>n</td></tr></table>d<tr><td>e</td>stray<td>f</table>"
    cells = tables.table_cells(spark.createDataFrame([(1, html)], "page_id long, html string"))
    assert [r.text for r in cells.orderBy("row_no", "col_no").collect()] == ["a", "b c n d", "e", "f"]

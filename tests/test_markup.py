import html
import time
from html.parser import HTMLParser

from pyspark.sql import functions as F

from pageloom.functions import markup as M
from pageloom.operators import tokens

PAGES = "/root/testdata/sf0.001/pages.parquet"


def test_references(spark):
    text = "a &amp; &copy;2 &nbsp;x &#39;&#x27;&#8364;&#128;&#x1F600; &am &ampx; &unknown; &#0; &amp;amp; &NotEqualTilde; &rsquo;"
    row = spark.range(1).select(M.decode_references(F.lit(text)).alias("t")).first()
    assert row["t"] == "a & ©2 \xa0x ''€€😀 &am &ampx; &unknown; � &amp; ≂̸ ’"


def test_attributes(spark):
    tag = """<A HREF='x>y' b=c&amp;d e data-x="1 > 2" b=last title="it's">"""
    row = spark.range(1).select(M.attributes(F.lit(tag)).alias("a")).first()
    assert [(a["name"], a["value"]) for a in row["a"]] == [
        ("href", "x>y"), ("b", "c&d"), ("e", ""), ("data-x", "1 > 2"), ("b", "last"), ("title", "it's")]


def test_hostile_markup_is_lossless(spark, pages):
    hostile = [
        None, "", "<", "<" * 3000, "<!-- open", "<script>var a = '</p>';", "a < b <c", "<p title='>'>x</p>", "<a href=\"x>y",
        "x" * 1_000_000, "<p a=\"" + "y" * 1_000_000 + "\">", "<p " + " ".join(f'a{i}="{i}"' for i in range(100_000)) + ">",
        "< " * 100_000, "<a" * 50_000, "<p>" * 20_000]
    started = time.time()
    df = pages(*hostile)
    joined = tokens.raw_tokens(df).groupBy("page_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("pos", "tok")))["tok"], "").alias("j"))
    back = {r["page_id"]: r["j"] for r in joined.collect()}
    assert all(back.get(i + 1, "") == (h or "") for i, h in enumerate(hostile))
    assert tokens.plaintext(df).count() == len(hostile)
    assert time.time() - started < 120


def test_tree_closes_like_a_stack(spark, pages):
    rows = tokens.nodes(pages("<div><p>a<p>b</div>c</p><ul><li>x<li>y</ul><br/><td/>z"), text_of={"p": None, "div": None}).orderBy("pos").collect()
    shown = [(r["kind"], r["tag"], r["mate"], r["text"]) for r in rows if r["tag"]]
    assert shown == [
        ("open", "div", 7, "ab"), ("open", "p", 6, "ab"), ("open", "p", 5, "b"), ("close", "p", 3, None), ("close", "p", 1, None),
        ("close", "div", 0, None), ("open", "ul", 16, None), ("open", "li", 15, None), ("open", "li", 14, None), ("close", "li", 12, None),
        ("close", "li", 10, None), ("close", "ul", 9, None), ("empty", "br", -1, None), ("empty", "td", -1, None)]


class Outline(HTMLParser):
    """Second opinion: text nodes of a page by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        self.found.append(None)

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style")
        self.found.append(None)

    def handle_comment(self, data):
        self.found.append(None)

    def handle_data(self, data):
        if not self.hidden:
            self.found.append(data)


def test_plaintext_agrees_with_the_standard_parser(spark):
    df = spark.read.parquet(PAGES)
    ours = {r["page_id"]: r["plaintext"] for r in tokens.plaintext(df).collect()}
    for row in df.collect():
        outline = Outline()
        outline.feed(row["html"])
        outline.close()
        nodes, run = [], ""
        for piece in [*outline.found, None]:
            if piece is None:
                nodes.append(run.strip())
                run = ""
            else:
                run += piece
        assert ours[row["page_id"]] == "\n".join(n for n in nodes if n), row["page_id"]


def test_result_does_not_depend_on_partitioning(spark):
    df = spark.read.parquet(PAGES)
    one = tokens.nodes(df.coalesce(1)).select("page_id", "pos", "kind", "mate", "parent")
    many = tokens.nodes(df.repartition(7)).select("page_id", "pos", "kind", "mate", "parent")
    assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0
    assert html.unescape("&amp;") == "&"

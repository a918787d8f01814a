import pytest
from pyspark.sql import functions as F

from pageloom.operators import code, extract, images, mathml, tables
from pageloom.operators import metadata as meta
from pageloom.sources import captures

MATHML = [
    ("<math><mi>x</mi><mo>+</mo><mi>sin</mi><mn>2</mn></math>", r"x + \mathrm{sin} 2"),
    ("<math><msup><mi>a</mi><mn>2</mn></msup></math>", "{a}^{2}"),
    ("<math><msub><mi>a</mi></msub></math>", "a"),
    ("<math><msubsup><mi>a</mi><mn>1</mn><mn>2</mn></msubsup><msubsup><mi>a</mi><mn>1</mn></msubsup></math>", "{a}_{1}^{2} a 1"),
    ("<math><mfrac><mrow><mi>a</mi><mo>&times;</mo><mi>b</mi></mrow><msqrt><mi>c</mi><mi>d</mi></msqrt></mfrac></math>", r"\frac{a \times b}{\sqrt{cd}}"),
    ("<math><mroot><mi>x</mi><mn>3</mn></mroot></math>", r"\sqrt[3]{x}"),
    ("<math><mover><mi>x</mi><mo>→</mo></mover><munder><mi>x</mi><mi>y</mi></munder></math>", r"\overset{\to}{x} \underset{y}{x}"),
    ("<math><munderover><mo>∑</mo><mi>i</mi><mi>n</mi></munderover></math>", r"{\sum}_{i}^{n}"),
    ("<math><mtext> if </mtext><mtext></mtext><mi>z</mi></math>", r"\text{if}  z"),
    ("<math><mi>a</mi><mspace width='1em'/><mi>b</mi></math>", r"a \; b"),
    ("<math><mtable><mtr><mtd><mi>a</mi></mtd><mtd><mi>b</mi><mi>q</mi></mtd></mtr> <mtr><mtd><mi>c</mi></mtd><mtd><mi>d</mi></mtd></mtr></mtable></math>",
     r"\begin{matrix} a & b q \\ c & d \end{matrix}"),
    ("<math><mfenced><mi>a</mi><mi>b</mi></mfenced></math>", r"\left( a , b \right)"),
    ("<math><mfenced open='[' close='}' separators=';'><mi>a</mi><mfrac><mi>b</mi><mn>1</mn></mfrac></mfenced></math>", r"\left[ a ; \frac{b}{1} \right}"),
    ('<math><semantics><mrow><mi>x</mi></mrow><annotation encoding="application/x-tex"> x^{q} &lt; 1 </annotation></semantics></math>', "x^{q} < 1"),
    ('<math><semantics><mrow><mi>x</mi><mi>y</mi></mrow><annotation-xml encoding="MathML-Content"><ci>x</ci></annotation-xml></semantics></math>', "x y"),
    ("<math><mstyle><mpadded><mi>a</mi></mpadded><mo>&lt;</mo><mi>b</mi></mstyle></math>", "a < b"),
    ("<math>" + "<msup>" * 10 + "<mi>x</mi>" + "<mn>2</mn></msup>" * 10 + "</math>", "{" * 10 + "x" + "}^{2}" * 10),
    ("<math><mo>{</mo><mo>*</mo><mo>(</mo></math>", r"\{ \ast ("),
]


def test_mathml(spark, pages):
    found = mathml.formulas(pages(*[m for m, _ in MATHML])).collect()
    assert {r["page_id"]: r["latex"] for r in found} == {i + 1: latex for i, (_, latex) in enumerate(MATHML)}


def test_formula_sources(spark, pages):
    katex = ('<span class="katex-display"><span class="katex"><math><semantics><mi>v</mi><annotation encoding="application/x-tex">v^2</annotation>'
             '</semantics></math><span class="katex-html">v2</span></span></span>')
    found = mathml.formulas(pages(
        katex, '<p>long text around <img src="/eq.png" alt="x_1"> here</p>', '<img src="/math.svg" title="t"><img src="/cat.png" alt="cat">',
        '<script type="math/tex">a</script>', "<math></math><mjx-container></mjx-container>")).orderBy("page_id", "pos").collect()
    assert [(r["page_id"], r["source"], r["is_block"], r["latex"]) for r in found] == [
        (1, "katex", True, "v^2"), (2, "image", False, "x_1"), (3, "image", False, "t"), (4, "script", False, "a")]


def grid(rows):
    out = {}
    for r in rows:
        out.setdefault((r["table_no"], r["row_no"]), []).append((r["col_no"], r["text"]))
    return [[t for _, t in sorted(cells)] for _, cells in sorted(out.items())]


@pytest.mark.parametrize("html, expected", [
    ("<table><tr><td rowspan=2>a</td><td rowspan=3>b</td><td>c</td></tr><tr><td>d</td></tr><tr><td>e</td><td>f</td></tr></table>",
     [["a", "b", "c"], ["", "", "d"], ["e", "", "f"]]),
    ("<table><tr><td colspan='100%'>a</td><td colspan=2>b</td></tr><tr><td rowspan=9>c</td></tr></table>", [["a", "b", ""], ["c"]]),
    ("<table><tr><td rowspan=2>a</td></tr><tr></tr><tr><td>b</td></tr></table><table><tr><th>x", [["a"], [""], ["b"], ["x"]]),
    ("<table><thead><tr><th rowspan=2>a</th></tr></thead><tbody><tr><td>b</td></tr></tbody></table>", [["a"], ["b"]]),
    ("<table><tr><td>a<table><tr><td>n</td><td>m</td></tr></table></td></tr></table>", [["a n m"]]),
])
def test_table_cells(spark, pages, html, expected):
    assert grid(tables.table_cells(pages(html)).collect()) == expected


@pytest.mark.parametrize("tag, lang", [
    ('<code class="hl language-x y">', "x"), ('<code class="python lang-sql">', "sql"), ('<code class="a Rust sql">', "rust"), ("<code>", None), ("", None)])
def test_code_lang(spark, tag, lang):
    assert spark.range(1).select(code.code_lang(F.lit(tag)).alias("l")).first()["l"] == lang


def test_json_ld(spark, pages):
    def ld(*payloads):
        return "".join(f'<script type="application/ld+json">{p}</script>' for p in payloads)

    rows = meta.metadata(pages(
        ld('[{"@type":"Thing","headline":"n"},{"@type":"Article","headline":"h","author":{"x":1}},{"@type":"WebPage","headline":"late"}]'),
        ld('{"@type":["Article"],"headline":"n"}', '{"@graph":[{"@type":"Article","headline":"n"}]}', "{bad"),
        ld('{"@type":"Article","headline":"one","description":"d"}', '{"@type":"WebPage","headline":"two","author":["A",{"name":"B"},{"n":1},3]}'),
        '<meta name="description" content=""><meta name="description" content="second"><title> t &amp; u </title><time>x</time><time datetime="2020">y</time>',
    )).orderBy("page_id").collect()
    assert [(r["title"], r["description"], r["author"], r["schema_type"], r["published"]) for r in rows] == [
        ("h", None, None, "Article", None), (None, None, None, None, None), ("two", "d", "A, B", "WebPage", None), ("t & u", None, None, None, "2020")]


def test_image_headings(spark, pages):
    html = ('<p>a paragraph of some length</p><img src="a.png"><h2>Tit<b>le</b> one</h2><img src="b.png" alt=" B "><h3>abc</h3><img src="c_d-e.png">'
            '<h1>In <img src="f.png"> side</h1><img data-src="g.png">')
    rows = {r["url"].rsplit("/", 1)[1]: (r["alt"], r["heading"], r["rel_path"]) for r in images.images(pages(html)).collect()}
    assert rows == {
        "a.png": ("a", "a paragraph of some length", "../images/a/a.png"), "b.png": ("B", "Titleone", "../images/a/b.png"),
        "c_d-e.png": ("c d e", "Titleone", "../images/a/c_d-e.png"), "f.png": ("f", "Inside", "../images/a/f.png"), "g.png": ("g", "", "../images/a/g.png")}


def test_density_prefers_the_article(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    text = {r["page_id"]: r["text"] for r in extract.region_text(df, "density").collect()}
    chosen = {r["page_id"] for r in extract.dense_blocks(df).collect()}
    for row in df.collect():
        if row["page_id"] in chosen:
            assert "©" not in text[row["page_id"]]
            assert row["html"].split("<li>")[1].split(">")[1].split("<")[0] + "\n" not in text[row["page_id"]][:5]
    assert len(chosen) >= 45


@pytest.mark.parametrize("content, declared, text", [
    ("é".encode(), "ISO-8859-1", "é"), ("é".encode("cp1252"), "windows-1252", "é"), ("€".encode("cp1252"), None, "€"),
    ("é".encode("utf-16-le"), "utf-16le", "é"), (b"\xff\xfea", "utf-8", "��a"), ("ü".encode(), None, "ü")])
def test_decode_charset(spark, content, declared, text):
    df = spark.createDataFrame([(bytearray(content), declared)], "c binary, d string")
    assert df.select(captures.decode_charset(F.col("c"), F.col("d")).alias("t")).first()["t"] == text

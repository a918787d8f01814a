"""Quoted '>' in tags, repeated JSON keys, wide and tall table cells."""

import time
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pageloom.operators import balance, code, extract, images, links, mathml, tables
from pageloom.operators import metadata as meta


def laid_out(rows):
    """The same layout on plain lists: spans in document order, each put into what the earlier ones left."""
    grid, owner = [], {}
    for r, cells in enumerate(rows):
        line = []
        for c, (text, across, _) in enumerate(cells):
            owner[r, c] = object()
            line += [(owner[r, c], text)] + [(None, "")] * (across - 1)
        grid.append(line)
    for r, cells in enumerate(rows):
        for c, (_, _, down) in enumerate(cells):
            at = [o for o, _ in grid[r]].index(owner[r, c])
            for below in grid[r + 1 : r + down]:
                below.insert(at, (None, "")) if at < len(below) else below.append((None, ""))
    return [[t for _, t in line] for line in grid]


def markup(rows):
    return "<table>" + "".join("<tr>" + "".join(f"<td colspan={a} rowspan={d}>{t}</td>" for t, a, d in cells) + "</tr>" for cells in rows) + "</table>"


def grids(found):
    out = {}
    for r in found.collect():
        out.setdefault((r.page_id, r.row_no), []).append((r.col_no, r.text))
    return {k: [t for _, t in sorted(v)] for k, v in out.items()}


def test_spans_against_plain_lists(spark, pages):
    import random

    rng = random.Random(7)
    made = [[[(f"{r}.{c}", rng.choice([1, 1, 2, 3]), rng.choice([1, 1, 2, 3, 9])) for c in range(rng.randrange(1, 6))] for r in range(rng.randrange(1, 9))] for _ in range(60)]
    found = grids(tables.table_cells(pages(*map(markup, made))))
    for k, rows in enumerate(made):
        for r, line in enumerate(laid_out(rows)):
            assert found[k + 1, r + 1] == line


def test_many_row_spans_do_not_take_quadratic_time(spark, pages):
    """Rows of which each has a cell that spans the next: four times the rows take well under sixteen times as long."""
    def took(n):
        rows = [[(str(r), 1, 2), ("b", 1, 1)] for r in range(n)]
        built = pages(markup(rows)).cache()
        started = time.perf_counter()
        found = {r.row_no: r.cells for r in tables.table_cells(built).groupBy("row_no").agg(F.count("*").alias("cells")).collect()}
        assert len(found) == n and found[1] == 2 and all(found[r] == 3 for r in range(2, n + 1))
        return time.perf_counter() - started

    took(200)
    few = took(2000)
    assert took(8000) < 8 * few


@pytest.mark.parametrize("width", [1500, 200_000])
def test_wide_cells_have_no_cap(spark, pages, width):
    html = f"<table><tr><td colspan={width}>a</td><td rowspan=2>b</td></tr><tr><td>c</td><td colspan=3>d</td></tr></table>"
    by_row = {r.row_no: (r.n, r.most) for r in tables.table_cells(pages(html)).groupBy("row_no").agg(F.count("*").alias("n"), F.max("col_no").alias("most")).collect()}
    assert by_row == {1: (width + 1, width + 1), 2: (5, 5)}


QUOTED = ['<div title="a>b" id="content"><p>in</p></div><p>out</p>', "<div title='a>b' class='x post-body'>in</div>out"]


def test_quoted_ends_of_tags_do_not_hide_what_follows(spark, pages):
    rules = extract.regions(pages(*QUOTED)).orderBy("page_id").collect()
    assert [r.rule for r in rules] == [4, 5]
    cells = tables.table_cells(pages('<table><tr><td title="a>b" colspan=2>x</td></tr></table>'))
    assert [r.col_no for r in cells.orderBy("col_no").collect()] == [1, 2]
    items = meta.json_ld_items(pages('<script data-x="a>b" type="application/ld+json">{"@type":"Article","headline":"h"}</script>'))
    assert [r.headline for r in items.collect()] == ["h"]
    found = links.link_candidates(pages("""<span title="a > b" data-href="/x"></span><script>var s = '<b data-href="/no">';</script><a title='>' href=/y>z</a>"""))
    assert sorted((r.via, r.target) for r in found.collect()) == [("data-href", "https://h.example.org/x"), ("href", "https://h.example.org/y")]
    shown = images.image_candidates(pages('<div title="a>b" style="background-image: url(/i.png)"></div>'))
    assert shown.count() == 1
    assert spark.range(1).select(code.code_lang(code.code_tag(F.lit('<pre><code title="a>b" class="language-x">1</code></pre>'))).alias("l")).first()["l"] == "x"
    katex = '<span title="a>b" class="katex"><math><annotation encoding="application/x-tex">x^2</annotation></math></span>'
    assert [r.latex for r in mathml.formulas(pages(katex)).collect()] == ["x^2"]


def test_last_of_repeated_json_keys(spark, pages):
    script = '<script type="application/ld+json">{"@type":"Thing","headline":"a","@type":"Article","headline":"b","author":{"name":"x","name":"y"},"url":"http://h.example.org/1","url":"http://h.example.org/2"}</script>'
    row = meta.metadata(pages(script)).first()
    assert (row.title, row.author, row.schema_type) == ("b", "y", "Article")
    assert [r.target for r in links.link_candidates(pages(script)).collect()] == ["http://h.example.org/2"]


def test_the_tree_of_a_batch_takes_little_memory():
    """The Python step hands positions back part by part: 2,000 pages of 300 marks are never objects all at once."""
    page = ["div", "p", "#", "/p", "ul", "li", "#", "li", "", "/ul", "img!!", "/b"] * 25
    pages = [page] * 2000 + [None, [], page * 50, ["/p"]]
    batch = pa.array(pages, pa.list_(pa.string()))
    tracemalloc.start()
    rows, at_once = 0, 0
    for part in balance.balance_pages.func(iter([batch.slice(1)])):
        rows += len(part)
        at_once = max(at_once, len(part.field(0).values))
        for k, tree in zip((0, -1), (part[0], part[len(part) - 1]), strict=True):
            marks = pages[1 + rows - (len(part) if k == 0 else 1)]
            assert [list(v) for v in tree.as_py().values()] == [list(v) for v in balance._balance(marks or [])]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == len(pages) - 1 and at_once <= 2 * balance.PART
    assert peak < 16 << 20  # as lists of numbers for the whole batch 35 MB

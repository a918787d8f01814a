"""HTML tables as cells, with column and row spans laid out.

A row is a list of runs of equal cells, so a column span costs one run however wide it is; runs become cells only where
rows are returned or written out. Row spans are laid out in one sweep down the rows, which carries the spans still open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions import markup as M
from pageloom.functions import text as T
from pageloom.operators import staged
from pageloom.operators.tokens import doc_order, inside, nodes, with_attrs

SWEEP = 128  # rows laid out before they are put behind the ones above
PART = 1 << 16  # cells of a run made at a time

def span(value: Column) -> Column:
    """A colspan or rowspan as a number; anything unreadable counts as 1."""
    return F.greatest(F.coalesce(F.trim(value).try_cast("int"), F.lit(1)), F.lit(1))


def table_depth(counted: Column | None = None) -> Column:
    """How many tables are open at a row; only those on ``counted`` rows are seen."""
    is_table = F.col("tag") == "table"
    return inside(is_table if counted is None else is_table & counted)


def table_places() -> dict[str, Column]:
    """Window columns telling which table, row and table body a row of nodes with ``table_depth`` belongs to."""
    def latest(*names: str) -> Column:
        """Start of the element opened last; a cell or row someone forgot to close ends where the next starts."""
        opened = (F.col("kind") == "open") & F.col("tag").isin(*names) & (F.col("table_depth") == 1)
        return F.max(F.when(opened, F.col("pos"))).over(doc_order())

    return {"table_pos": latest("table"), "_tr": latest("tr"), "_body": latest("table", "thead", "tbody", "tfoot")}


def with_cell_text(rows: DataFrame) -> DataFrame:
    """Add ``text`` on cells of outermost tables: their text nodes, stripped, joined by a space.

    A node belongs to the cell that starts last before it, if that has not ended; so text is held once, however many
    cells nobody closed. ``rows`` hold ``table_depth``.
    """
    kind = F.col("kind")
    starts = (kind == "open") & F.col("tag").isin("td", "th") & (F.col("table_depth") == 1)
    rows = rows.withColumn("_cell", F.max(F.when(starts, F.struct("pos", "mate"))).over(doc_order()))
    inner = kind.isin("text", "rcdata") & (F.col("pos") < F.col("_cell.mate"))
    rows = rows.withColumns({"_cell": F.col("_cell.pos"), "_piece": F.when(inner, T.strip(M.token_text(kind, F.col("tok"))))})
    whole = Window.partitionBy("page_id", "_cell").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pieces = F.collect_list(F.when(F.col("_piece") != "", F.col("_piece"))).over(whole)
    return rows.withColumn("text", F.when(starts, F.array_join(pieces, " "))).drop("_cell", "_piece")


def with_entries(rows: DataFrame) -> DataFrame:
    """Add ``entry`` on rows and cells of outermost tables: struct(pos, tr, body, across, down, is_cell, ...).

    ``rows`` hold ``attrs``, ``table_depth`` and ``table_places``.
    """
    opens, tag = F.col("kind") == "open", F.col("tag")
    is_cell = tag.isin("td", "th")
    spans = F.col("attrs")
    entry = F.struct(
        "pos",
        F.when(F.col("_tr") > F.col("_body"), F.col("_tr")).otherwise(F.col("_body")).alias("tr"), F.col("_body").alias("body"),
        span(M.attribute(spans, "colspan")).alias("across"),
        span(M.attribute(spans, "rowspan")).alias("down"),
        is_cell.alias("is_cell"), (tag == "th").alias("is_header"),
        F.when(tag == "tr", F.col("mate")).alias("row_end"), F.col("table_pos").alias("table_pos"),
        F.coalesce(F.when(is_cell, F.col("text")), F.lit("")).alias("text"))
    wanted = opens & (F.col("table_depth") == 1) & (is_cell | (tag == "tr"))
    return rows.withColumn("entry", F.when(wanted, entry)).drop("_tr", "_body")


def _cell(origin: Column, text: Column, filled: bool, n: Column) -> Column:
    return F.struct(
        origin["pos"].alias("pos"), origin["is_header"].alias("is_header"), text.alias("text"), F.lit(filled).alias("filled"), n.cast("int").alias("n"))


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _inserted(cells: Column, at: Column, cell: Column) -> Column:
    """Runs with a cell put before the column of this number (from 0), or behind all if there are fewer."""
    start = F.struct(F.lit(0).alias("runs"), at.cast("long").alias("left"), F.lit(False).alias("met"))

    def step(seen: Column, run: Column) -> Column:
        here = seen["met"] | (seen["left"] < run["n"])
        return F.struct(
            (seen["runs"] + F.when(here, 0).otherwise(1)).alias("runs"),
            F.when(here, seen["left"]).otherwise(seen["left"] - run["n"]).alias("left"), here.alias("met"))

    def put(place: Column) -> Column:
        split = F.get(cells, place["runs"])
        cut = F.when(place["met"] & (place["left"] > 0), F.array(_cell(split, split["text"], True, place["left"]), cell, _cell(
            split, split["text"], True, split["n"] - place["left"]))).otherwise(F.array(cell))
        rest = place["runs"] + F.when(place["met"] & (place["left"] > 0), 2).otherwise(1)
        return F.concat(F.slice(cells, F.lit(1), place["runs"]), cut, F.slice(cells, rest, F.size(cells) + 1))

    return _bound(F.aggregate(cells, start, step), put)


def _column_of(cells: Column, pos: Column) -> Column:
    """The column (from 0) of the cell that starts at a position of the page."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(False).alias("met"))

    def step(seen: Column, run: Column) -> Column:
        here = seen["met"] | (~run["filled"] & (run["pos"] == pos))
        return F.struct((seen["at"] + F.when(here, 0).otherwise(run["n"])).alias("at"), here.alias("met"))

    return F.aggregate(cells, start, step)["at"]


def _laid(r: Column, cells: Column) -> Column:
    return F.struct(r["table_pos"].alias("table_pos"), r["tr"].alias("tr"), r["row_end"].alias("row_end"), r["body"].alias("body"), cells.alias("cells"))


def _swept(rows: Column) -> Column:
    """The grid of rows with ``tall`` cells: each open span puts a cell into each row of its body that it reaches.

    Open spans are kept in document order and put in one after the other, as each was laid into what the earlier ones left.
    """
    open_spans = "array<struct<column:bigint,left:int,body:int,pos:int,is_header:boolean>>"

    def step(acc: Column, r: Column) -> Column:
        here = F.filter(acc["spans"], lambda a: a["body"] == r["body"])
        filled = F.aggregate(here, r["cells"], lambda cells, a: _inserted(cells, a["column"], _cell(a, F.lit(""), True, F.lit(1))))

        def carried(cells: Column) -> Column:
            begun = F.transform(r["tall"], lambda t: F.struct(
                _column_of(cells, t["pos"]).alias("column"), t["down"].alias("left"), r["body"].alias("body"), t["pos"].alias("pos"), t["is_header"].alias("is_header")))
            left = F.transform(F.concat(acc["spans"], begun.cast(open_spans)), lambda a: F.struct(
                a["column"].alias("column"), (a["left"] - 1).alias("left"), a["body"].alias("body"), a["pos"].alias("pos"), a["is_header"].alias("is_header")))
            return F.struct(F.concat(acc["done"], F.array(_laid(r, cells))).alias("done"), F.filter(left, lambda a: a["left"] > 0).cast(open_spans).alias("spans"))

        return _bound(filled, carried)

    nothing = F.transform(F.slice(rows, 1, 0), lambda r: _laid(r, r["cells"]))
    chunks = F.transform(F.sequence(F.lit(0), F.size(rows) - 1, F.lit(SWEEP)), lambda at: F.slice(rows, at + 1, F.lit(SWEEP)))

    def chunk(acc: Column, part: Column) -> Column:
        swept = F.aggregate(part, F.struct(nothing.alias("done"), acc["spans"].alias("spans")), step)
        return _bound(swept, lambda x: F.struct(F.concat(acc["done"], x["done"]).alias("done"), x["spans"].alias("spans")))

    return F.aggregate(chunks, F.struct(nothing.alias("done"), F.array().cast(open_spans).alias("spans")), chunk)["done"]


def with_grid(groups: DataFrame) -> DataFrame:
    """Turn ``entries`` (rows and cells in document order) into ``grid``: array<struct<table_pos, tr, row_end, body, cells>>.

    A cell is struct(pos, is_header, text, filled, n); filled ones stand for the columns and rows a span covers, n side
    by side.
    """
    first = F.filter(
        F.transform("entries", lambda e, i: F.when((i == 0) | (e["tr"] != F.get("entries", i - 1)["tr"]), i)), lambda i: i.isNotNull())
    groups = staged(groups, starts=first)

    def wide(e: Column) -> Column:
        own = F.array(_cell(e, e["text"], False, F.lit(1)))
        return F.when(e["across"] > 1, F.concat(own, F.array(_cell(e, F.lit(""), True, e["across"] - 1)))).otherwise(own)

    def row(start: Column, n: Column) -> Column:
        stop = F.coalesce(F.get("starts", n + 1), F.size("entries"))
        cells = F.filter(F.slice("entries", start + 1, stop - start), lambda e: e["is_cell"])
        return F.struct(
            F.get("entries", start)["table_pos"].alias("table_pos"), F.get("entries", start)["tr"].alias("tr"), F.get("entries", start)["row_end"].alias("row_end"),
            F.get("entries", start)["body"].alias("body"),
            F.flatten(F.transform(cells, wide)).alias("cells"),
            F.transform(F.filter(cells, lambda e: e["down"] > 1), lambda e: F.struct(
                e["pos"].alias("pos"), e["is_header"].alias("is_header"), e["down"].alias("down"))).alias("tall"))

    groups = staged(groups, rows=F.transform("starts", row))
    grid = F.when(F.exists("rows", lambda r: F.size(r["tall"]) > 0), _swept(F.col("rows"))).otherwise(F.transform("rows", lambda r: _laid(r, r["cells"])))
    return staged(groups.drop("starts"), grid=grid).drop("rows", "entries")


def table_cells(pages: DataFrame) -> DataFrame:
    """(page_id, table_no, row_no, col_no, is_header, filled, text): all cells of all tables, numbered from 1."""
    rows = with_cell_text(with_attrs(nodes(pages)).withColumn("table_depth", table_depth()))
    rows = with_entries(rows.withColumns(table_places()))
    rows = rows.filter(F.col("entry").isNotNull())
    groups = rows.groupBy("page_id", "table_pos").agg(F.sort_array(F.collect_list("entry")).alias("entries"))
    placed = with_grid(groups).withColumn("table_no", F.row_number().over(Window.partitionBy("page_id").orderBy("table_pos")))
    placed = placed.select("page_id", "table_no", F.posexplode("grid").alias("r", "row")).select("page_id", "table_no", (F.col("r") + 1).alias("row_no"), "row.cells")
    # Columns of a run follow from the widths before it; wide runs become cells a part at a time, never as one array.
    ends = F.aggregate("cells", F.array().cast("array<bigint>"), lambda e, c: F.concat(e, F.array(F.coalesce(F.element_at(F.concat(F.array(F.lit(0).cast("long")), e), -1), F.lit(0)) + c["n"])))
    runs = placed.withColumn("ends", ends).select("page_id", "table_no", "row_no", F.inline(F.arrays_zip("cells", "ends"))).withColumn("before", F.col("ends") - F.col("cells.n"))
    parts = runs.withColumn("part", F.explode(F.sequence(F.lit(0), F.expr(f"cast((cells.n - 1) div {PART} as int)"))))
    cells = parts.withColumn("k", F.explode(F.sequence(F.lit(0), F.least(F.col("cells.n") - F.col("part") * PART, F.lit(PART)) - 1)))
    return cells.select(
        "page_id", "table_no", "row_no", (F.col("before") + F.col("part") * PART + F.col("k") + 1).cast("int").alias("col_no"), "cells.is_header", "cells.filled", "cells.text")

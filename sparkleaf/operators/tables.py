"""Sheets and tables: merged cells, synthetic grids, lattice structure, renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry
from .grouped import numbered

SHEET = ["doc_id", "sheet_no"]


def visible_cells(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Cells (doc_id, sheet_no, row_index, col_index, value) that no merge swallows, with merged_width and merged_height.

    merges: (doc_id, sheet_no, r0, c0, r1, c1), ends included. Only a merge's top left cell stays, with its size; others are 1 by 1.
    """
    m = merges.select(*SHEET, "r0", "c0", "r1", "c1")
    hidden = cells.join(m, SHEET).where(F.col("row_index").between(F.col("r0"), F.col("r1")) & F.col("col_index").between(F.col("c0"), F.col("c1")) & ((F.col("row_index") != F.col("r0")) | (F.col("col_index") != F.col("c0")))).select(*SHEET, "row_index", "col_index").distinct()
    kept = cells.join(hidden, [*SHEET, "row_index", "col_index"], "left_anti")
    spans = m.select(*SHEET, F.col("r0").alias("row_index"), F.col("c0").alias("col_index"), (F.col("c1") - F.col("c0") + 1).alias("__w"), (F.col("r1") - F.col("r0") + 1).alias("__h"))
    out = kept.join(spans, [*SHEET, "row_index", "col_index"], "left")
    return out.select(*cells.columns, F.col("__w").isNotNull().alias("is_merged_cell"), F.coalesce("__w", F.lit(1)).alias("merged_width"), F.coalesce("__h", F.lit(1)).alias("merged_height"))


def cell_boxes(cells: DataFrame, size: int = 10) -> DataFrame:
    """All columns and x0, y0, x1, y1: a grid of squares, spans included."""
    c, r = F.col("col_index"), F.col("row_index")
    return cells.select("*", (c * size).alias("x0"), (r * size).alias("y0"), ((c + F.col("merged_width")) * size).alias("x1"), ((r + F.col("merged_height")) * size).alias("y1"))


def sheet_tables(boxed: DataFrame) -> DataFrame:
    """(doc_id, sheet_no, n_rows, n_cells, x0, y0, x1, y1): one table for each sheet, its box around all cells."""
    return boxed.groupBy(*SHEET).agg(F.count_distinct("row_index").alias("n_rows"), F.count(F.lit(1)).alias("n_cells"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def sheet_rows(cells: DataFrame) -> DataFrame:
    """(doc_id, sheet_no, rows): rows of cells with text and 1-based spans; a cell's number is its place in the row's list."""
    row = F.row_number().over(Window.partitionBy(*SHEET, "row_index").orderBy("col_index"))
    rank = F.dense_rank().over(Window.partitionBy(*SHEET).orderBy("row_index"))
    c = cells.withColumn("__c", row).withColumn("__r", rank)
    cell = F.struct(F.col("__c").alias("start_col"), (F.col("__c") + F.col("merged_width") - 1).alias("end_col"), F.col("__r").alias("start_row"), (F.col("__r") + F.col("merged_height") - 1).alias("end_row"), F.coalesce("value", F.lit("")).alias("text"))
    rows = c.groupBy(*SHEET, "__r").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    return rows.groupBy(*SHEET).agg(F.array_sort(F.collect_list(F.struct("__r", "cells"))).alias("r")).select(*SHEET, F.transform("r", lambda x: x["cells"]).alias("rows"))


def sheet_text(cells: DataFrame, empty: str = "None") -> DataFrame:
    """(doc_id, text): sheets as plain text, each with a heading, cells ended by tabs, rows and sheets by newlines."""
    value = F.concat(F.coalesce("value", F.lit(empty)), F.lit("\t"))
    rows = cells.groupBy("doc_id", "sheet_no", "sheet_name", "row_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_index", value.alias("v")))), lambda x: x["v"]), "").alias("line"))
    sheets = rows.groupBy("doc_id", "sheet_no", "sheet_name").agg(F.array_sort(F.collect_list(F.struct("row_index", "line"))).alias("lines"))
    whole = F.concat(F.lit("Sheet: "), F.col("sheet_name"), F.lit("\n"), F.array_join(F.transform("lines", lambda x: F.concat(x["line"], F.lit("\n"))), ""), F.lit("\n"))
    return sheets.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sheet_no", whole.alias("t")))).alias("s")).select("doc_id", F.array_join(F.transform("s", lambda x: x["t"]), "").alias("text"))


def markdown_records(records: DataFrame) -> DataFrame:
    """(doc_id, text): records (doc_id, record_no, fields) as a Markdown table, its rule before the second record with that record's width."""
    line = F.concat(F.lit("| "), F.array_join("fields", " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform("fields", lambda x: F.lit("---")), " | "), F.lit(" |"))
    piece = F.when(F.col("record_no") == 1, F.concat(rule, F.lit("\n"), line)).otherwise(line)
    return records.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("record_no", piece.alias("p")))), lambda x: x["p"]), "\n").alias("text"))


def date_text(value) -> Column:
    """A timestamp as a sheet shows it: the date alone at midnight, else with the time; the year isn't padded."""
    v = F.col(value) if isinstance(value, str) else value
    day = F.concat_ws("-", F.year(v).cast("string"), F.date_format(v, "MM"), F.date_format(v, "dd"))
    return F.when(F.date_format(v, "HH:mm:ss") == "00:00:00", day).otherwise(F.concat(day, F.lit(" "), F.date_format(v, "HH:mm:ss")))


def lattice_cells(strokes: DataFrame) -> DataFrame:
    """(table_id, row, col, x0, y0, x1, y1, right_open, lower_open): cells between neighbouring stroke positions.

    strokes: (table_id, horizontal, at, low, high). right_open (lower_open): no vertical (horizontal) stroke crosses the
    cell's right (lower) edge at its middle.
    """
    def edges(horizontal: bool, index: str, a: str, b: str) -> DataFrame:
        keys = strokes.where(F.col("horizontal") == horizontal).select("table_id", "at").distinct()
        w = Window.partitionBy("table_id").orderBy("at")
        return keys.select("table_id", F.row_number().over(w).alias(index), F.col("at").alias(a), F.lead("at").over(w).alias(b)).where(F.col(b).isNotNull())

    cells = edges(True, "row", "y0", "y1").join(edges(False, "col", "x0", "x1"), "table_id")

    def crossed(horizontal: bool, edge: str, low: str, high: str, out: str) -> DataFrame:
        s = strokes.where(F.col("horizontal") == horizontal).select("table_id", F.col("at").alias("__at"), "low", "high")
        mid = (F.col(low) + F.col(high)) / 2
        return cells.join(s, "table_id").where((F.col("__at") == F.col(edge)) & mid.between(F.col("low"), F.col("high"))).select("table_id", "row", "col").distinct().withColumn(out, F.lit(True))

    out = cells.join(crossed(False, "x1", "y0", "y1", "__r"), ["table_id", "row", "col"], "left").join(crossed(True, "y1", "x0", "x1", "__d"), ["table_id", "row", "col"], "left")
    return out.select("table_id", "row", "col", "x0", "y0", "x1", "y1", F.col("__r").isNull().alias("right_open"), F.col("__d").isNull().alias("lower_open"))


def lattice_spans(cells: DataFrame) -> DataFrame:
    """(table_id, row, col, row_span, col_span) of lattice cells: runs of open edges; (0, 0) for a swallowed cell.

    A run joins a cell with the ones right of (below) it for as long as edges are open. A span whose cells don't all merge
    in the same way falls back to single cells.
    """
    def runs(df: DataFrame, line: str, at: str, flag: str, span: str, lead: str) -> DataFrame:
        w = Window.partitionBy("table_id", line).orderBy(at)
        rows = df.withColumn("__new", F.when(F.coalesce(F.lag(flag).over(w), F.lit(False)), 0).otherwise(1)).withColumn("__run", F.sum("__new").over(w))
        g = Window.partitionBy("table_id", line, "__run")
        return rows.withColumn(span, F.count(F.lit(1)).over(g)).withColumn(lead, F.col("__new") == 1).drop("__new", "__run")

    both = runs(runs(cells, "row", "col", "right_open", "col_span", "__lead_c"), "col", "row", "lower_open", "row_span", "__lead_r")
    lead = F.col("__lead_c") & F.col("__lead_r")
    heads = both.where(lead & ((F.col("row_span") > 1) | (F.col("col_span") > 1))).select("table_id", F.col("row").alias("r"), F.col("col").alias("c"), F.col("row_span").alias("h"), F.col("col_span").alias("w"))
    inside = (F.col("row").between(F.col("r"), F.col("r") + F.col("h") - 1)) & (F.col("col").between(F.col("c"), F.col("c") + F.col("w") - 1))
    valid = both.join(heads, "table_id").where(inside).groupBy("table_id", "r", "c").agg(F.bool_and((F.col("row_span") == F.col("h")) & (F.col("col_span") == F.col("w"))).alias("ok"))
    good = heads.join(valid.where("ok"), ["table_id", "r", "c"])
    covered = both.join(good, "table_id").where(inside).select("table_id", "row", "col", F.when((F.col("row") == F.col("r")) & (F.col("col") == F.col("c")), F.struct("h", "w")).otherwise(F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("w"))).alias("__s"))
    return both.select("table_id", "row", "col").join(covered, ["table_id", "row", "col"], "left").select("table_id", "row", "col", F.coalesce("__s.h", F.lit(1)).alias("row_span"), F.coalesce("__s.w", F.lit(1)).alias("col_span"))


def clustered_strokes(strokes: DataFrame, gap: float = 2.0) -> DataFrame:
    """(table_id, horizontal, at, low, high): strokes of one direction within `gap` of the running average position, as one.

    strokes: (table_id, horizontal, at, low, high), taken in order of position; each decision moves the average that the next
    one is held against, so a table's direction is one group.
    """

    def number(rows: list[dict]) -> list[int]:
        out, place, n = [], 0.0, 0
        for r in rows:
            if n and abs(r["at"] - place) <= gap:
                place, n = (place * n + r["at"]) / (n + 1), n + 1
                out.append(out[-1])
            else:
                place, n = r["at"], 1
                out.append(out[-1] + 1 if out else 1)
        return out

    marked = numbered(strokes, ["table_id", "horizontal"], ["at", "low", "high"], ["at"], "__c", number)
    return marked.groupBy("table_id", "horizontal", "__c").agg(F.avg("at").alias("at"), F.min("low").alias("low"), F.max("high").alias("high")).drop("__c")


def outer_strokes(strokes: DataFrame, boxes: DataFrame, far: float = 6.0) -> DataFrame:
    """strokes with a stroke for each side of a table's box (table_id, x0, y0, x1, y1) that none lies near."""
    sides = boxes.select("table_id", F.explode(F.array(*[F.struct(F.lit(h).alias("horizontal"), F.col(at).cast("double").alias("at"), F.col(low).cast("double").alias("low"), F.col(high).cast("double").alias("high")) for h, at, low, high in ((True, "y0", "x0", "x1"), (True, "y1", "x0", "x1"), (False, "x0", "y0", "y1"), (False, "x1", "y0", "y1"))])).alias("s")).select("table_id", "s.*")
    near = strokes.select("table_id", "horizontal", F.col("at").alias("__at"))
    have = sides.join(near, ["table_id", "horizontal"]).where(F.abs(F.col("at") - F.col("__at")) <= far).select("table_id", "horizontal", "at").distinct()
    return strokes.select("table_id", "horizontal", "at", "low", "high").unionByName(sides.join(have, ["table_id", "horizontal", "at"], "left_anti"))


def cell_texts(cells: DataFrame, lines: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(table_id, row, col, text): the lines (table_id, ordinal, text, box) that a lattice cell covers, in order, by newlines."""
    zones = cells.select("table_id", "row", "col", geometry.box("x0", "y0", "x1", "y1").alias("__z"))
    hit = lines.join(zones, "table_id").where(geometry.covers("__z", "box", threshold))
    parts = F.array_sort(F.collect_list(F.struct("ordinal", "text")))
    return hit.groupBy("table_id", "row", "col").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text"))


def text_grid(cells: DataFrame, spans: DataFrame) -> DataFrame:
    """(table_id, grid): rows of texts, null for swallowed cells; a cell with a nested table reads `<NEST TABLE>`.

    cells: (table_id, row, col, text, nested); spans as from lattice_spans.
    """
    rows = spans.join(cells, ["table_id", "row", "col"], "left")
    value = F.when(F.col("row_span") == 0, F.lit(None)).when(F.coalesce("nested", F.lit(False)), F.lit("<NEST TABLE>")).otherwise(F.coalesce("text", F.lit("")))
    line = rows.groupBy("table_id", "row").agg(F.array_sort(F.collect_list(F.struct("col", value.alias("v")))).alias("c"))
    return line.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("row", "c"))).alias("r")).select("table_id", F.transform("r", lambda x: F.transform(x["c"], lambda y: y["v"])).alias("grid"))


def cell_borders(cells: DataFrame, strokes: DataFrame, least: float = 5.0, share: float = 0.75) -> DataFrame:
    """(table_id, row, col, side, width, color): the stroke along each side (top, bottom, left, right) of a cell; null without one.

    cells: (table_id, row, col, x0, y0, x1, y1), merged boxes; strokes: (table_id, horizontal, at, low, high, width, color). Strokes at
    the side's place that run along it for `least` points count; they must cover a share of it and have one colour, and the first
    of them (by low, then high, then width) gives the width.
    """
    side = lambda name, flat, at, low, high: F.struct(F.lit(name).alias("side"), F.lit(flat).alias("horizontal"), F.col(at).alias("at"), F.col(low).alias("__low"), F.col(high).alias("__high"))
    sides = F.array(side("top", True, "y0", "x0", "x1"), side("bottom", True, "y1", "x0", "x1"), side("left", False, "x0", "y0", "y1"), side("right", False, "x1", "y0", "y1"))
    rows = cells.select("table_id", "row", "col", F.explode(sides).alias("s")).select("table_id", "row", "col", "s.*")
    along = F.least("high", "__high") - F.greatest("low", "__low")
    met = rows.join(strokes, ["table_id", "horizontal", "at"]).withColumn("along", along).where(F.col("along") >= least)
    keys = ["table_id", "row", "col", "side"]
    found = met.groupBy(*keys).agg(F.sum("along").alias("__sum"), F.max(F.col("__high") - F.col("__low")).alias("__len"), F.count_distinct("color").alias("__colors"), F.min_by("width", F.struct("low", "high", "width")).alias("width"), F.min("color").alias("color"))
    found = found.where((F.col("__sum") >= share * F.col("__len")) & (F.col("__colors") <= 1)).select(*keys, "width", "color")
    return rows.select(*keys).join(found, keys, "left")


def cell_shading(cells: DataFrame, borders: DataFrame, fills: DataFrame, share: float = 0.9) -> DataFrame:
    """(table_id, row, col, fill, color): the first fill (table_id, ordinal, box, color) that covers a cell within its borders; null without one."""
    widths = borders.groupBy("table_id", "row", "col").agg(*[F.max(F.when(F.col("side") == s, F.col("width"))).alias(f"__{s}") for s in ("top", "bottom", "left", "right")])
    half = lambda s: F.coalesce(F.col(f"__{s}") / 2, F.lit(0.0))
    inner = cells.join(widths, ["table_id", "row", "col"], "left").select("table_id", "row", "col", geometry.box(F.col("x0") + half("left"), F.col("y0") + half("top"), F.col("x1") - half("right"), F.col("y1") - half("bottom")).alias("__inner"))
    hit = inner.join(fills.select("table_id", "ordinal", F.col("box").alias("__fill"), "color"), "table_id").where(geometry.covers("__fill", "__inner", share))
    first = hit.groupBy("table_id", "row", "col").agg(F.min("ordinal").alias("fill"), F.min_by("color", "ordinal").alias("color"))
    return cells.select("table_id", "row", "col").join(first, ["table_id", "row", "col"], "left")


def table_blocks(cells: DataFrame, spans: DataFrame, borders: DataFrame, shades: DataFrame) -> DataFrame:
    """(table_id, row, col, row_height, cell): every cell of a grid, with cell null for one that a merge swallows.

    cell is struct(row_span, col_span, x0, y0, x1, y1, fill, border_widths, border_colors): the box of the merged range, the
    colour of its shading, and widths and colours of its borders (top, right, bottom, left; null without one). cells and spans as from
    lattice_cells and lattice_spans, borders and shades as from cell_borders and cell_shading over merged boxes. A row is as high as its first cell.
    """
    keys = ["table_id", "row", "col"]
    rows = cells.select(*keys, "x0", "y0", "x1", "y1").join(spans, keys)
    ends = rows.select("table_id", F.col("row").alias("__r"), F.col("col").alias("__c"), F.col("x1").alias("__x1"), F.col("y1").alias("__y1"))
    last = (F.col("__r") == F.col("row") + F.col("row_span") - 1) & (F.col("__c") == F.col("col") + F.col("col_span") - 1)
    merged = rows.join(ends, "table_id").where((F.col("row_span") > 0) & last).select(*keys, "__x1", "__y1")
    names = ("top", "right", "bottom", "left")
    pick = lambda value: F.array(*[F.max(F.when(F.col("side") == s, F.col(value))) for s in names])
    edges = borders.groupBy(*keys).agg(pick("width").alias("border_widths"), pick("color").alias("border_colors"))
    first = F.min_by(F.col("y1") - F.col("y0"), "col").over(Window.partitionBy("table_id", "row"))
    out = rows.withColumn("row_height", first).join(merged, keys, "left").join(edges, keys, "left").join(shades.select(*keys, F.col("color").alias("fill")), keys, "left")
    cell = F.struct("row_span", "col_span", "x0", "y0", F.col("__x1").alias("x1"), F.col("__y1").alias("y1"), "fill", "border_widths", "border_colors")
    return out.select(*keys, "row_height", F.when(F.col("row_span") > 0, cell).alias("cell"))

"""Spatial operators within a page: orders, rows, margins, assignment to containers, connected components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry
from . import charstyles
from .grouped import numbered

PAGE = ["doc_id", "page"]


def reading_order(rows: DataFrame, keys: list[str] = PAGE, vertical: bool = False) -> DataFrame:
    """All columns and read_no from 1: by (y0, x0, x1), or (x0, y1, y0) for vertical text; ties by ordinal."""
    sign = [F.col(f"box.{n}") for n in (("x0", "y1", "y0") if vertical else ("y0", "x0", "x1"))]
    return rows.withColumn("read_no", F.row_number().over(Window.partitionBy(*keys).orderBy(*sign, "ordinal")))


def rows_of(lines: DataFrame, keys: list[str] = PAGE, eps: float = 0.0) -> DataFrame:
    """All columns and row_no from 1: gaps and islands of y intervals, and col_no by x within the row."""
    page = Window.partitionBy(*keys)
    order = page.orderBy("box.y0", "box.x0", "ordinal")
    reach = F.max("box.y1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("box.y0") >= reach + eps), 1).otherwise(0)
    out = lines.withColumn("__new", new).withColumn("row_no", F.sum("__new").over(order).cast("int")).drop("__new")
    return out.withColumn("col_no", F.row_number().over(Window.partitionBy(*keys, "row_no").orderBy("box.x0", "ordinal")))


def union_boxes(rows: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """(keys, x0, y0, x1, y1): the box around all boxes that have an area."""
    live = rows.where((F.col("box.x1") > F.col("box.x0")) & (F.col("box.y1") > F.col("box.y0")))
    return live.groupBy(*keys).agg(F.min("box.x0").alias("x0"), F.min("box.y0").alias("y0"), F.max("box.x1").alias("x1"), F.max("box.y1").alias("y1"))


def margins(rows: DataFrame, width: float, height: float, cap: float = 72.0, pages: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, left, right, top, bottom): distances of the content from the page's edges, rounded to 0.1, at most cap.

    The right one is a point less; those above and below are halved. A page of `pages` (doc_id, page) without content has cap on
    all sides.
    """
    at = lambda e: F.least(F.round(F.greatest(e, F.lit(0.0)), 1), F.lit(cap))
    out = union_boxes(rows).select(*PAGE, at(F.col("x0")).alias("left"), at(width - F.col("x1") - 1.0).alias("right"), at(F.col("y0") * 0.5).alias("top"), at((height - F.col("y1")) * 0.5).alias("bottom"))
    if pages is None:
        return out
    return pages.select(*PAGE).distinct().join(out, PAGE, "left").select(*PAGE, *[F.coalesce(c, F.lit(cap)).alias(c) for c in ("left", "right", "top", "bottom")])


def row_gaps(rows: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """(keys, n_rows, gap): average gap between the rows of a block; null for one row."""
    heights = rows_of(rows, keys).groupBy(*keys, "row_no").agg(F.max(F.col("box.y1") - F.col("box.y0")).alias("h"), F.min("box.y0").alias("top"), F.max("box.y1").alias("low"))
    out = heights.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), (F.max("low") - F.min("top") - F.sum("h")).alias("free"))
    return out.select(*keys, "n_rows", F.when(F.col("n_rows") > 1, F.col("free") / (F.col("n_rows") - 1)).alias("gap"))


def split_by_overlap(rows: DataFrame, zone: Column, threshold: float) -> DataFrame:
    """All columns and inside: the share of the box within the zone, rounded to two digits, reaches the threshold."""
    share = F.round(geometry.overlap("box", zone) / F.nullif(geometry.area("box"), F.lit(0)), 2)
    return rows.withColumn("inside", F.coalesce(share >= threshold, F.lit(False)))


def assign(items: DataFrame, containers: DataFrame, threshold: float = 0.75) -> DataFrame:
    """All item columns and container: the ordinal of the first container of the page that covers the item; null outside.

    items, containers: (doc_id, page, ordinal, box). The join has equality on the page, the geometry is its residual.
    """
    zones = containers.select(*PAGE, F.col("ordinal").alias("container"), F.col("box").alias("__zone"))
    hit = items.join(zones, PAGE).where(geometry.covers("__zone", "box", threshold)).groupBy(*PAGE, "ordinal").agg(F.min("container").alias("container"))
    return items.join(hit, [*PAGE, "ordinal"], "left")


def groups(boxes: np.ndarray, linked) -> np.ndarray:
    """Component numbers, by least index, under linked(i, others) -> boolean array."""
    n = len(boxes)
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(n):
        for j in np.flatnonzero(linked(i, np.arange(i + 1, n))) + i + 1:
            a, b = root(i), root(int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
    return np.array([root(i) for i in range(n)])


def components(rows: DataFrame, dx: float = 0.0, dy: float = 0.0, overlap_share: float | None = None, out: str = "component") -> DataFrame:
    """All columns and component: the least ordinal among the page's boxes connected to a box.

    Boxes are connected if they meet after growing by dx and dy (negative: shrinking), or with overlap_share if the
    intersection is that share of the smaller one. A page is one group: pages are small by nature.
    """
    def number(page: list[dict]) -> list[int]:
        b = _corners(page)
        size = (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])

        def linked(i: int, j: np.ndarray) -> np.ndarray:
            w = np.minimum(b[i, 2], b[j, 2]) - np.maximum(b[i, 0], b[j, 0])
            h = np.minimum(b[i, 3], b[j, 3]) - np.maximum(b[i, 1], b[j, 1])
            if overlap_share is None:
                return (w + 2 * dx >= 0) & (h + 2 * dy >= 0)
            return np.maximum(w, 0) * np.maximum(h, 0) >= np.maximum(overlap_share * np.minimum(size[i], size[j]), 1e-9)

        return [page[i]["ordinal"] for i in groups(b, linked)]

    return numbered(rows, PAGE, ["ordinal"], ["ordinal", "box"], out, number)


def _corners(rows: list[dict]) -> np.ndarray:
    return np.array([[r["box"][c] for c in ("x0", "y0", "x1", "y1")] for r in rows], float).reshape(-1, 4)


def _same_row(b: np.ndarray):
    """linked() of groups: each box's middle lies above the other's lower edge."""
    middle = (b[:, 1] + b[:, 3]) / 2
    return lambda i, j: (middle[i] < b[j, 3]) & (middle[j] < b[i, 3])


def physical_rows(lines: DataFrame) -> DataFrame:
    """All columns, physical_row from 1 by upper edge, and reading_pos from 1: rows from top to bottom, within them from left to right.

    Lines of a page are in one row if a chain of lines joins them, each of whose middles lies above the next one's lower edge and
    the other way round. Rows of equal upper edge stand in the order of their least ordinal. A page is one group.
    """
    def number(rows: list[dict]) -> list[int]:
        b = _corners(rows)
        return [rows[i]["ordinal"] for i in groups(b, _same_row(b))]

    marked = numbered(lines, PAGE, ["ordinal"], ["ordinal", "box"], "__row", number)
    row = Window.partitionBy(*PAGE, "__row")
    order = Window.partitionBy(*PAGE).orderBy("__top", "__row")
    out = marked.withColumn("__top", F.min("box.y0").over(row)).withColumn("physical_row", F.dense_rank().over(order))
    place = Window.partitionBy(*PAGE).orderBy("physical_row", "box.x0", "box.y0", "box.x1", "ordinal")
    return out.withColumn("reading_pos", F.row_number().over(place)).drop("__row", "__top")


def _flows(rows: list[dict], apart: float) -> bool:
    """Whether lines of one row run on: a single column, and no two neighbours of a physical row `apart` points or more from each other."""
    if all(r["vertical"] for r in rows):
        return False
    b = _corners(rows)
    right = -np.inf
    columns = 0
    for x0, x1 in sorted(map(tuple, b[:, [0, 2]].tolist())):
        columns += x0 > right + 1e-3
        right = max(right, x1)
    if columns > 1:
        return False
    row = groups(b, _same_row(b))
    return not any((np.abs(part[1:, 0] - part[:-1, 2]) >= apart).any() for part in (b[row == r] for r in np.unique(row)))


def stream_lines(lines: DataFrame, shadings: DataFrame, apart: float = 5.0, far: float = 50.0) -> DataFrame:
    """The lines (doc_id, page, ordinal, box, vertical) that may form tables without strokes, with table_no from 1 within the page.

    A page's lines fall into rows of overlapping heights. A row whose lines don't run on (columns side by side, neighbours `apart`
    points or more apart, vertical text) belongs to a table, as do lines that lie within a shading (doc_id, page, box, color) that
    isn't white. A row that runs on ends the table before it; a row that lies `far` points or more below the one before it is the last
    of its table. A page is one group.
    """
    zones = shadings.where(F.coalesce("color", F.lit(0)) != 0xFFFFFF).select(*PAGE, F.col("box").alias("__zone"))
    # fixed value: nine tenths of a line lie within its shading
    shaded = lines.join(zones, PAGE).where(geometry.covers("__zone", "box", 0.9)).select(*PAGE, "ordinal").distinct().withColumn("__shaded", F.lit(True))
    marked = lines.join(shaded, [*PAGE, "ordinal"], "left").withColumn("__shaded", F.coalesce("__shaded", F.lit(False))).withColumn("vertical", F.coalesce("vertical", F.lit(False)))
    marked = marked.withColumn("__y", F.col("box.y0")).withColumn("__x", F.col("box.x0")).withColumn("__x1", F.col("box.x1"))

    def number(rows: list[dict]) -> list[int]:
        found: list[list[int]] = []
        low = -np.inf
        for i, r in enumerate(rows):
            if not found or r["box"]["y0"] >= low:
                found.append([])
            found[-1].append(i)
            low = max(low, r["box"]["y1"])
        out, table, used, end = [0] * len(rows), 1, False, max((rows[i]["box"]["y1"] for i in found[0]), default=0.0)
        for row in found:
            live = not _flows([rows[i] for i in row], apart)
            if not live and used:
                table, used = table + 1, False
            for i in row:
                if live or rows[i]["__shaded"]:
                    out[i], used = table, True
            if min(rows[i]["box"]["y0"] for i in row) - end >= far and used:
                table, used = table + 1, False
            end = max(rows[i]["box"]["y1"] for i in row)
        return out

    out = numbered(marked, PAGE, ["__y", "__x", "__x1", "ordinal"], ["ordinal", "box", "vertical", "__shaded"], "table_no", number)
    return out.where("table_no > 0").drop("__shaded", "__y", "__x", "__x1")


def drop_overlapped(rows: DataFrame, share: float = 0.9) -> DataFrame:
    """Of boxes that overlap by a share of the smaller one, the largest stays (ties: the last)."""
    marked = components(rows, overlap_share=share, out="__c")
    w = Window.partitionBy(*PAGE, "__c").orderBy(geometry.area("box").desc(), F.desc("ordinal"))
    return marked.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__c")


def floating(rows: DataFrame, shrink: float = 5.0) -> DataFrame:
    """All columns and floats: images whose box, shrunk by 5, meets another shrunk box of the page."""
    marked = components(rows, -shrink, -shrink, out="__c")
    w = Window.partitionBy(*PAGE, "__c")
    return marked.withColumn("floats", (F.count(F.lit(1)).over(w) > 1) & (F.col("type") == "image")).drop("__c")


def merge_shapes(rows: DataFrame, tolerance: float = 0.5, fill: float = 0.95) -> DataFrame:
    """(doc_id, page, color, component, n, merged, x0, y0, x1, y1): connected shapes of one colour, and whether they fill their box."""
    by_color = components(rows.withColumn("__p", F.col("page")).withColumn("page", F.concat_ws(":", F.col("page").cast("string"), F.col("color").cast("string"))), tolerance / 2, tolerance / 2)
    out = by_color.groupBy("doc_id", F.col("__p").alias("page"), "color", "component").agg(F.count(F.lit(1)).alias("n"), F.sum(geometry.area("box")).alias("__sum"), F.min("box.x0").alias("x0"), F.min("box.y0").alias("y0"), F.max("box.x1").alias("x1"), F.max("box.y1").alias("y1"))
    whole = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return out.withColumn("merged", (F.col("n") > 1) & (F.col("__sum") >= fill * whole)).drop("__sum")


def hidden_text(blocks: DataFrame, spans: DataFrame, traces: DataFrame, share: float = 0.5) -> DataFrame:
    """Blocks none of whose spans lies half under an invisible trace (type 3) of the same font."""
    hidden = spans.join(traces.where("type = 3").select(*PAGE, "font", F.col("box").alias("__t")), [*PAGE, "font"])
    hit = hidden.where(geometry.overlap("box", "__t") >= share * F.nullif(geometry.area("box"), F.lit(0))).select(*PAGE, F.col("block_no").alias("ordinal")).distinct()
    return blocks.join(hit, [*PAGE, "ordinal"], "left_anti")


def pseudo_bold(traces: DataFrame) -> DataFrame:
    """Fill traces (type 0) that a stroke trace (type 1) of the same characters follows at once, with pseudo_bold true."""
    w = Window.partitionBy(*PAGE).orderBy("ordinal")
    next_type, next_chars = F.lead("type").over(w), F.lead("chars").over(w)
    return traces.withColumn("pseudo_bold", F.coalesce((F.col("type") == 0) & (next_type == 1) & (next_chars == F.col("chars")), F.lit(False))).where("type = 0")


def shape_kinds(shapes: DataFrame, lines: DataFrame) -> DataFrame:
    """All shape columns and meaning: what the first intersecting line of the page makes of a stroke or fill.

    A stroke within a line (and a point around it) underlines or strikes, else it is a border; a fill up to two points higher
    than the line highlights, else it shades. Shapes that meet no line keep null.
    """
    meet = shapes.join(lines.select(*PAGE, F.col("ordinal").alias("__line"), F.col("box").alias("__b")), PAGE).where((F.col("box.y0") <= F.col("__b.y1")) & (F.col("box.y1") >= F.col("__b.y0")) & (F.col("box.x0") <= F.col("__b.x1")) & (F.col("box.x1") >= F.col("__b.x0")))
    within = (F.col("box.x0") >= F.col("__b.x0") - 1) & (F.col("box.x1") <= F.col("__b.x1") + 1)
    low = F.col("box.y1") - F.col("box.y0") <= F.col("__b.y1") - F.col("__b.y0") + 2
    meaning = F.when(F.col("kind") == "stroke", F.when(within, "underline_or_strike").otherwise("border")).otherwise(F.when(low, "highlight").otherwise("shading"))
    first = meet.groupBy(*PAGE, "ordinal").agg(F.min_by(meaning, "__line").alias("meaning"))
    return shapes.join(first, [*PAGE, "ordinal"], "left")


def columns_of(lines: DataFrame) -> DataFrame:
    """(doc_id, page, n_columns): 2 if the page's lines fall into two groups of x intervals of like width, else 1."""
    order = Window.partitionBy(*PAGE).orderBy("box.x0", "ordinal")
    reach = F.max("box.x1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("box.x0") > reach), 1).otherwise(0)
    marked = lines.withColumn("__new", new).withColumn("__g", F.sum("__new").over(order))
    widths = marked.groupBy(*PAGE, "__g").agg((F.max("box.x1") - F.min("box.x0")).alias("w"))
    out = widths.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("n"), F.max("w").alias("wide"), F.min("w").alias("slim"))
    return out.select(*PAGE, F.when((F.col("n") == 2) & (F.col("slim") >= 0.5 * F.col("wide")), 2).otherwise(1).alias("n_columns"))


def styled_spans(spans: DataFrame, shapes: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, span_no, part, style, text): spans cut where a text-style shape begins or ends.

    spans: (doc_id, page, line_no, span_no, chars array<struct<c, box>>); shapes: (doc_id, page, ordinal, box). A character belongs to
    a shape that covers half of its width and meets its height. Low shapes (less than half as high as the character) strike
    if they cross its middle half and underline below it; higher ones highlight. The first shape by ordinal decides. Spans go to
    the join packed (see charstyles), not as a row for each character; the keys tell spans apart.
    """
    keys = [*PAGE, "line_no", "span_no"]
    typed = ", ".join(f"{k} {kind}" for k, kind in spans.select(*keys).dtypes)
    packed = spans.select(*keys, "chars").mapInArrow(charstyles.packed, f"{typed}, {charstyles.PACKED}")
    zones = shapes.where("ordinal IS NOT NULL").groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("ordinal", "box"))).alias("__z"))

    def near(z: Column) -> Column:
        b = z["box"]
        return F.coalesce((b["x1"] >= F.col("x0")) & (b["x0"] <= F.col("x1")) & (b["y1"] >= F.col("y0")) & (b["y0"] <= F.col("y1")), F.lit(True))

    boxes = F.transform(F.filter("__z", near), lambda z: F.struct(*[z["box"][s].cast("double").alias(s) for s in charstyles.SIDES]))
    rows = packed.join(zones, PAGE, "left").select(*keys, "n", "text", "ends", "boxes", boxes.alias("zones"))
    return rows.mapInArrow(charstyles.cut, f"{typed}, {charstyles.CUT}")


def sections(lines: DataFrame, gap: float = 1.0, least_height: float = 20.0) -> DataFrame:
    """All columns, section from 1 and column 1 or 2: bands of a page's rows that stand in the same number of columns.

    A row stands in two columns if it has a free gap whose two sides are alike in width (between half and double) and fill a
    third of the row each. A two-column band lower than 20 points is taken as one column. Rows of one kind that follow
    each other are a section.
    """
    rows = rows_of(lines)
    row = Window.partitionBy(*PAGE, "row_no")
    order = row.orderBy("box.x0", "ordinal")
    split = F.when(F.col("box.x0") - F.lag("box.x1").over(order) >= gap, F.col("box.x0"))
    rows = rows.withColumn("__left", F.min("box.x0").over(row)).withColumn("__right", F.max("box.x1").over(row)).withColumn("__cut", split)
    rows = rows.withColumn("__at", F.max("__cut").over(row)).withColumn("__n", F.count("__cut").over(row))
    end = F.max(F.when(F.col("box.x0") < F.col("__at"), F.col("box.x1"))).over(row)
    rows = rows.withColumn("__end", end)
    a, b, whole = F.col("__end") - F.col("__left"), F.col("__right") - F.col("__at"), F.col("__right") - F.col("__left")
    two = F.coalesce((F.col("__n") == 1) & (a >= 0.5 * b) & (a <= 2.0 * b) & (a >= whole / 3) & (b >= whole / 3), F.lit(False))
    rows = rows.withColumn("__two", two)
    per_row = rows.groupBy(*PAGE, "row_no").agg(F.bool_or("__two").alias("two"), F.min("box.y0").alias("top"), F.max("box.y1").alias("low"))
    w = Window.partitionBy(*PAGE).orderBy("row_no")

    def bands(df: DataFrame, out: str) -> DataFrame:
        change = F.when(F.lag("two").over(w).isNull() | (F.col("two") != F.lag("two").over(w)), 1).otherwise(0)
        return df.withColumn("__c", change).withColumn(out, F.sum("__c").over(w).cast("int")).drop("__c")

    g = Window.partitionBy(*PAGE, "__band")
    per_row = bands(per_row, "__band").withColumn("two", F.col("two") & (F.max("low").over(g) - F.min("top").over(g) >= least_height))
    per_row = bands(per_row, "section").select(*PAGE, "row_no", "two", "section")
    out = rows.join(per_row, [*PAGE, "row_no"])
    return out.select(*lines.columns, "section", F.when(F.col("two") & (F.col("box.x0") >= F.col("__at")), 2).otherwise(1).alias("column"))

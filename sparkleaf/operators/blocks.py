"""From decoded pages to blocks: selection and clean-up of lines, spans and shapes, lines joined to blocks, order of elements."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, text
from .grouped import numbered

PAGE = ["doc_id", "page"]
# Numbers of block types, and bits of what a shape may be.
BLOCK_TYPES = {"undefined": -1, "text": 0, "image": 1, "lattice_table": 2, "stream_table": 3, "float_image": 4}
SHAPE_BITS = {"highlight": 1, "underline": 2, "strike": 4, "hyperlink": 8, "border": 16, "shading": 32}
# Brackets and quotation marks that open and close.
OPENING, CLOSING = "‘“[{(（【《", "’”]})）】》"
WHITE = 0xFFFFFF


def selected_pages(pages: DataFrame, start: int = 0, end: int | None = None, chosen: list[int] | None = None) -> DataFrame:
    """The pages (doc_id, page) of a document from start on, before end (None or 0: all); a list of chosen numbers overrides both."""
    if chosen:
        return pages.where(F.col("page").isin([int(x) for x in chosen]))
    return pages.where((F.col("page") >= start) & (F.col("page") < end if end else F.lit(True)))


def _page_box() -> Column:
    return geometry.box(F.lit(0.0), F.lit(0.0), F.col("__width"), F.col("__height"))


def on_page(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """The rows whose box meets its page; pages: (doc_id, page, width, height)."""
    sizes = pages.select(*PAGE, F.col("width").cast("double").alias("__width"), F.col("height").cast("double").alias("__height"))
    return rows.join(sizes, PAGE).where(geometry.intersects("box", _page_box())).drop("__width", "__height")


def valid_lines(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """The lines on their page that hold an image or more than white space and run to the right or straight up.

    lines: (doc_id, page, ordinal, text, box, dx, dy, has_image); null texts count as blank.
    """
    live = F.coalesce(F.col("has_image"), F.lit(False)) | F.coalesce(F.col("text").rlike(r"(?U)\S"), F.lit(False))
    return on_page(lines.where(live & ((F.col("dx") == 1) | (F.col("dy") == -1))), pages)


def live_spans(spans: DataFrame) -> DataFrame:
    """The spans with more than white space, and the blank ones that carry a style (array)."""
    return spans.where(F.coalesce(F.col("text").rlike(r"(?U)\S"), F.lit(False)) | (F.coalesce(F.size("style"), F.lit(0)) > 0))


def live_shapes(shapes: DataFrame, pages: DataFrame, least: float = 2.0) -> DataFrame:
    """The shapes on their page that are `least` points long in one direction at least."""
    return on_page(shapes.where(F.greatest(F.col("box.x1") - F.col("box.x0"), F.col("box.y1") - F.col("box.y0")) >= least), pages)


def shape_roles(shapes: DataFrame) -> DataFrame:
    """All columns (kind, color, potential among them) and is_stroke, is_fill (of another colour than white), is_link, may_border,
    may_shade, may_style (highlight, underline, strike or hyperlink) by the bits of `potential`."""
    may = lambda *names: F.coalesce(F.col("potential").bitwiseAND(sum(SHAPE_BITS[n] for n in names)) != 0, F.lit(False))
    return shapes.withColumns({
        "is_stroke": F.col("kind") == "stroke",
        "is_fill": (F.col("kind") == "fill") & (F.coalesce("color", F.lit(0)) != WHITE),
        "is_link": F.col("kind") == "hyperlink",
        "may_border": may("border"),
        "may_shade": may("shading"),
        "may_style": may("highlight", "underline", "strike", "hyperlink"),
    })


def block_roles(blocks: DataFrame) -> DataFrame:
    """All columns and is_text, is_image (in line or floating), is_float, is_lattice, is_stream, is_table by the number in block_type."""
    of = lambda *names: F.coalesce(F.col("block_type").isin([BLOCK_TYPES[n] for n in names]), F.lit(False))
    return blocks.withColumns({"is_text": of("text"), "is_image": of("image", "float_image"), "is_float": of("float_image"), "is_lattice": of("lattice_table"), "is_stream": of("stream_table"), "is_table": of("lattice_table", "stream_table")})


def web_links(links: DataFrame) -> DataFrame:
    """Of a page's links those that hold an address (kind 2)."""
    return links.where("kind = 2 AND uri IS NOT NULL")


def line_order(rows: DataFrame, keys: list[str] = PAGE, vertical: bool = False) -> DataFrame:
    """All columns and line_pos from 1: by (x0, y0, x1), or (y1, x0, y0) for vertical text; ties by ordinal."""
    names = ("y1", "x0", "y0") if vertical else ("x0", "y0", "x1")
    return rows.withColumn("line_pos", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(f"box.{n}") for n in names], "ordinal")))


def all_underlined(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, underlined): whether all spans carry the flag 32."""
    return spans.groupBy(*keys).agg(F.bool_and(F.coalesce(F.col("flags").bitwiseAND(32) != 0, F.lit(False))).alias("underlined"))


def uniform_borders(strokes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, color): the colour of border strokes that all have the same one; null otherwise."""
    return strokes.groupBy(*keys).agg(F.when(F.count_distinct("color") == 1, F.max("color")).alias("color"))


def block_list_text(blocks: DataFrame) -> DataFrame:
    """(doc_id, text): the texts of a document's blocks (doc_id, block_no, type, text, ocr_text), images by their recognised text, each
    after a full-width semicolon."""
    own = F.coalesce(F.when(F.col("type").isin("text", "table"), F.col("text")).otherwise(F.col("ocr_text")), F.lit(""))
    parts = F.array_sort(F.collect_list(F.struct("block_no", F.concat(F.lit("；"), own).alias("t"))))
    return blocks.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "").alias("text"))


def element_order(blocks: DataFrame) -> DataFrame:
    """All columns and element_no from 1 by page, section, col and ordinal; running headers and footers are left out."""
    live = blocks.where(~F.coalesce("is_header", F.lit(False)) & ~F.coalesce("is_footer", F.lit(False)))
    return live.withColumn("element_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "section", "col", "ordinal")))


# ---- lines to blocks


class _Line:
    __slots__ = ("image", "indent", "left", "tag", "text", "width", "x0", "x1", "y0", "y1")

    def __init__(self, row: dict):
        self.text, self.tag, self.image = row["text"] or "", row["list_tag"], bool(row["has_image"])
        self.x0, self.y0, self.x1, self.y1 = (float(row[c]) for c in ("x0", "y0", "x1", "y1"))
        self.width = (self.x1 - self.x0) / max(1, len(self.text))  # of a character
        self.left, self.indent = 0, False

    def beside(self, other: _Line) -> bool:
        return (self.y0 + self.y1) / 2 < other.y1 and (other.y0 + other.y1) / 2 < self.y1

    def gap(self, below: _Line) -> int:
        return math.ceil(max(below.y0 - self.y1, 0))

    def centred(self, left: int, right: int) -> bool:
        return right > 0 and (self.x1 - self.x0) / (right - left + 1e-6) < 0.9 and abs((self.x0 + self.x1) / 2 - (left + right) / 2) < 30


def _mark_indents(group: list[_Line]) -> None:
    """Left edge of lines that belong together, and whether one of their rows stands in from it by more than 1.5 characters."""
    left = min(int(x.x0) for x in group)
    seen, indent = set(), False
    for i, first in enumerate(group):
        if i in seen:
            continue
        row, todo = [], [i]
        seen.add(i)
        while todo:
            k = todo.pop()
            row.append(k)
            near = [j for j in range(len(group)) if j not in seen and group[k].beside(group[j])]
            seen.update(near)
            todo += near
        indent |= min(group[k].x0 for k in row) - left > 1.5 * first.width
    for x in group:
        x.left, x.indent = left, indent


def _open_bracket(before: str, line: str) -> bool:
    count = lambda s, marks: sum(s.count(c) for c in marks)
    both = before + line
    return count(before, OPENING) > count(before, CLOSING) and count(both, OPENING) == count(both, CLOSING)


def join_numbers(rows: list[dict]) -> list[int]:
    """Block numbers, from 1, of a page's lines and tables in reading order (the plain core of `joined`)."""
    items = [None if r["type"] == "table" else _Line(r) for r in rows]
    lines = [x for x in items if x is not None]
    left = min((int(x.x0) for x in lines), default=0)
    right = max((int(x.x1) for x in lines), default=0)
    boxes = [_Line({**r, "text": ""}) for r in rows]
    gaps = [a.gap(b) for a, b in zip(boxes, boxes[1:]) if not a.beside(b)]
    usual = max(gaps, key=gaps.count) if gaps else 0

    group: list[_Line] = []
    for x in [*items, None]:
        if group and (x is None or not (group[-1].beside(x) or group[-1].gap(x) <= usual)):
            _mark_indents(group)
            group = []
        if x is not None:
            group.append(x)

    out, block, number = [], [], 0
    for i, x in enumerate(items):
        if x is None:
            block = []
            number += 1
            out.append(number)
            continue
        if not block or (not block[-1].beside(x) and _opens(x, block, i, boxes, usual, left, right)):
            block = []
            number += 1
        block.append(x)
        out.append(number)
    return out


def _opens(x: _Line, block: list[_Line], i: int, boxes: list[_Line], usual: int, left: int, right: int) -> bool:
    """Whether a line below an open block opens another one: the first rule that applies decides."""
    before = block[-1]
    gap = before.gap(x)
    if x.image or before.image or x.tag is not None:
        return True
    if block[0].tag is not None and x.left - before.x1 < 1.5 * x.width and x.x0 - block[0].x0 < x.width * (len(block[0].tag) + 1.5):
        return False  # a list item goes on under its text
    if before.text[-1:] and before.text[-1] in text.OPEN_ENDS or _open_bracket(before.text, x.text):
        return False
    if len(block) > 1 and gap - block[-2].gap(before) < 3:
        return False
    if x.indent:
        return x.x0 - x.left > 1.5 * x.width
    if i < len(block) - 1 and gap - x.gap(boxes[i + 1]) > 5:  # looks ahead only while the block is longer than what came before
        return True
    if x.centred(left, right) != before.centred(left, right):
        return True
    return gap > usual + 1


def joined(lines: DataFrame) -> DataFrame:
    """All columns and block_no from 1 on each page: lines with one number form a text block, a table is one by itself.

    lines: (doc_id, page, ordinal, type text/table, text, has_image, x0, y0, x1, y1) in reading order. A line opens a block at a list
    tag or an image; it goes on with the block beside the line before, below an open-ended line or an unclosed bracket, and as
    far as gaps stay alike; where a group of lines has an indented row, indents decide, else centring and the page's usual gap.
    Each decision needs the block so far, so a page is one group. Null texts count as empty.
    """
    tagged = lines.withColumn("__tag", text.list_tag(F.coalesce("text", F.lit(""))))
    read = ["type", "text", "has_image", "x0", "y0", "x1", "y1"]
    named = tagged.withColumnRenamed("__tag", "list_tag") if "list_tag" not in lines.columns else tagged.drop("list_tag").withColumnRenamed("__tag", "list_tag")
    return numbered(named, PAGE, ["ordinal"], [*read, "list_tag"], "block_no", join_numbers)


def block_texts(lines: DataFrame) -> DataFrame:
    """(doc_id, page, block_no, type, n_lines, text, x0, y0, x1, y1): the blocks of `joined` lines, their texts joined by newlines."""
    parts = F.array_sort(F.collect_list(F.struct("ordinal", F.coalesce("text", F.lit("")).alias("t"))))
    edges = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    return lines.groupBy(*PAGE, "block_no").agg(F.min_by("type", "ordinal").alias("type"), F.count(F.lit(1)).alias("n_lines"), F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias("text"), *edges)


# ---- pseudo-bold


def bold_flags(rows: list[dict]) -> list[int]:
    """1 for each bold span, 0 for the others and for traces (the plain core of `assign_pseudo_bold`)."""
    traces = [(r["text"] or "", bool(r["pseudo_bold"])) for r in rows if r["kind"] == "trace"]
    out, at = [], 0
    for r in rows:
        if r["kind"] != "span" or at == len(traces):
            out.append(0)
            continue
        span, read, bold = r["text"] or "", "", False
        while at < len(traces):
            chars, flag = traces[at]
            read += chars
            if not (span.startswith(read) or (chars in span and flag == bold)):
                break
            bold, at = flag, at + 1
        out.append(int(bold))
    return out


def assign_pseudo_bold(spans: DataFrame, traces: DataFrame) -> DataFrame:
    """(doc_id, page, ordinal, text, pseudo_bold): spans with the boldness of the traces that make them up.

    spans: (doc_id, page, ordinal, text); traces: (doc_id, page, ordinal, chars, pseudo_bold), both in drawing order. A span takes traces
    while what they spell opens it, or while their characters lie in it and their boldness is the last one's; the last one
    taken decides. What a span takes depends on the spans before, so a page is one group.
    """
    own = spans.select(*PAGE, F.col("ordinal").cast("int").alias("ordinal"), F.lit("span").alias("kind"), "text", F.lit(False).alias("pseudo_bold"))
    drawn = traces.select(*PAGE, F.col("ordinal").cast("int").alias("ordinal"), F.lit("trace").alias("kind"), F.col("chars").alias("text"), F.coalesce("pseudo_bold", F.lit(False)).alias("pseudo_bold"))
    found = numbered(own.unionByName(drawn), PAGE, ["ordinal"], ["kind", "text", "pseudo_bold"], "bold", bold_flags)
    return found.where("kind = 'span'").select(*PAGE, "ordinal", "text", (F.col("bold") == 1).alias("pseudo_bold"))

"""Queries of layout within pages, ruled tables, decoders, whole parses and evaluation reports, with their DuckDB SQL."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, text
from ..operators import evaluate, relations, spatial, tables
from ..sources import files
from . import derive, parse
from .catalog import _EDGES, _NODES, _ONE, _nodes, _query

PAGE = ["doc_id", "page"]


def _lines(spark: SparkSession, sf_dir: str, x0, y0, width, height) -> DataFrame:
    """Lines with a box of the given place and size."""
    number = lambda c: (c if isinstance(c, Column) else F.lit(c)).cast("double")
    x, y = number(x0), number(y0)
    return derive.lines(spark, sf_dir).withColumn("box", geometry.box(x, y, x + number(width), y + number(height)))


def _reach(link: str, rows: str = "s") -> str:
    """Recursive SQL: (doc_id, page, ordinal, component) under link, by the least ordinal that a chain of links reaches."""
    return f"""link AS (SELECT a.doc_id, a.page, a.ordinal AS i, b.ordinal AS j FROM {rows} a JOIN {rows} b ON a.doc_id = b.doc_id AND a.page = b.page WHERE {link}),
reach AS (SELECT doc_id, page, ordinal AS i, ordinal AS j FROM {rows} UNION SELECT r.doc_id, r.page, r.i, l.j FROM reach r JOIN link l ON l.doc_id = r.doc_id AND l.page = r.page AND l.i = r.j),
c AS (SELECT doc_id, page, i AS ordinal, min(j) AS component FROM reach GROUP BY ALL)"""


_W, _H = "least(a.x1, b.x1) - greatest(a.x0, b.x0)", "least(a.y1, b.y1) - greatest(a.y0, b.y0)"
_S = f"{derive.LINES_SQL}, q AS (SELECT *, length(text) AS n FROM lines)"


@_query(f"""
WITH RECURSIVE {_S}, s AS (SELECT doc_id, page, ordinal, 72 + 20 * (n % 3) AS x0, 72 + 3 * ordinal AS y0, 102 + 20 * (n % 3) + n % 20 AS x1, 84 + 3 * ordinal + n % 7 AS y1 FROM q),
{_reach(f"{_W} > 0 AND {_H} > 0 AND ({_W}) * ({_H}) >= 0.6 * least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0))")}
SELECT doc_id, page, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, component ORDER BY (x1 - x0) * (y1 - y0) DESC, ordinal DESC) AS k FROM s JOIN c USING (doc_id, page, ordinal)) WHERE k = 1
""")
def overlapped_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest of each group of boxes that overlap."""
    n = F.length("text")
    rows = _lines(spark, sf_dir, 72 + 20 * (n % 3), 72 + 3 * F.col("ordinal"), 30 + n % 20, 12 + n % 7)
    return spatial.drop_overlapped(rows.select(*PAGE, "ordinal", "box"), 0.6).select(*PAGE, "ordinal")


@_query(f"""
WITH RECURSIVE {_S}, s AS (SELECT doc_id, page, ordinal, line_no % 3 = 0 AS image, 72 + 40 * (n % 4) AS x0, 72 + 4 * ordinal AS y0, 102 + 40 * (n % 4) + n % 20 AS x1, 90 + 4 * ordinal AS y1 FROM q),
{_reach(f"{_W} - 10 >= 0 AND {_H} - 10 >= 0")}
SELECT doc_id, page, ordinal, image AND count(*) OVER (PARTITION BY doc_id, page, component) > 1 AS floats FROM s JOIN c USING (doc_id, page, ordinal)
""")
def floating_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images that lie over other blocks."""
    n = F.length("text")
    rows = _lines(spark, sf_dir, 72 + 40 * (n % 4), 72 + 4 * F.col("ordinal"), 30 + n % 20, 18)
    rows = rows.select(*PAGE, "ordinal", F.when(F.col("line_no") % 3 == 0, "image").otherwise("text").alias("type"), "box")
    return spatial.floating(rows).select(*PAGE, "ordinal", "floats")


@_query(f"""
WITH RECURSIVE {_S}, s AS (SELECT doc_id, page, ordinal, (n % 2)::INTEGER AS color, 72 + 10 * ordinal AS x0, 72 AS y0, 72 + 10 * ordinal + 10 + n % 4 AS x1, 80 + n % 3 AS y1 FROM q),
{_reach(f"a.color = b.color AND {_W} + 0.5 >= 0 AND {_H} + 0.5 >= 0")}
SELECT doc_id, page, color, component::INTEGER AS component, count(*) AS n, count(*) > 1 AND sum((x1 - x0) * (y1 - y0)) >= 0.95 * (max(x1) - min(x0)) * (max(y1) - min(y0)) AS merged, min(x0)::DOUBLE AS x0, min(y0)::DOUBLE AS y0, max(x1)::DOUBLE AS x1, max(y1)::DOUBLE AS y1
FROM s JOIN c USING (doc_id, page, ordinal) GROUP BY doc_id, page, color, component
""")
def merged_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes of one colour that meet, as one."""
    n = F.length("text")
    rows = _lines(spark, sf_dir, 72 + 10 * F.col("ordinal"), 72, 10 + n % 4, 8 + n % 3)
    return spatial.merge_shapes(rows.select(*PAGE, "ordinal", (n % 2).cast("int").alias("color"), "box"))


@_query(f"""
WITH RECURSIVE {_S}, s AS (SELECT doc_id, page, ordinal, 72 + 30 * (n % 7) AS x0, 72 + 5 * ordinal + n % 7 AS y0, 102 + 30 * (n % 7) AS x1, 80 + 5 * ordinal + n % 7 + n % 5 AS y1 FROM q),
{_reach("(a.y0 + a.y1) / 2 < b.y1 AND (b.y0 + b.y1) / 2 < a.y1")},
t AS (SELECT *, min(y0) OVER (PARTITION BY doc_id, page, component) AS top FROM s JOIN c USING (doc_id, page, ordinal)),
d AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id, page ORDER BY top, component) AS physical_row FROM t)
SELECT doc_id, page, ordinal, physical_row, row_number() OVER (PARTITION BY doc_id, page ORDER BY physical_row, x0, y0, x1, ordinal) AS reading_pos FROM d
""")
def physical_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of lines whose middles overlap, and the reading order through them."""
    n = F.length("text")
    rows = _lines(spark, sf_dir, 72 + 30 * (n % 7), 72 + 5 * F.col("ordinal") + n % 7, 30, 8 + n % 5)
    return spatial.physical_rows(rows).select(*PAGE, "ordinal", F.col("physical_row").cast("long").alias("physical_row"), F.col("reading_pos").cast("long").alias("reading_pos"))


@_query(f"""
WITH {derive.BOXES_SQL}, b AS (SELECT doc_id, page, ordinal, x0, x1, y0 + CASE WHEN ordinal >= 2 AND page % 3 = 0 THEN 60 ELSE 0 END AS y0, y1 + CASE WHEN ordinal >= 2 AND page % 3 = 0 THEN 60 ELSE 0 END AS y1,
  ordinal = 1 AND length(text) % 5 = 0 AS vertical, page % 2 = 0 AND ordinal = 1 AND round(greatest(0, least(x1, 300) - x0) * 12 / greatest((x1 - x0) * 12, 1e-9), 2) >= 0.9 AND x1 > x0 AND 229 >= x1 - x0 AS shaded FROM boxes),
r AS (SELECT *, least(ordinal, 2) AS r FROM b),
w AS (SELECT doc_id, page, r, min(y0) AS top, max(y1) AS low, NOT (bool_and(vertical) OR count(*) > 1 AND (max(x0) > min(x1) + 0.001 OR abs(max_by(x0, ordinal) - min_by(x1, ordinal)) >= 5)) AS flows, bool_or(shaded) AS any_shaded FROM r GROUP BY ALL),
g AS (SELECT *, CASE WHEN top - lag(low, 1, low) OVER p >= 50 THEN 1 ELSE 0 END AS far FROM w WINDOW p AS (PARTITION BY doc_id, page ORDER BY r)),
k AS (SELECT *, sum(CASE WHEN flows THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY r) + coalesce(sum(far) OVER (PARTITION BY doc_id, page ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t FROM g)
SELECT doc_id, page, ordinal, dense_rank() OVER (PARTITION BY doc_id, page ORDER BY t)::INTEGER AS table_no FROM r JOIN k USING (doc_id, page, r) WHERE NOT flows OR shaded
""")
def stream_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that may form tables without strokes: columns side by side, vertical text, shaded lines."""
    rows = derive.boxes(spark, sf_dir)
    down = F.when((F.col("ordinal") >= 2) & (F.col("page") % 3 == 0), 60.0).otherwise(0.0)
    rows = derive.with_box(rows.withColumns({"y0": F.col("y0") + down, "y1": F.col("y1") + down}))
    rows = rows.select(*PAGE, "ordinal", "box", ((F.col("ordinal") == 1) & (F.length("text") % 5 == 0)).alias("vertical"))
    shadings = rows.select(*PAGE).distinct().select(*PAGE, geometry.box(F.lit(72.0), F.lit(86.0), F.lit(300.0), F.lit(98.0)).alias("box"), F.when(F.col("page") % 2 == 0, 255).otherwise(0xFFFFFF).alias("color"))
    return spatial.stream_lines(rows, shadings).select(*PAGE, "ordinal", "table_no")


@_query(f"""
WITH {derive.BOXES_SQL}, t AS (SELECT doc_id, page, max(CASE WHEN ordinal = 2 THEN x1 END) AS e, max(CASE WHEN ordinal = 3 THEN x1 END) AS z, max(ordinal) AS m FROM boxes GROUP BY ALL),
w AS (SELECT *, coalesce(m = 3 AND 322 - e >= 1 AND e - 72 >= 0.5 * (z - 322) AND e - 72 <= 2 * (z - 322) AND e - 72 >= (z - 72) / 3 AND z - 322 >= (z - 72) / 3, FALSE) AS two FROM t)
SELECT doc_id, page, ordinal, CASE WHEN two AND ordinal >= 2 THEN 2 ELSE 1 END::INTEGER AS section, CASE WHEN two AND ordinal = 3 THEN 2 ELSE 1 END::INTEGER AS col FROM boxes JOIN w USING (doc_id, page)
""")
def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of one or two columns, rows twice as high as elsewhere."""
    rows = derive.boxes(spark, sf_dir)
    rows = derive.with_box(rows.withColumns({"y0": F.col("y0") * 2, "y1": F.col("y1") * 2}))
    return spatial.sections(rows).select(*PAGE, "ordinal", "section", F.col("column").alias("col"))


@_query(f"""
WITH {derive.BOXES_SQL}, ch AS (SELECT doc_id, page, ordinal, unnest(range(length(text)::BIGINT)) AS pos, text, x0, y0 FROM boxes WHERE text <> ''),
z AS (SELECT *, x0 + 2 * pos AS a, substr(text, pos + 1, 1) AS c FROM ch),
y AS (SELECT *, CASE WHEN y0 = 72 AND a + 1 >= 82 AND a + 1 <= 102 THEN 'underline' WHEN y0 = 86 AND a + 1 >= 80 AND a + 1 <= 100 THEN 'highlight' WHEN y0 = 100 AND a + 1 >= 300 AND a + 1 <= 340 THEN 'strike' END AS style FROM z),
i AS (SELECT *, CASE WHEN pos = 0 OR style IS DISTINCT FROM lag(style) OVER (PARTITION BY doc_id, page, ordinal ORDER BY pos) THEN 1 ELSE 0 END AS new FROM y),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page, ordinal ORDER BY pos) AS part FROM i)
SELECT doc_id, page, ordinal, part::BIGINT AS part, any_value(style) AS style, string_agg(c, '' ORDER BY pos) AS text FROM g GROUP BY doc_id, page, ordinal, part
""")
def styled_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines cut where a shape underlines, highlights or strikes them."""
    rows = derive.boxes(spark, sf_dir).where("text <> ''")
    char = lambda c, i: F.struct(c.alias("c"), geometry.box(F.col("x0") + 2 * i, F.col("y0"), F.col("x0") + 2 * i + 2, F.col("y0") + 12).alias("box"))
    spans = rows.select(*PAGE, F.col("ordinal").alias("line_no"), F.lit(0).alias("span_no"), F.transform(F.split("text", ""), char).alias("chars"))
    zones = F.array(*[F.struct(F.lit(i).alias("ordinal"), geometry.box(*[F.lit(float(v)) for v in b]).alias("box")) for i, b in enumerate([(82, 83, 102, 84), (80, 86.5, 100, 97.5), (300, 105.5, 340, 106.5)])])
    shapes = rows.select(*PAGE).distinct().select(*PAGE, F.explode(zones).alias("z")).select(*PAGE, "z.*")
    return spatial.styled_spans(spans, shapes).select(*PAGE, F.col("line_no").alias("ordinal"), "part", "style", "text")


@_query(f"""
WITH {derive.LINES_SQL}, l AS (SELECT doc_id, page, ordinal, CASE WHEN ordinal = 1 THEN text || '-' ELSE text END AS text FROM lines),
n AS (SELECT *, substr(lead(text) OVER (PARTITION BY doc_id, page ORDER BY ordinal), 1, 1) AS nxt, rtrim(text, ' ') AS own FROM l),
p AS (SELECT *, CASE WHEN nxt IS NULL THEN text WHEN regexp_matches(own, '[A-Za-z]-$') AND regexp_matches(nxt, '[a-z]') THEN regexp_replace(own, '-$', '') WHEN regexp_matches(own, '[A-Za-z0-9,.;:!?)]$') AND regexp_matches(nxt, '[A-Za-z0-9(]') THEN own || ' ' ELSE text END AS piece FROM n)
SELECT doc_id, page, string_agg(piece, '' ORDER BY ordinal) AS text FROM p GROUP BY 1, 2
""")
def joined_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a page as one paragraph, the second one hyphenated."""
    rows = derive.lines(spark, sf_dir).withColumn("text", F.when(F.col("ordinal") == 1, F.concat("text", F.lit("-"))).otherwise(F.col("text")))
    return relations.joined_words(rows.withColumn("paragraph", F.lit(0)), hyphens=True).select("doc_id", "page", "text")


# ---- ruled tables


@_query(f"""
WITH RECURSIVE {derive.LINES_SQL}, s AS (SELECT doc_id, line_no % 2 = 0 AS h, (length(text) % 40)::DOUBLE AS pos, (length(text) % 7)::DOUBLE AS low, (length(text) % 7 + 30)::DOUBLE AS high FROM lines),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, h ORDER BY pos, low, high) AS rn FROM s),
k AS (SELECT doc_id, h, rn, pos, low, high, 1 AS n, 1 AS g FROM o WHERE rn = 1
  UNION ALL SELECT o.doc_id, o.h, o.rn, CASE WHEN abs(o.pos - k.pos) <= 2 THEN (k.pos * k.n + o.pos) / (k.n + 1) ELSE o.pos END, CASE WHEN abs(o.pos - k.pos) <= 2 THEN least(k.low, o.low) ELSE o.low END, CASE WHEN abs(o.pos - k.pos) <= 2 THEN greatest(k.high, o.high) ELSE o.high END,
    CASE WHEN abs(o.pos - k.pos) <= 2 THEN k.n + 1 ELSE 1 END, CASE WHEN abs(o.pos - k.pos) <= 2 THEN k.g ELSE k.g + 1 END FROM k JOIN o ON o.doc_id = k.doc_id AND o.h = k.h AND o.rn = k.rn + 1),
m AS (SELECT doc_id, h, pos, low, high FROM k QUALIFY row_number() OVER (PARTITION BY doc_id, h, g ORDER BY rn DESC) = 1),
e AS (SELECT doc_id, v.* FROM (SELECT DISTINCT doc_id FROM lines), (VALUES (TRUE, 0.0::DOUBLE, 0.0::DOUBLE, 40.0::DOUBLE), (TRUE, 90.0, 0.0, 40.0), (FALSE, 0.0, 0.0, 90.0), (FALSE, 40.0, 0.0, 90.0)) v(h, pos, low, high))
SELECT doc_id AS table_id, h AS horizontal, round(pos, 9) AS "at", low, high FROM m UNION ALL SELECT doc_id, h, pos, low, high FROM e WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = e.doc_id AND m.h = e.h AND abs(m.pos - e.pos) <= 6)
""")
def table_strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strokes clustered by position, with a stroke for each side of the table that has none."""
    n = F.length("text")
    rows = derive.lines(spark, sf_dir).select(F.col("doc_id").alias("table_id"), (F.col("line_no") % 2 == 0).alias("horizontal"), (n % 40).cast("double").alias("at"), (n % 7).cast("double").alias("low"), (n % 7 + 30).cast("double").alias("high"))
    boxes = rows.select("table_id").distinct().select("table_id", F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(40.0).alias("x1"), F.lit(90.0).alias("y1"))
    return tables.outer_strokes(tables.clustered_strokes(rows), boxes).withColumn("at", F.round("at", 9))


def _grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Cells and spans of a grid for each supplier, its stroke between the first two cells missing."""
    s = derive.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("table_id"), (2 + F.col("s_suppkey") % 3).cast("int").alias("nr"), (2 + F.col("s_suppkey") % 2).cast("int").alias("nc"))
    ten = lambda c: (c * 10).cast("double")
    rows = s.select("table_id", F.lit(True).alias("horizontal"), F.explode(F.sequence(F.lit(0), F.col("nr"))).alias("r"), F.lit(0.0).alias("low"), ten(F.col("nc")).alias("high"))
    rows = rows.select("table_id", "horizontal", ten(F.col("r")).alias("at"), "low", "high")
    cols = s.select("table_id", F.lit(False).alias("horizontal"), F.explode(F.sequence(F.lit(0), F.col("nc"))).alias("c"), ten(F.col("nr")).alias("high"))
    cols = cols.select("table_id", "horizontal", ten(F.col("c")).alias("at"), F.when(F.col("c") == 1, 10.0).otherwise(0.0).alias("low"), "high")
    cells = tables.lattice_cells(rows.unionByName(cols))
    return cells, tables.lattice_spans(cells)


_GRID = "k AS (SELECT s_suppkey AS t, r, c FROM supplier, (SELECT unnest(range(1, 5)) AS r), (SELECT unnest(range(1, 4)) AS c) WHERE r <= 2 + s_suppkey % 3 AND c <= 2 + s_suppkey % 2)"


@_query(f"""
WITH {_GRID}, v AS (SELECT t, r, c, CASE WHEN r = 1 AND c = 2 THEN '-' WHEN r = 2 AND c = 1 AND t % 4 = 0 THEN '<NEST TABLE>' WHEN (t + r + c) % 3 = 0 THEN '' ELSE 'a' || r || c || chr(10) || 'b' || r || c END AS v FROM k),
w AS (SELECT t, r, string_agg(v, '|' ORDER BY c) AS w FROM v GROUP BY ALL) SELECT t AS table_id, string_agg(w, '/' ORDER BY r) AS grid FROM w GROUP BY 1
""")
def cell_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of ruled tables by rows, two lines in most cells, some cells with a table of their own."""
    cells, spans = _grid(spark, sf_dir)
    r, c = F.col("row").cast("string"), F.col("col").cast("string")
    own = cells.where((F.col("table_id") + F.col("row") + F.col("col")) % 3 != 0)
    line = lambda i, mark, a: own.select("table_id", F.lit(i).alias("ordinal"), F.concat(F.lit(mark), r, c).alias("text"), geometry.box(F.col("x0") + 1, F.col("y0") + a, F.col("x1") - 1, F.col("y0") + a + 3).alias("box"))
    texts = tables.cell_texts(cells, line(1, "b", 5).unionByName(line(0, "a", 1)))
    nested = cells.select("table_id", "row", "col", ((F.col("row") == 2) & (F.col("col") == 1) & (F.col("table_id") % 4 == 0)).alias("nested")).join(texts, ["table_id", "row", "col"], "left")
    shown = F.transform("grid", lambda x: F.array_join(x, "|", "-"))
    return tables.text_grid(nested, spans).select("table_id", F.array_join(shown, "/").alias("grid"))


@_query(f"""
WITH {_GRID} SELECT t AS table_id, r::INTEGER AS row, c::INTEGER AS col, 10.0::DOUBLE AS row_height, r = 1 AND c = 2 AS swallowed, CASE WHEN r = 1 AND c = 2 THEN -1 WHEN r = 1 AND c = 1 THEN 2 ELSE 1 END::BIGINT AS col_span,
  CASE WHEN r = 1 AND c = 2 THEN -1 WHEN r = 1 AND c = 1 THEN 20 ELSE c * 10 END::DOUBLE AS x1, CASE WHEN r = 1 AND c = 2 OR r > 1 THEN -1 ELSE 7 END::INTEGER AS fill, CASE WHEN r = 1 AND c = 2 THEN '' ELSE (CASE WHEN r % 2 = 1 THEN '1.0' ELSE '2.0' END) || ',none,none,none' END AS widths FROM k
""")
def table_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole tables with the cells that merges swallow; strokes above each row, the first row shaded."""
    cells, spans = _grid(spark, sf_dir)
    keys = ["table_id", "row", "col"]
    wide = cells.join(spans, keys).where("col_span > 0").withColumn("x1", F.col("x0") + 10 * F.col("col_span"))
    s = derive.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("table_id"))
    rows = cells.select("table_id", "row", "y0").distinct()
    strokes = rows.select("table_id", F.lit(True).alias("horizontal"), F.col("y0").alias("at"), F.lit(0.0).alias("low"), F.lit(30.0).alias("high"), F.when(F.col("row") % 2 == 1, 1.0).otherwise(2.0).alias("width"), F.lit(0).alias("color"))
    borders = tables.cell_borders(wide, strokes)
    borders = borders.where("side = 'top'").unionByName(borders.where("side <> 'top'").withColumns({"width": F.lit(None).cast("double"), "color": F.lit(None).cast("int")}))
    fills = s.select("table_id", F.lit(0).alias("ordinal"), geometry.box(F.lit(0.0), F.lit(0.0), F.lit(30.0), F.lit(10.0)).alias("box"), F.lit(7).alias("color"))
    out = tables.table_blocks(cells, spans, borders, tables.cell_shading(wide, borders, fills))
    cell = F.col("cell")
    widths = F.array_join(F.transform(cell["border_widths"], lambda x: x.cast("string")), ",", "none")
    return out.select(*keys, "row_height", cell.isNull().alias("swallowed"), F.coalesce(cell["col_span"], F.lit(-1)).alias("col_span"), F.coalesce(cell["x1"], F.lit(-1.0)).alias("x1"), F.coalesce(cell["fill"], F.lit(-1)).alias("fill"), F.coalesce(widths, F.lit("")).alias("widths"))


# ---- decoders


def _written(spark: SparkSession, sf_dir: str, write) -> DataFrame:
    """(doc_id, content): a file of a document's lines, each without control characters, by write(list of lines) -> bytes."""
    rows = derive.lines(spark, sf_dir).select("doc_id", "line_no", F.translate(text.without_controls("text"), "\t\r", "").alias("t"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "t"))), lambda x: x["t"])

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "content": [write(list(x)) for x in batch["t"]]})

    return rows.groupBy("doc_id").agg(parts.alias("t")).mapInPandas(made, "doc_id long, content binary")


def _zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def _docx(lines: list[str]) -> bytes:
    body = "".join(f"<w:p><w:r><w:t>{escape(x)}</w:t></w:r></w:p>" for x in lines)
    return _zipped({"word/document.xml": f"<w:document xmlns:w='w'><w:body>{body}<w:tbl><w:tr><w:tc><w:p><w:t>a</w:t></w:p></w:tc><w:tc/></w:tr></w:tbl></w:body></w:document>"})


def _pptx(lines: list[str]) -> bytes:
    return _zipped({f"ppt/slides/slide{i + 1}.xml": f"<p:sld xmlns:p='p'><p:sp><p:p><p:t>{escape(x)}</p:t></p:p></p:sp><p:pic/></p:sld>" for i, x in enumerate(lines)})


def _xlsx(lines: list[str]) -> bytes:
    rows = "".join(f"<row r='{i + 1}'><c r='A{i + 1}'><v>{i}</v></c><c r='AB{i + 1}' t='inlineStr'><is><t>{escape(x)}</t></is></c></row>" for i, x in enumerate(lines))
    return _zipped({"xl/workbook.xml": "<workbook><sheets><sheet name='S1'/></sheets></workbook>", "xl/worksheets/sheet1.xml": f"<worksheet><sheetData>{rows}</sheetData><mergeCells><mergeCell ref='A1:B1'/></mergeCells></worksheet>"})


_PLAIN = "regexp_replace(text, '[\\x01-\\x08\\x09\\x0B-\\x1F]', '', 'g')"


@_query(f"""
WITH {derive.LINES_SQL}, t AS (SELECT doc_id, line_no, {_PLAIN} AS t FROM lines)
SELECT doc_id, 'docx' AS kind, 0 AS page_num, 'text' AS type, t AS text, count(*) AS n FROM t WHERE regexp_matches(t, '[^\\s]') GROUP BY ALL
UNION ALL SELECT doc_id, 'docx', 0, 'table', ' | a | ', 1 FROM t GROUP BY ALL
UNION ALL SELECT doc_id, 'pptx', line_no, 'text', t, 1 FROM t WHERE regexp_matches(t, '[^\\s]') UNION ALL SELECT doc_id, 'pptx', line_no, 'image', NULL, 1 FROM t
""")
def office_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of DOCX and PPTX files written from the documents."""
    docx = files.docx(_written(spark, sf_dir, _docx)).withColumn("kind", F.lit("docx"))
    pptx = files.pptx(_written(spark, sf_dir, _pptx)).withColumn("kind", F.lit("pptx"))
    return docx.unionByName(pptx).groupBy("doc_id", "kind", "page_num", "type", "text").agg(F.count(F.lit(1)).alias("n"))


@_query(f"""
WITH {derive.LINES_SQL}, t AS (SELECT doc_id, line_no, {_PLAIN} AS t FROM lines)
SELECT doc_id, line_no AS row_index, 0 AS col_index, line_no::VARCHAR AS value, CASE WHEN line_no = 0 THEN 2 ELSE 1 END::INTEGER AS merged_width FROM t UNION ALL SELECT doc_id, line_no, 27, t, 1 FROM t
""")
def workbook_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of XLSX files written from the documents, merges resolved."""
    cells, merges = files.xlsx(_written(spark, sf_dir, _xlsx))
    return tables.visible_cells(cells, merges).select("doc_id", "row_index", "col_index", F.coalesce("value", F.lit("")).alias("value"), F.col("merged_width").cast("int").alias("merged_width"))


def _markdown(lines: list[str]) -> bytes:
    marks = ("# h{}", "- i{}", "t{}", "| c{} |\n|---|\n", "```\nk{}\n```")
    return "\n".join(marks[i % 5].format(x) for i, x in enumerate(lines)).encode()


@_query(f"""
WITH {derive.LINES_SQL}, t AS (SELECT doc_id, line_no, {_PLAIN} AS t FROM lines)
SELECT doc_id, line_no AS ordinal, ['Title', 'List', 'Text', 'Table', 'Code'][(line_no % 5 + 1)::INTEGER] AS layout_type, CASE WHEN line_no % 5 = 0 THEN 1 ELSE 0 END::INTEGER AS level,
  CASE line_no % 5 WHEN 0 THEN regexp_replace('h' || t, '\\s+$', '') WHEN 1 THEN regexp_replace('- i' || t, '\\s+$', '') WHEN 2 THEN 't' || t WHEN 3 THEN '| c' || t || ' |' || chr(10) || '|---|' ELSE 'k' || t END AS text FROM t
""")
def markdown_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of Markdown texts written from the documents."""
    return files.markdown(_written(spark, sf_dir, _markdown)).select("doc_id", "ordinal", "layout_type", "level", "text")


# ---- whole parses and reports

_TYPES = ("txt", "docx", "md", "bin", "py", "pptx")


@_query(f"""
WITH t AS (SELECT doc_id, text, 'f' || doc_id || '.' || [{", ".join(repr(x) for x in _TYPES)}][(doc_id % {len(_TYPES)} + 1)::INTEGER] AS name, doc_id % {len(_TYPES)} AS k FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, name, 'layout' AS parse_type, 0 AS page_num, 0 AS ordinal, 'text' AS type, text, FALSE AS failed FROM t WHERE k IN (0, 2, 4) UNION ALL SELECT doc_id, name, 'layout', NULL, NULL, NULL, NULL, TRUE FROM t WHERE k IN (1, 5)
  UNION ALL SELECT doc_id, name, 'dom', 0, 0, 'Text', text, FALSE FROM t WHERE k IN (0, 2))
SELECT r.doc_id, md5(r.name || t.text || 'all') AS file_md5, parse_type, page_num, ordinal, type, r.text, failed FROM r JOIN t USING (doc_id)
""")
def parsed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files parsed to blocks and to tree nodes in one plan; damaged files give a row with an error."""
    docs = derive.table(spark, sf_dir, "documents").where("text IS NOT NULL AND doc_id IS NOT NULL")
    ext = F.element_at(F.array(*[F.lit(x) for x in _TYPES]), (F.col("doc_id") % len(_TYPES)).cast("int") + 1)
    named = docs.select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("name"), F.col("text").cast("binary").alias("content"))
    return parse.parsed(named, "all").select("doc_id", "file_md5", "parse_type", "page_num", "ordinal", "type", "text", F.col("error").isNotNull().alias("failed"))


@_query(f"""
WITH {derive.TURNS_SQL}, {_NODES}, {_ONE}, le AS ({_EDGES} labels_), pe AS ({_EDGES} parsed_),
e AS (SELECT e.doc_id, e.child, e.parent FROM le e LEFT JOIN one c ON c.doc_id = e.doc_id AND c.label = e.child LEFT JOIN one p ON p.doc_id = e.doc_id AND p.label = e.parent
  WHERE e.parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pe h WHERE h.doc_id = e.doc_id AND h.child = c.parsed AND h.parent = p.parsed)),
x AS (SELECT l.doc_id, 'split' AS kind, l.order_num, 'split ' || l.order_num || ': ' || l.text AS line FROM labels_ l WHERE l.ordinal % 3 = 0
  UNION ALL SELECT e.doc_id, 'edge', e.child, 'edge ' || e.child || ' under ' || e.parent || ': ' || p.text || ' | ' || c.text FROM e JOIN labels_ c ON c.doc_id = e.doc_id AND c.order_num = e.child JOIN labels_ p ON p.doc_id = e.doc_id AND p.order_num = e.parent)
SELECT doc_id, count_if(kind = 'split')::BIGINT AS n_split, count_if(kind = 'edge')::BIGINT AS n_edge, sha256(string_agg(line, chr(10) ORDER BY kind, order_num)) AS report_sha256 FROM x GROUP BY 1
""")
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels without a match (every third) and lost edges of each document, as a report."""
    labels, parsed, mapped = _nodes(spark, sf_dir)
    edges = evaluate.judged_edges(mapped, evaluate.title_edges(labels), evaluate.title_edges(parsed))
    scores = labels.select("doc_id", F.col("order_num").alias("label"), F.lit(None).cast("string").alias("parsed"), F.when(F.col("ordinal") % 3 == 0, 0.0).otherwise(0.9).alias("score"))
    out = evaluate.report(evaluate.bad_cases(labels, scores, edges))
    return out.select("doc_id", F.col("n_split").cast("long").alias("n_split"), F.col("n_edge").cast("long").alias("n_edge"), F.sha2(F.col("report").cast("binary"), 256).alias("report_sha256"))

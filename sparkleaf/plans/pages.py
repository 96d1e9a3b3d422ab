"""Queries of page clean-up, line joining, element order and standard trees, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, text
from ..operators import blocks, evaluate, relations, spatial, standard, tables
from ..streaming import events
from . import derive
from .catalog import _NODES, _PARENT, _nodes, _query, _tree

_PAGE_SIZES = "SELECT DISTINCT doc_id, page, 300.0 AS width, 110.0 AS height FROM lines"


def _boxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.with_box(derive.boxes(spark, sf_dir))


def _sizes(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "page").distinct().select("*", F.lit(300.0).alias("width"), F.lit(110.0).alias("height"))


@_query(f"""
WITH {derive.BOXES_SQL}
SELECT doc_id, page, ordinal FROM boxes WHERE (line_no % 9 = 0 OR regexp_matches(text, '[^\\s]')) AND line_no % 5 < 4 AND least(x1, 300) > greatest(x0, 0) AND least(y1, 110) > greatest(y0, 0)
""")
def valid_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines on the page, not blank, running to the right or up; every ninth holds an image, every fifth is slanted."""
    n = F.col("line_no")
    rows = _boxed(spark, sf_dir).withColumns({"dx": F.when(n % 5 < 3, 1.0).otherwise(0.0), "dy": F.when(n % 5 == 3, -1.0).when(n % 5 == 4, 0.5).otherwise(0.0), "has_image": n % 9 == 0})
    return blocks.valid_lines(rows, _sizes(rows)).select("doc_id", "page", "ordinal")


@_query(f"WITH {derive.LINES_SQL} SELECT doc_id, line_no FROM lines WHERE regexp_matches(text, '[^\\s]') OR line_no % 3 = 0")
def live_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans with text or style."""
    rows = derive.lines(spark, sf_dir).withColumn("style", F.when(F.col("line_no") % 3 == 0, F.array(F.lit(1))).when(F.col("line_no") % 3 == 1, F.array().cast("array<int>")))
    return blocks.live_spans(rows).select("doc_id", "line_no")


@_query(f"""
WITH {derive.BOXES_SQL}, s AS (SELECT *, x0 + length(text) % 5 AS x2, y0 + length(text) % 4 AS y2 FROM boxes)
SELECT doc_id, page, ordinal FROM s WHERE greatest(x2 - x0, y2 - y0) >= 2 AND x2 > x0 AND y2 > y0 AND x0 < 300 AND y0 < 110
""")
def live_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes on the page of two points or more."""
    n = F.length("text")
    rows = derive.boxes(spark, sf_dir).withColumns({"x1": F.col("x0") + n % 5, "y1": F.col("y0") + n % 4})
    rows = derive.with_box(rows)
    return blocks.live_shapes(rows, _sizes(rows)).select("doc_id", "page", "ordinal")


@_query(f"""
WITH {derive.LINES_SQL}, s AS (SELECT doc_id, line_no, ['stroke', 'fill', 'hyperlink'][(line_no % 3 + 1)::INTEGER] AS kind, CASE WHEN length(text) % 2 = 0 THEN 16777215 ELSE 255 END AS color, length(text) % 64 AS p FROM lines)
SELECT doc_id, line_no, kind = 'stroke' AS is_stroke, kind = 'fill' AND color <> 16777215 AS is_fill, kind = 'hyperlink' AS is_link, p & 16 <> 0 AS may_border, p & 32 <> 0 AS may_shade, p & 15 <> 0 AS may_style FROM s
""")
def shape_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What shapes are and may be."""
    n = F.length("text")
    kind = F.element_at(F.array(F.lit("stroke"), F.lit("fill"), F.lit("hyperlink")), (F.col("line_no") % 3 + 1).cast("int"))
    rows = derive.lines(spark, sf_dir).select("doc_id", "line_no", kind.alias("kind"), F.when(n % 2 == 0, 16777215).otherwise(255).alias("color"), (n % 64).alias("potential"))
    return blocks.shape_roles(rows).drop("kind", "color", "potential")


@_query(f"""
WITH {derive.LINES_SQL}, b AS (SELECT doc_id, line_no, length(text) % 6 - 1 AS t FROM lines)
SELECT doc_id, line_no, t = 0 AS is_text, t IN (1, 4) AS is_image, t = 4 AS is_float, t = 2 AS is_lattice, t = 3 AS is_stream, t IN (2, 3) AS is_table FROM b
""")
def block_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of blocks by their number."""
    rows = derive.lines(spark, sf_dir).select("doc_id", "line_no", (F.length("text") % 6 - 1).alias("block_type"))
    return blocks.block_roles(rows).drop("block_type")


@_query(f"""
WITH {derive.BOXES_SQL}
SELECT doc_id, page, ordinal, row_number() OVER (PARTITION BY doc_id, page ORDER BY x0, y0, x1, ordinal)::INTEGER AS line_pos, row_number() OVER (PARTITION BY doc_id, page ORDER BY y1, x0, y0, ordinal)::INTEGER AS vertical_pos FROM boxes
""")
def line_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order of boxes along their lines."""
    rows = blocks.line_order(_boxed(spark, sf_dir)).withColumnRenamed("line_pos", "a")
    return blocks.line_order(rows, vertical=True).select("doc_id", "page", "ordinal", F.col("a").alias("line_pos"), F.col("line_pos").alias("vertical_pos"))


@_query(f"WITH {derive.LINES_SQL} SELECT doc_id, page, bool_and(length(text) % 3 <> 0) AS underlined FROM lines GROUP BY 1, 2")
def underlined_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages all of whose spans are underlined."""
    rows = derive.lines(spark, sf_dir).select("doc_id", "page", F.when(F.length("text") % 3 != 0, 33).otherwise(17).alias("flags"))
    return blocks.all_underlined(rows, ["doc_id", "page"])


@_query(f"WITH {derive.LINES_SQL} SELECT doc_id, page, CASE WHEN count(DISTINCT length(text) % 2) = 1 THEN max(length(text) % 2) END::INTEGER AS color FROM lines GROUP BY 1, 2")
def border_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one colour of a page's strokes."""
    return blocks.uniform_borders(derive.lines(spark, sf_dir).select("doc_id", "page", (F.length("text") % 2).alias("color")), ["doc_id", "page"])


@_query(f"""
WITH {derive.LINES_SQL} SELECT doc_id, sha256(string_agg('；' || CASE WHEN line_no % 4 = 3 THEN CASE WHEN line_no % 8 = 7 THEN '' ELSE 'seen ' || line_no END ELSE text END, '' ORDER BY line_no)) AS text_sha256 FROM lines GROUP BY 1
""")
def block_list_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block lists as one text, every fourth block an image."""
    n = F.col("line_no")
    rows = derive.lines(spark, sf_dir).select("doc_id", n.alias("block_no"), F.when(n % 4 == 3, "image").otherwise("text").alias("type"), "text", F.when(n % 8 != 7, F.concat(F.lit("seen "), n.cast("string"))).alias("ocr_text"))
    return blocks.block_list_text(rows).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@_query(f"""
WITH {derive.LINES_SQL}, e AS (SELECT doc_id, page, ordinal, ordinal // 2 AS section, (3 - ordinal) % 2 AS col, length(text) AS n FROM lines)
SELECT doc_id, page, section::INTEGER AS section, col::INTEGER AS col, ordinal, row_number() OVER (PARTITION BY doc_id ORDER BY page, section, col, ordinal)::INTEGER AS element_no FROM e WHERE n % 7 <> 0 AND n % 11 <> 0
""")
def element_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks by page, section and column, without headers and footers."""
    o, n = F.col("ordinal"), F.length("text")
    rows = derive.lines(spark, sf_dir).select("doc_id", "page", F.floor(o / 2).cast("int").alias("section"), ((3 - o) % 2).alias("col"), "ordinal", (n % 7 == 0).alias("is_header"), (n % 11 == 0).alias("is_footer"))
    return blocks.element_order(rows).drop("is_header", "is_footer")


@_query(f"""
WITH {derive.LINES_SQL}, p AS (SELECT DISTINCT doc_id, page FROM lines)
SELECT doc_id, page, page >= 1 AND page < 3 AS in_range, page IN (0, 4) AS chosen FROM p WHERE (page >= 1 AND page < 3) OR page IN (0, 4)
""")
def selected_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages chosen by range and by list."""
    pages = derive.lines(spark, sf_dir).select("doc_id", "page").distinct()
    a = blocks.selected_pages(pages, 1, 3).withColumn("in_range", F.lit(True))
    b = blocks.selected_pages(pages, 7, 9, [0, 4]).withColumn("chosen", F.lit(True))
    return a.join(b, ["doc_id", "page"], "full").fillna(False, ["in_range", "chosen"])


@_query()
def joined_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines joined to blocks, every eleventh line a table."""
    n = F.col("line_no")
    rows = derive.boxes(spark, sf_dir).withColumns({"type": F.when(n % 11 == 10, "table").otherwise("text"), "has_image": n % 13 == 12})
    return blocks.block_texts(blocks.joined(rows))


@_query(f"""
WITH RECURSIVE {derive.TURNS_SQL}, {_PARENT}, s AS (SELECT doc_id, sort, order_num, ordinal, text, CASE layout_type WHEN 'List' THEN 'ListItem' ELSE layout_type END AS type, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}\\p{{M}}_]+|[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s]'))::BIGINT AS own FROM tree)
SELECT a.doc_id, a.ordinal, a.order_num, a.type, a.text, a.ordinal // 4 AS page, (a.ordinal * 10)::DOUBLE AS y0, sum(b.own)::BIGINT AS tokens FROM s a JOIN s b ON a.doc_id = b.doc_id AND (b.sort = a.sort OR starts_with(b.sort, a.sort || '.')) GROUP BY ALL
""")
def standard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation trees as standard nodes (texts only; tables, images and captions are tested on fixtures)."""
    o = F.col("ordinal")
    rows = _tree(spark, sf_dir).withColumns({"page_num": F.floor(o / 4).cast("int"), "bbox": F.array(F.lit(0.0), (o * 10).cast("double"), F.lit(100.0), (o * 10 + 8).cast("double"))})
    e = standard.standard_nodes(rows)
    at = F.col("element.positions")[0]
    return e.select("doc_id", "ordinal", F.array_join(F.transform("path", lambda x: x.cast("string")), ".").alias("order_num"), F.col("element.type").alias("type"), F.col("element.text").alias("text"), at["page"].alias("page"), at["bbox"][1].alias("y0"), "tokens")


# ---- operators that so far had unit tests only


@_query(f"""
WITH {derive.BOXES_SQL}, t AS (SELECT doc_id, page, 72.0 AS x0, 72.0 + 14 * k AS y0, 200.0 AS x1, 84.0 + 14 * k AS y1, k FROM (SELECT DISTINCT doc_id, page FROM boxes), (SELECT unnest([0, 2]) AS k)),
h AS (SELECT DISTINCT b.doc_id, b.page, b.ordinal FROM boxes b JOIN t USING (doc_id, page) WHERE (length(b.text) % 2 = 0) = (t.k = 0) AND (b.x1 - b.x0) * (b.y1 - b.y0) > 0
  AND greatest(0, least(b.x1, t.x1) - greatest(b.x0, t.x0)) * greatest(0, least(b.y1, t.y1) - greatest(b.y0, t.y0)) >= 0.5 * (b.x1 - b.x0) * (b.y1 - b.y0))
SELECT doc_id, page, ordinal FROM boxes ANTI JOIN h USING (doc_id, page, ordinal)
""")
def hidden_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks without those under an invisible trace of their font."""
    rows = _boxed(spark, sf_dir)
    spans = rows.select("doc_id", "page", F.col("ordinal").alias("block_no"), F.when(F.length("text") % 2 == 0, "a").otherwise("b").alias("font"), "box")
    k = F.col("k")
    traces = rows.select("doc_id", "page").distinct().withColumn("k", F.explode(F.array(F.lit(0), F.lit(2))))
    traces = traces.select("doc_id", "page", k.alias("ordinal"), F.lit(3).alias("type"), F.when(k == 0, "a").otherwise("b").alias("font"), geometry.box(F.lit(72.0), 72.0 + 14 * k, F.lit(200.0), 84.0 + 14 * k).alias("box"))
    return spatial.hidden_text(rows, spans, traces).select("doc_id", "page", "ordinal")


@_query(f"""
WITH {derive.LINES_SQL}, t AS (SELECT doc_id, page, ordinal, (ordinal % 2)::INTEGER AS type, CASE WHEN length(text) % 3 = 0 THEN 'x' ELSE 'y' END AS chars FROM lines),
n AS (SELECT *, lead(type) OVER w AS nt, lead(chars) OVER w AS nc FROM t WINDOW w AS (PARTITION BY doc_id, page ORDER BY ordinal))
SELECT doc_id, page, ordinal, coalesce(nt = 1 AND nc = chars, FALSE) AS pseudo_bold FROM n WHERE type = 0
""")
def pseudo_bold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills that a stroke of the same characters follows."""
    rows = derive.lines(spark, sf_dir).select("doc_id", "page", "ordinal", (F.col("ordinal") % 2).alias("type"), F.when(F.length("text") % 3 == 0, "x").otherwise("y").alias("chars"))
    return spatial.pseudo_bold(rows).select("doc_id", "page", "ordinal", "pseudo_bold")


@_query(f"""
WITH {derive.BOXES_SQL}, r AS (SELECT doc_id, page, ordinal, y0, y1, lag(y1) OVER (PARTITION BY doc_id, page ORDER BY ordinal) AS p FROM boxes)
SELECT doc_id, page, ordinal, CASE WHEN p IS NULL THEN 0.0 ELSE greatest(0.0, y0 - p) END::DOUBLE AS before_space, p IS NULL AS first_line FROM r
""")
def block_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free height above each line."""
    rows = relations.spacing(_boxed(spark, sf_dir))
    return rows.select("doc_id", "page", "ordinal", F.when(F.col("ordinal") == 0, 0.0).otherwise(F.col("before_space")).alias("before_space"), (F.col("ordinal") == 0).alias("first_line"))


@_query(f"""
WITH {derive.TURNS_SQL}, l AS (SELECT doc_id, ordinal, ordinal * 20.0 AS y0, ordinal * 20.0 + 10 AS y1 FROM turns), p AS (SELECT doc_id, ordinal, ordinal * 20.0 + ordinal % 6 AS y0, ordinal * 20.0 + 10 + ordinal % 6 AS y1 FROM turns),
m AS (SELECT l.doc_id, l.ordinal AS lo, p.ordinal AS po, greatest(0, least(l.y1, p.y1) - greatest(l.y0, p.y0)) * 50 AS i FROM l JOIN p USING (doc_id)),
k AS (SELECT *, CASE WHEN i / (1000 - i) > 0.6 THEN 'match' ELSE 'small' END AS kind FROM m WHERE i > 0)
SELECT doc_id, 'L' || lo AS label, 'P' || po AS parsed, kind FROM (SELECT *, min(CASE WHEN kind = 'match' THEN po END) OVER (PARTITION BY doc_id, lo) AS f FROM k) WHERE f IS NULL OR po <= f
""")
def box_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels matched to parsed nodes by their boxes."""
    labels, _, _ = _nodes(spark, sf_dir)
    o = F.col("ordinal")
    at = lambda d: geometry.box(F.lit(0.0), (o * 20 + d).cast("double"), F.lit(50.0), (o * 20 + 10 + d).cast("double"))
    parsed = labels.withColumn("order_num", F.concat(F.lit("P"), o.cast("string")))
    return evaluate.box_mapping(labels.withColumn("box", at(F.lit(0))), parsed.withColumn("box", at(o % 6)))




_BOX_CASES = [
    ((0, 0, 10, 100), (2, 0, 12, 100)),
    ((0, 0, 100, 10), (0, 0, 102, 10)),
    ((0, 0, 100, 10), (0, 0, 101, 10)),
    ((0, 0, 10, 10), (5, 5, 5, 5)),
    ((0, 0, 5, 5), (5, 0, 9, 5)),
    ((0, 0, 5, 5), (6, 0, 9, 5)),
    ((0, 0, 10, 10), (0, 0, 10, 6)),
    ((0, 0, 10, 10), (0, 0, 10, 6.5)),
    ((0, 0, 10, 4), (0, 1, 10, 5)),
    ((0, 0, 50, 10), (40, 3, 60, 9)),
    ((72, 72, 272, 84), (72, 72, 272, 84)),
]


@_query(f"""
WITH g AS (SELECT * FROM (VALUES {", ".join(f"({i}, {', '.join(f'{float(v)}::DOUBLE' for v in (*a, *b))})" for i, (a, b) in enumerate(_BOX_CASES))}) t(n, x0, y0, x1, y1, a, b, c, d)),
k AS (SELECT doc_id * 100 + n AS id, g.*, greatest(0, least(x1, c) - greatest(x0, a)) * greatest(0, least(y1, d) - greatest(y0, b)) AS i, (x1 - x0) * (y1 - y0) AS s, (c - a) * (d - b) AS t FROM documents, g WHERE doc_id IS NOT NULL)
SELECT id, t > 0 AND round(i / greatest(t, 1e-9), 2) >= 0.75 AND CASE WHEN x1 - x0 >= y1 - y0 THEN x1 - x0 + 1 >= c - a ELSE y1 - y0 + 1 >= d - b END AS covers,
  CASE WHEN i > 0 AND i / least(s, t) >= 0.5 THEN greatest(x1, c) - least(x0, a) END AS union_width, (x1 - x0) + (c - a) - (greatest(x1, c) - least(x0, a)) + 0.001 >= 0.5 * least(x1 - x0, c - a) AS in_column,
  (y1 - y0) + (d - b) - (greatest(y1, d) - least(y0, b)) + 0.001 >= 0.5 * least(y1 - y0, d - b) AS in_line, CASE WHEN i = 0 THEN 'none' WHEN i / (s + t - i) > 0.6 THEN 'match' ELSE 'small' END AS kind,
  c - a < 0.9 * 100 AND abs((a + c) / 2 - 50) < 30 AS centred FROM k
""")
def box_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of boxes at their boundaries: tall and empty boxes, equal shares, edges that only touch."""
    rows = derive.table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select("doc_id")
    side = lambda b: F.struct(*[F.lit(float(v)).alias(c) for v, c in zip(b, ("x0", "y0", "x1", "y1"), strict=True)])
    cases = F.array(*[F.struct(F.lit(i).alias("n"), side(a).alias("a"), side(b).alias("b")) for i, (a, b) in enumerate(_BOX_CASES)])
    rows = rows.select("doc_id", F.explode(cases).alias("k")).select((F.col("doc_id") * 100 + F.col("k.n")).alias("id"), "k.a", "k.b")
    whole = geometry.main_box("a", "b", 0.5)
    return rows.select("id", geometry.covers("a", "b", 0.75).alias("covers"), (whole["x1"] - whole["x0"]).alias("union_width"), geometry.in_column("a", "b", 0.5).alias("in_column"), geometry.in_line("a", "b", 0.5).alias("in_line"), geometry.iou_class("a", "b").alias("kind"), geometry.centred("b", F.lit(0.0), F.lit(100.0)).alias("centred"))


@_query(f"""
WITH {derive.LINES_SQL}, t AS (SELECT doc_id, line_no, text, repeat(' ', (line_no % 4)::INTEGER) || text || repeat(' ', (line_no % 3)::INTEGER) || chr(31) || chr(1) AS raw, lag(text) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM lines),
c AS (SELECT *, regexp_replace(raw, '[\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g') AS clean FROM t)
SELECT doc_id, line_no, CASE WHEN regexp_matches(clean, '^ {{2,}}') THEN regexp_replace(clean, '^ {{2,}}', ' ') ELSE regexp_replace(clean, ' {{2,}}$', ' ') END AS stripped,
  regexp_replace(regexp_replace(text || '............ 12', '\\s+', '', 'g'), '\\.{{2,}}', '<目录体中连续点点点>', 'g') AS compared,
  contains(replace(CASE WHEN line_no % 2 = 0 THEN '目 录 ' ELSE '' END || text, ' ', ''), '目录') AS heading
FROM c
""")
def cleaned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control characters removed and ends stripped, texts as evaluations compare them, catalog headings."""
    n, t = F.col("line_no"), F.col("text")
    raw = F.concat(F.repeat(F.lit(" "), n % 4), t, F.repeat(F.lit(" "), n % 3), F.lit("\x1f\x01"))
    return derive.lines(spark, sf_dir).select("doc_id", "line_no", text.edge_blanks(text.without_controls(raw)).alias("stripped"), text.evaluation_text(F.concat(t, F.lit("............ 12"))).alias("compared"), text.is_catalog_heading(F.concat(F.when(n % 2 == 0, "目 录 ").otherwise(""), t)).alias("heading"))


@_query(f"""
WITH {derive.BOXES_SQL}, r AS (SELECT *, max(y1) OVER (PARTITION BY doc_id, page ORDER BY y0, x0, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM boxes),
n AS (SELECT *, sum(CASE WHEN reach IS NULL OR y0 >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY y0, x0, ordinal ROWS UNBOUNDED PRECEDING) AS row_no FROM r),
h AS (SELECT doc_id, page, row_no, max(y1 - y0) AS h, min(y0) AS top, max(y1) AS low FROM n GROUP BY ALL),
g AS (SELECT doc_id, page, count(*) AS n_rows, max(low) - min(top) - sum(h) AS free FROM h GROUP BY ALL),
o AS (SELECT doc_id, page, string_agg(DISTINCT d::BIGINT::VARCHAR, ',' ORDER BY d::BIGINT::VARCHAR) AS stops FROM (SELECT doc_id, page, x0 - min(x0) OVER (PARTITION BY doc_id, page) AS d FROM boxes) WHERE d >= 1 GROUP BY ALL)
SELECT doc_id, page, n_rows, CASE WHEN n_rows > 1 THEN free / (n_rows - 1) END AS gap, coalesce(stops, '') AS stops FROM g LEFT JOIN o USING (doc_id, page)
""")
def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a page, their average gap, and its tab stops."""
    rows = _boxed(spark, sf_dir)
    stops = relations.tab_stops(rows).select("doc_id", "page", F.array_join(F.transform("stops", lambda x: x.cast("long").cast("string")), ",").alias("stops"))
    return spatial.row_gaps(rows).join(stops, ["doc_id", "page"], "left").select("doc_id", "page", "n_rows", "gap", F.coalesce("stops", F.lit("")).alias("stops"))


@_query(f"""
WITH {derive.TURNS_SQL}, m AS (SELECT doc_id, 'L' || ordinal AS label, CASE WHEN ordinal % 3 = 0 THEN 0.0 ELSE 0.8 + (ordinal % 5) * 0.05 END AS s FROM turns)
SELECT coalesce(doc_id, -1) AS doc_id, round(avg(s), 9) AS score, count_if(s > 0)::BIGINT AS matched, count(*) AS labels FROM m GROUP BY ROLLUP (doc_id)
""")
def block_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean similarity of labels by document and over all."""
    o = F.col("ordinal")
    rows = derive.turns(spark, sf_dir).select("doc_id", F.concat(F.lit("L"), o.cast("string")).alias("label"), F.when(o % 3 == 0, 0.0).otherwise(F.lit(0.8) + (o % 5) * 0.05).alias("score"))
    return evaluate.block_scores(rows).select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), F.round("score", 9).alias("score"), F.col("matched").cast("long").alias("matched"), "labels")


@_query(f"""
WITH {derive.TURNS_SQL}, {_NODES}, one AS (SELECT doc_id, label, any_value(parsed) AS p FROM mapped WHERE parsed IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1)
SELECT l.doc_id, l.order_num AS label, coalesce(p.ordinal * 2, -1)::DOUBLE AS x0, p.text IS NOT NULL AND p.text <> l.text AS differs FROM labels_ l LEFT JOIN one ON one.doc_id = l.doc_id AND one.label = l.order_num LEFT JOIN parsed_ p ON p.doc_id = l.doc_id AND p.order_num = one.p
""")
def filled_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with the box of their single match."""
    labels, parsed, mapped = _nodes(spark, sf_dir)
    x = (F.col("ordinal") * 2).cast("double")
    parsed = parsed.withColumn("box", geometry.box(x, x, x + 1, x + 1))
    rows = evaluate.filled_boxes(labels, mapped, parsed)
    return rows.select("doc_id", F.col("order_num").alias("label"), F.coalesce("matched_box.x0", F.lit(-1.0)).alias("x0"), "differs")


@_query(f"""
WITH {derive.LINES_SQL}, r AS (SELECT doc_id, line_no, line_no % 4 AS tries FROM lines) SELECT doc_id, line_no, (tries + 1)::INTEGER AS tries, CASE WHEN tries + 1 >= 3 THEN 'dead' ELSE 'retry' END AS "next", CASE WHEN line_no % 5 = 0 AND line_no % 2 = 0 THEN 'failed' ELSE 'finished' END AS status FROM r
""")
def retried_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where failed files go next, and the status of parse results."""
    n = F.col("line_no")
    rows = derive.lines(spark, sf_dir).select("doc_id", "line_no", (n % 4).alias("tries"), F.when(n % 5 != 0, "l").alias("layout"), F.when(n % 2 != 0, "d").alias("dom"))
    return events.parse_status(events.retries(rows)).select("doc_id", "line_no", "tries", "next", "status")


_GRID = "g AS (SELECT doc_id AS table_id, r AS row, c AS col, c * 50.0 AS x0, r * 20.0 AS y0, c * 50.0 + 50 AS x1, r * 20.0 + 20 AS y1 FROM (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL), (SELECT unnest([0, 1]) AS r), (SELECT unnest([0, 1]) AS c))"
_STROKES = "s AS (SELECT table_id, row, x0 + table_id % 20 AS low, x1 AS high, y0 AS at, 1.0 + col AS width, CASE WHEN table_id % 3 = 0 THEN col ELSE 7 END AS color FROM g UNION ALL SELECT table_id, row, x0, x0 + 45, y0, 3.0, 7 FROM g WHERE table_id % 4 = 0 AND col = 0)"


@_query(f"""
WITH {_GRID}, {_STROKES},
m AS (SELECT g.table_id, g.row, g.col, least(s.high, g.x1) - greatest(s.low, g.x0) AS d, s.width, s.color, s.low, s.high FROM g JOIN s ON s.table_id = g.table_id AND s.at = g.y0),
t AS (SELECT table_id, row, col, min_by(width, low * 1000000 + high) AS width, min(color) AS color FROM m WHERE d >= 5 GROUP BY ALL HAVING sum(d) >= 37.5 AND count(DISTINCT color) = 1)
SELECT g.table_id, g.row, g.col, t.width::DOUBLE AS top_width, t.color::INTEGER AS top_color, CASE WHEN 0.9 <= round(CASE WHEN g.col = 0 THEN 1 ELSE (least(g.x1, 98 - g.table_id % 5) - g.x0) / 50 END, 2) THEN 'shaded' ELSE 'plain' END AS shade FROM g LEFT JOIN t USING (table_id, row, col)
""")
def table_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper borders and shading of a small table for each document."""
    side = lambda name: F.explode(F.array(F.lit(0), F.lit(1))).alias(name)
    grid = derive.table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select(F.col("doc_id").alias("table_id"), side("row")).select("*", side("col"))
    x, y, t = F.col("col") * 50.0, F.col("row") * 20.0, F.col("table_id")
    cells = grid.select("*", x.alias("x0"), y.alias("y0"), (x + 50).alias("x1"), (y + 20).alias("y1"))
    first = cells.select("table_id", F.lit(True).alias("horizontal"), F.col("y0").alias("at"), (F.col("x0") + t % 20).alias("low"), F.col("x1").alias("high"), (F.col("col") + 1.0).alias("width"), F.when(t % 3 == 0, F.col("col")).otherwise(7).alias("color"))
    more = cells.where("table_id % 4 = 0 AND col = 0").select("table_id", F.lit(True).alias("horizontal"), F.col("y0").alias("at"), F.col("x0").alias("low"), (F.col("x0") + 45).alias("high"), F.lit(3.0).alias("width"), F.lit(7).alias("color"))
    borders = tables.cell_borders(cells, first.unionByName(more))
    fills = cells.where("row = 0 AND col = 0").select("table_id", F.lit(0).alias("ordinal"), geometry.box(F.lit(0.0), F.lit(0.0), 98.0 - t % 5, F.lit(40.0)).alias("box"), F.lit(5).alias("color"))
    shades = tables.cell_shading(cells, borders.where(F.lit(False)), fills)
    top = borders.where("side = 'top'").select("table_id", "row", "col", F.col("width").alias("top_width"), F.col("color").alias("top_color"))
    return top.join(shades, ["table_id", "row", "col"]).select("table_id", "row", "col", "top_width", "top_color", F.when(F.col("fill").isNotNull(), "shaded").otherwise("plain").alias("shade"))


@_query()
def assigned_bold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans with the boldness of the traces that spell them, two for each line."""
    rows = derive.lines(spark, sf_dir)
    half = F.floor(F.length("text") / 2).cast("int")
    o, bold = F.col("ordinal") * 2, F.length("text") % 3 == 0
    one = rows.select("doc_id", "page", o.alias("ordinal"), F.left("text", half).alias("chars"), bold.alias("pseudo_bold"))
    two = rows.select("doc_id", "page", (o + 1).alias("ordinal"), F.substring("text", half + 1, F.length("text")).alias("chars"), bold.alias("pseudo_bold"))
    return blocks.assign_pseudo_bold(rows.select("doc_id", "page", "ordinal", "text"), one.unionByName(two))

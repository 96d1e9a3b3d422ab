"""One query for each document operator over relations derived from the plain tables, and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry, text
from ..operators import evaluate, relations, spatial, tables, tree, votes
from ..sources import files, sinks
from ..streaming import events
from . import derive

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql.strip()
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


_CLEAN = "trim(regexp_replace(translate({}, '(|)一二三四五六七八九十百千万', ''), '[0-9]+', '', 'g'))"
_INTER = "greatest(0, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) * greatest(0, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0))"
_AREA = "(({a}.x1 - {a}.x0) * ({a}.y1 - {a}.y0))"


def _list(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


# ---- sources and files


@_query(f"""
WITH {derive.FILES_SQL}, t AS (SELECT *, lower(regexp_extract(name, '[^.]*$')) AS ext FROM files)
SELECT doc_id, ext, CASE WHEN ext IN ('pdf', 'docx', 'pptx', 'csv', 'xls', 'xlsx') THEN ext WHEN ext IN ({_list(files.TEXT_TYPES)}) THEN 'text' WHEN ext IN ({_list(files.IMAGE_TYPES)}) THEN 'image' END AS layout_parser,
  CASE WHEN ext IN ('pdf', 'xls', 'xlsx') THEN ext WHEN ext IN ('csv', 'txt', 'md', 'html') THEN 'text' END AS dom_parser,
  ext IN ({_list(files.SUPPORTED)}) AS supported FROM t
""")
def file_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension, parsers and support of each file."""
    return derive.files(spark, sf_dir).select("doc_id", text.file_type("name").alias("ext"), files.layout_parser("name").alias("layout_parser"), files.dom_parser("name").alias("dom_parser"), files.is_supported("name").alias("supported"))


@_query(f"""
WITH {derive.FILES_SQL}, t AS (SELECT *, lower(regexp_extract(name, '[^.]*$')) AS ext FROM files)
SELECT CASE WHEN ext NOT IN ({_list(files.SUPPORTED)}) OR bytes > 20000000 OR pages > 5000 THEN 'reject' WHEN ext IN ({_list(files.IMAGE_TYPES)}) THEN 'image' WHEN ext = 'docx' THEN 'document' WHEN bytes > 2000000 OR pages > 30 THEN 'long' ELSE 'short' END AS route, count(*) AS n, sum(bytes)::BIGINT AS bytes
FROM t GROUP BY 1
""")
def file_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and page gates, then routes."""
    rows = derive.files(spark, sf_dir).select(files.route("name", "bytes", "pages").alias("route"), "bytes")
    return rows.groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))


@_query(f"""WITH {derive.FILES_SQL} SELECT doc_id, 0 AS page_num, 'text' AS type, text, NULL::VARCHAR AS error FROM files""")
def text_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text file as one block."""
    return files.text_blocks(derive.files(spark, sf_dir))


@_query(f"""WITH {derive.FILES_SQL} SELECT doc_id, 'Text' AS layout_type, text, NULL::VARCHAR AS error FROM files""")
def text_tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text file as one tree node, its charset guessed."""
    return files.tree_text(derive.files(spark, sf_dir))


@_query(f"""WITH {derive.FILES_SQL} SELECT doc_id, md5(name || text || 'all') AS key FROM files""")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """md5 over name, bytes and parse type."""
    return derive.files(spark, sf_dir).select("doc_id", text.unified_md5("name", "content", F.lit("all")).alias("key"))


@_query(f"""
WITH {derive.FILES_SQL}, c AS (SELECT doc_id, unnest(CASE WHEN doc_id % 3 = 0 THEN ['layout', 'dom'] ELSE ['layout'] END) AS parse_type FROM files WHERE doc_id % 2 = 0)
SELECT doc_id, name FROM files WHERE doc_id NOT IN (SELECT doc_id FROM c GROUP BY 1 HAVING count(DISTINCT parse_type) = 2)
""")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that aren't wholly cached."""
    rows = derive.files(spark, sf_dir)
    kinds = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("layout"), F.lit("dom"))).otherwise(F.array(F.lit("layout")))
    cached = rows.where("doc_id % 2 = 0").select("doc_id", F.explode(kinds).alias("parse_type"))
    return sinks.not_cached(rows, cached, ["layout", "dom"]).select("doc_id", "name")


@_query("""
SELECT r_regionkey::BIGINT AS doc_id, '| r_regionkey | r_name |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || r_regionkey || ' | ' || r_name || ' |' AS text FROM region
""")
def csv_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV files (a header and one record of region) as Markdown tables."""
    region = derive.table(spark, sf_dir, "region")
    content = F.concat(F.lit("r_regionkey,r_name\n"), F.col("r_regionkey").cast("string"), F.lit(',"'), F.col("r_name"), F.lit('"\n')).cast("binary")
    return tables.markdown_records(files.csv_records(region.select(F.col("r_regionkey").cast("long").alias("doc_id"), content.alias("content"))).where("error IS NULL"))


@_query("""SELECT r_regionkey::BIGINT AS doc_id, 0 AS page_num, 'text' AS type, 'key,name' || chr(10) || r_regionkey || ',a' || chr(8232) || r_name || chr(10) AS text, NULL::VARCHAR AS error FROM region""")
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV files as one block each; line ends inside fields are replaced."""
    content = F.concat(F.lit("key,name\n"), F.col("r_regionkey").cast("string"), F.lit(',"a\n'), F.col("r_name"), F.lit('"\n')).cast("binary")
    return files.csv_blocks(derive.table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("doc_id"), content.alias("content")))


# ---- text functions


_TAGGED = """CASE line_no % 8 WHEN 0 THEN '1. ' WHEN 1 THEN '2.3 ' WHEN 2 THEN '（一）' WHEN 3 THEN '①' WHEN 4 THEN '第三章 ' WHEN 5 THEN '★' WHEN 6 THEN 'b) ' ELSE 'x' END"""


def _listed(column: str) -> tuple[str, str]:
    """DuckDB expressions of a text's list type and tag: RE2 has no references, so runs are tried for each of a line's characters."""
    quote = lambda p: p.replace("'", "''")
    run = f"(regexp_matches({column}, '[0-9]\\s*$') AND len(list_filter(list_distinct(string_split({column}, '')), lambda c: regexp_matches({column}, regexp_escape(c) || '{{10,}}\\s*[0-9]+\\s*$'))) > 0)"
    plain = text.LIST_PATTERNS[:-1]
    special = quote(text.SPECIAL_START).replace("\\w", r"\p{L}\p{N}_")
    kinds = " ".join(f"WHEN regexp_matches({column}, '{quote(p)}') THEN '{i}'" for i, p in enumerate(plain, 1))
    tags = " ".join(f"WHEN regexp_matches({column}, '{quote(p)}') THEN regexp_extract({column}, '{quote(p)}')" for p in plain)
    rest = f"nullif(regexp_extract({column}, '{special}'), '')"
    return f"CASE {kinds} WHEN {run} THEN '{len(plain) + 1}' ELSE {rest} END", f"CASE {tags} WHEN {run} THEN {column} ELSE {rest} END"


_LIST_TYPE, _LIST_TAG = _listed("t")


@_query(f"WITH {derive.LINES_SQL} SELECT doc_id, line_no, {_LIST_TYPE} AS list_type, {_LIST_TAG} AS list_tag FROM (SELECT doc_id, line_no, {_TAGGED} || text AS t FROM lines)")
def list_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List types and tags of all lines, with set prefixes."""
    return _tags(derive.lines(spark, sf_dir))


def _tags(rows: DataFrame) -> DataFrame:
    t = F.concat(F.expr(_TAGGED), F.col("text"))
    return rows.select("doc_id", "line_no", text.list_type(t).alias("list_type"), text.list_tag(t).alias("list_tag"))


@_query(f"""WITH {derive.LINES_SQL} SELECT doc_id, line_no, {_CLEAN.format("'Report (三) page ' || line_no || ' ' || text")} AS cleaned FROM lines""")
def number_free_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without numbers and numerals."""
    t = F.concat(F.lit("Report (三) page "), F.col("line_no").cast("string"), F.lit(" "), F.col("text"))
    return derive.lines(spark, sf_dir).select("doc_id", "line_no", text.remove_number(t).alias("cleaned"))


@_query(f"""
WITH {derive.LINES_SQL}, t AS (SELECT *, 'Table ' || line_no || ' ' || text AS a, 'Fig 2-1 ' || text AS b, text || '......12' AS c, text || '..........12' AS d FROM lines)
SELECT doc_id, line_no, 'Table ' || line_no AS table_tag, 'Fig 2-1' AS figure_tag, regexp_matches(c, '\\.{{10,}}[0-9]') AS short_leader, TRUE AS long_leader,
  text <> '' AND contains('.．。?？!！', right(text, 1)) AS closed, text <> '' AND contains(',，''‘“;；、·-[{{(（【《<', right(text, 1)) AS open_ended,
  regexp_replace(text, '[^\\p{{L}}\\p{{N}}_]', '', 'g') AS bare, '> ' || text AS quoted FROM t
""")
def line_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions, leaders, sentence ends, cleaning and quoting of lines."""
    rows = derive.lines(spark, sf_dir)
    n = F.col("line_no").cast("string")
    return rows.select(
        "doc_id", "line_no", text.table_caption(F.concat(F.lit("Table "), n, F.lit(" "), F.col("text"))).alias("table_tag"), text.figure_caption(F.concat(F.lit("Fig 2-1 "), F.col("text"))).alias("figure_tag"),
        F.concat("text", F.lit("......12")).rlike(r"\.{10,}[0-9]").alias("short_leader"), text.has_leader(F.concat("text", F.lit("..........12"))).alias("long_leader"),
        text.ends_sentence("text").alias("closed"), text.is_open_ended("text").alias("open_ended"), text.recognised_text("text").alias("bare"), text.quoted("text").alias("quoted"),
    )


@_query("""
SELECT l_orderkey, l_linenumber, ((c >> 16) & 255) / 255.0::DOUBLE AS r, ((c >> 8) & 255) / 255.0::DOUBLE AS g, (c & 255) / 255.0::DOUBLE AS b, c AS back
FROM (SELECT *, (l_orderkey * 31 + l_linenumber) % 16777216 AS c FROM lineitem)
""")
def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer colours split into components and put together again."""
    rows = derive.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_orderkey") * 31 + F.col("l_linenumber")) % 16777216).alias("c"))
    rows = rows.withColumn("v", text.rgb("c"))
    return rows.select("l_orderkey", "l_linenumber", "v.r", "v.g", "v.b", text.rgb_int(F.col("v.r"), F.col("v.g"), F.col("v.b")).cast("long").alias("back"))


@_query("""SELECT page_id, coalesce(array_to_string(regexp_extract_all(html, '(?s)<li[^>]*>(.*?)</li>', 1), '|'), '') AS cells FROM pages""")
def html_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of a kind of HTML elements joined by bars (the pages hold list items instead of table cells)."""
    html = F.replace(F.replace("html", F.lit("<li"), F.lit("<td")), F.lit("</li>"), F.lit("</td>"))
    return derive.table(spark, sf_dir, "pages").select("page_id", text.html_cells(html).alias("cells"))


# ---- votes


_HOLDERS = f"""
{derive.LINES_SQL},
b AS (SELECT doc_id, page, ordinal, 'text' AS type, text FROM lines WHERE trim(text) <> ''),
e AS (SELECT *, min(ordinal) OVER w AS lo, max(ordinal) OVER w AS hi, {_CLEAN.format("text")} AS v FROM b WINDOW w AS (PARTITION BY doc_id, page)),
hc AS (SELECT doc_id, v, count(*) AS n, min(page) AS first_at FROM e WHERE ordinal = lo GROUP BY 1, 2),
fc AS (SELECT doc_id, v, count(*) AS n, min(page) AS first_at FROM e WHERE ordinal = hi GROUP BY 1, 2),
h AS (SELECT doc_id, v FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_at) AS r FROM hc) WHERE r = 1 AND n > 1 AND n > 0.5 * total),
f AS (SELECT doc_id, v FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_at) AS r FROM fc) WHERE r = 1 AND n > 1 AND n > 0.5 * total),
m AS (SELECT e.*, coalesce(ordinal = lo AND e.v = h.v, FALSE) AS is_header, coalesce(ordinal = hi AND e.v = f.v, FALSE) AS is_footer FROM e LEFT JOIN h USING (doc_id) LEFT JOIN f USING (doc_id))"""


def _text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.lines(spark, sf_dir).select("doc_id", "page", "ordinal", F.lit("text").alias("type"), "text")


@_query(f"WITH {_HOLDERS} SELECT doc_id, page AS page_num, row_number() OVER (PARTITION BY doc_id ORDER BY page, ordinal)::INTEGER AS block_no, type, text FROM m WHERE NOT is_header AND NOT is_footer")
def layout_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks without blank ones, running headers and footers."""
    return votes.layout_blocks(_text_blocks(spark, sf_dir))


@_query(f"WITH {_HOLDERS} SELECT doc_id, page, ordinal, is_header, is_footer FROM m WHERE is_header OR is_footer")
def running_holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks that are headers or footers by vote."""
    return votes.mark_holders(_text_blocks(spark, sf_dir).where(F.trim("text") != "")).where("is_header OR is_footer").select("doc_id", "page", "ordinal", "is_header", "is_footer")


@_query(f"""
WITH {derive.BOXES_SQL}, n AS (SELECT doc_id, count(DISTINCT page) AS n FROM boxes GROUP BY 1),
c AS (SELECT *, {_CLEAN.format("text")} AS v FROM boxes WHERE y1 < 90 AND page < 30),
p AS (SELECT a.doc_id, a.page, a.ordinal, count(DISTINCT b.page) AS hits, any_value(a.y1) AS y1 FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.v = b.v
  AND (a.page = b.page OR {_INTER.format(a="a", b="b")} > 0.7 * ({_AREA.format(a="a")} + {_AREA.format(a="b")} - {_INTER.format(a="a", b="b")})) GROUP BY 1, 2, 3),
d AS (SELECT p.doc_id, max(y1) AS band FROM p JOIN n USING (doc_id) WHERE hits >= 2 AND hits >= 0.4 * n GROUP BY 1)
SELECT boxes.doc_id, page, ordinal, coalesce((y0 + y1) / 2 <= band, FALSE) AS is_header FROM boxes LEFT JOIN d USING (doc_id)
""")
def geometric_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers by repeated boxes."""
    return votes.geometric_headers(derive.with_box(derive.boxes(spark, sf_dir)), 90).select("doc_id", "page", "ordinal", "is_header")


@_query(f"""
WITH {derive.BOXES_SQL}, n AS (SELECT doc_id, count(DISTINCT page) AS n FROM boxes GROUP BY 1),
c AS (SELECT *, {_CLEAN.format("text")} AS v FROM boxes WHERE y0 > 0.8 * 120 - 10 AND page < 30),
p AS (SELECT a.doc_id, a.page, a.ordinal, count(DISTINCT b.page) AS hits, any_value(a.y0) AS y0 FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.v = b.v
  AND (a.page = b.page OR {_INTER.format(a="a", b="b")} > 0.7 * ({_AREA.format(a="a")} + {_AREA.format(a="b")} - {_INTER.format(a="a", b="b")})) GROUP BY 1, 2, 3),
d AS (SELECT p.doc_id, min(y0) AS band FROM p JOIN n USING (doc_id) WHERE hits >= 2 AND hits >= 0.4 * n GROUP BY 1)
SELECT boxes.doc_id, page, ordinal, coalesce(y0 >= band, FALSE) AS is_footer FROM boxes LEFT JOIN d USING (doc_id)
""")
def geometric_footers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footers by repeated boxes."""
    return votes.geometric_footers(derive.with_box(derive.boxes(spark, sf_dir)), 120).select("doc_id", "page", "ordinal", "is_footer")


_FONTS = "CASE length(text) % 3 WHEN 0 THEN 'Serif' WHEN 1 THEN 'Sans' ELSE 'Mono' END"


@_query(f"""
WITH {derive.LINES_SQL}, s AS (SELECT doc_id, page, ordinal AS span_no, {_FONTS} AS font, (10 + length(text) % 2)::DOUBLE AS size, length(text) % 5 <> 0 AS b FROM lines),
f AS (SELECT doc_id, page, font FROM (SELECT doc_id, page, font, row_number() OVER (PARTITION BY doc_id, page ORDER BY count(*) DESC, min(span_no)) AS r FROM s GROUP BY 1, 2, 3) WHERE r = 1),
z AS (SELECT doc_id, page, size FROM (SELECT doc_id, page, size, row_number() OVER (PARTITION BY doc_id, page ORDER BY count(*) DESC, min(span_no)) AS r FROM s GROUP BY 1, 2, 3) WHERE r = 1)
SELECT doc_id, page, font, size, bold FROM f JOIN z USING (doc_id, page) JOIN (SELECT doc_id, page, bool_and(b) AS bold FROM s GROUP BY 1, 2) USING (doc_id, page)
""")
def font_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Font, size and boldness of each page's lines."""
    n = F.length("text")
    spans = derive.lines(spark, sf_dir).select("doc_id", "page", F.col("ordinal").alias("span_no"), F.expr(_FONTS).alias("font"), (10 + n % 2).cast("double").alias("size"), F.when(n % 5 != 0, 16).otherwise(0).alias("flags"), F.lit(False).alias("pseudo_bold"))
    return votes.font_size_bold(spans, ["doc_id", "page"])


_GAP_LINES = "(72 + 14 * ordinal + CASE length(text) % 3 WHEN 0 THEN 5 WHEN 1 THEN -9 ELSE 0 END)::DOUBLE"


@_query(f"""
WITH {derive.LINES_SQL}, b AS (SELECT *, {_GAP_LINES} AS y0, {_GAP_LINES} + 8 AS y1 FROM lines),
g AS (SELECT *, lag(y0) OVER w AS p0, lag(y1) OVER w AS p1 FROM b WINDOW w AS (PARTITION BY doc_id, page ORDER BY ordinal)),
k AS (SELECT doc_id, page, ordinal, ceil(greatest(y0 - p1, 0))::BIGINT AS gap FROM g WHERE p0 IS NOT NULL AND NOT ((y0 + y1) / 2 < p1 AND (p0 + p1) / 2 < y1)),
v AS (SELECT doc_id, page, gap FROM (SELECT doc_id, page, gap, row_number() OVER (PARTITION BY doc_id, page ORDER BY count(*) DESC, min(ordinal)) AS r FROM k GROUP BY 1, 2, 3) WHERE r = 1)
SELECT doc_id, page, coalesce(gap, 0)::BIGINT AS gap FROM (SELECT DISTINCT doc_id, page FROM lines) LEFT JOIN v USING (doc_id, page)
""")
def line_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The common line gap of each page."""
    y = (72 + 14 * F.col("ordinal") + F.when(F.length("text") % 3 == 0, 5).when(F.length("text") % 3 == 1, -9).otherwise(0)).cast("double")
    rows = derive.lines(spark, sf_dir).select("doc_id", "page", "ordinal", geometry.box(F.lit(72.0), y, F.lit(300.0), y + 8).alias("box"))
    return votes.common_line_gap(rows, ["doc_id", "page"])


@_query(f"""
WITH {derive.LINES_SQL}, s AS (SELECT doc_id, page, ordinal, least(length(text) * 2, 500)::DOUBLE AS w, (10 + length(text) % 4)::DOUBLE AS y1 FROM lines),
p AS (SELECT DISTINCT doc_id, page FROM lines), f AS (SELECT doc_id, page, arg_min(y1, ordinal) AS e FROM s WHERE w > 400 GROUP BY 1, 2),
v AS (SELECT doc_id, page, coalesce(e + 5, 80.0) AS band FROM p LEFT JOIN f USING (doc_id, page)),
c AS (SELECT doc_id, band, count(*) AS n, min(page) AS first_at FROM v GROUP BY 1, 2)
SELECT doc_id, (CASE WHEN n >= 0.4 * total AND n >= 2 THEN band ELSE 0 END)::DOUBLE AS band FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_at) AS r FROM c) WHERE r = 1
""")
def header_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header zones by wide strokes."""
    rows = derive.lines(spark, sf_dir)
    y = (10 + F.length("text") % 4).cast("double")
    strokes = rows.select("doc_id", "page", "ordinal", F.lit(0.0).alias("x0"), (y - 2).alias("y0"), F.least(F.length("text") * 2, F.lit(500)).cast("double").alias("x1"), y.alias("y1"))
    pages = rows.select("doc_id", "page", F.lit(600.0).alias("width"), F.lit(800.0).alias("height")).distinct()
    return votes.band_heights(strokes, pages)


@_query(f"""
WITH {derive.BOXES_SQL}, n AS (SELECT doc_id, count(DISTINCT page) AS n FROM boxes GROUP BY 1),
f AS (SELECT doc_id, sum(length(text)) AS chars, sum((x1 - x0) * (y1 - y0)) AS used FROM boxes WHERE page = 0 GROUP BY 1)
SELECT doc_id, n >= 3 AND chars <= 200 AND 1 - used / 60000.0 > 0.5 AS is_cover FROM n JOIN f USING (doc_id)
""")
def cover_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cover pages."""
    return votes.cover_pages(derive.with_box(derive.boxes(spark, sf_dir)), 60000.0)


_TOC = "CASE WHEN line_no = 1 AND doc_id % 3 = 0 THEN '目 录' WHEN line_no BETWEEN 2 AND 2 + doc_id % 5 AND doc_id % 2 = 0 THEN 'Part ' || line_no || ' ............ ' || line_no ELSE 'a' || length(text) END"


@_query(f"""
WITH {derive.LINES_SQL}, l AS (SELECT doc_id, page, ordinal, line_no, {_TOC} AS t, max(page) OVER (PARTITION BY doc_id) + 1 AS n FROM lines),
r AS (SELECT *, regexp_matches(replace(t, ' ', ''), '\\.{{10,}}[0-9]+') AS hit FROM l WHERE page < greatest(3, n // 3)),
s AS (SELECT doc_id, count_if(hit) AS size FROM r GROUP BY 1)
SELECT doc_id, page, ordinal, t AS text, CASE WHEN hit THEN 'Part ' || line_no ELSE t END AS title FROM r JOIN s USING (doc_id) WHERE size >= 3 AND (hit OR (line_no = 1 AND t = '目 录'))
""")
def catalog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and titles of tables of contents."""
    rows = derive.lines(spark, sf_dir).select("doc_id", "page", "ordinal", F.expr(_TOC).alias("text"))
    return votes.catalog_rows(rows)


@_query(f"""
WITH {derive.LINES_SQL}, t AS (SELECT DISTINCT doc_id, replace(text, ' ', '') AS t FROM lines WHERE line_no % 7 = 0)
SELECT doc_id, line_no FROM lines SEMI JOIN t ON t.doc_id = lines.doc_id AND t.t = replace(lines.text, ' ', '')
""")
def catalog_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose text is a title of the document."""
    rows = derive.lines(spark, sf_dir)
    return votes.in_catalog(rows, rows.where("line_no % 7 = 0").select("doc_id", F.col("text").alias("title"))).select("doc_id", "line_no")


# ---- geometry


@_query(f"""
WITH {derive.BOXES_SQL}, p AS (SELECT *, lead(x0) OVER w AS a, lead(y0) OVER w AS b, lead(x1) OVER w AS c, lead(y1) OVER w AS d FROM boxes WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
q AS (SELECT *, greatest(0, least(x1, c) - greatest(x0, a)) * greatest(0, least(y1, d) - greatest(y0, b)) AS i, (x1 - x0) * (y1 - y0) AS s, (c - a) * (d - b) AS t FROM p WHERE a IS NOT NULL)
SELECT doc_id, line_no, i::DOUBLE AS shared, (a >= x0 AND b >= y0 AND c <= x1 AND d <= y1) AS holds, (x1 - x0) + (c - a) - (greatest(x1, c) - least(x0, a)) + 0.001 >= 0.5 * least(x1 - x0, c - a) AS in_column,
  (y0 + y1) / 2 < d AND (b + d) / 2 < y1 AS in_row, i > 0.7 * (s + t - i) AS same_place, CASE WHEN i <= 0 THEN 'none' WHEN i / (s + t - i) > 0.6 THEN 'match' ELSE 'small' END AS kind FROM q
""")
def box_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of neighbouring lines' boxes."""
    rows = derive.with_box(derive.boxes(spark, sf_dir)).withColumn("b", F.lead("box").over(Window.partitionBy("doc_id").orderBy("line_no"))).where("b IS NOT NULL")
    return rows.select("doc_id", "line_no", geometry.overlap("box", "b").alias("shared"), geometry.inside("box", "b").alias("holds"), geometry.in_column("box", "b", 0.5).alias("in_column"), geometry.in_row("box", "b").alias("in_row"), geometry.same_place("box", "b").alias("same_place"), geometry.iou_class("box", "b").alias("kind"))


@_query(f"""
WITH {derive.BOXES_SQL}
SELECT doc_id, page, ordinal, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, x0, x1, ordinal)::INTEGER AS read_no, row_number() OVER (PARTITION BY doc_id, page ORDER BY x0, y1, y0, ordinal)::INTEGER AS vertical_no FROM boxes
""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading order of boxes, for horizontal and vertical text."""
    rows = spatial.reading_order(derive.with_box(derive.boxes(spark, sf_dir)))
    return spatial.reading_order(rows.withColumnRenamed("read_no", "r"), vertical=True).select("doc_id", "page", "ordinal", F.col("r").alias("read_no"), F.col("read_no").alias("vertical_no"))


@_query(f"""
WITH {derive.BOXES_SQL}, m AS (SELECT *, max(y1) OVER (PARTITION BY doc_id, page ORDER BY y0, x0, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM boxes),
r AS (SELECT *, sum(CASE WHEN reach IS NULL OR y0 >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY y0, x0, ordinal ROWS UNBOUNDED PRECEDING)::INTEGER AS row_no FROM m)
SELECT doc_id, page, ordinal, row_no, row_number() OVER (PARTITION BY doc_id, page, row_no ORDER BY x0, ordinal)::INTEGER AS col_no FROM r
""")
def rows_and_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Physical rows of a page and places in them."""
    return spatial.rows_of(derive.with_box(derive.boxes(spark, sf_dir))).select("doc_id", "page", "ordinal", "row_no", "col_no")


@_query(f"""
WITH {derive.BOXES_SQL}, u AS (SELECT doc_id, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM boxes WHERE x1 > x0 AND y1 > y0 GROUP BY 1, 2),
p AS (SELECT DISTINCT doc_id, page FROM boxes UNION ALL SELECT DISTINCT doc_id, -1 FROM boxes)
SELECT doc_id, page, CASE WHEN x0 IS NULL THEN 72.0 ELSE least(round(greatest(x0, 0), 1), 72.0) END::DOUBLE AS "left", CASE WHEN x0 IS NULL THEN 72.0 ELSE least(round(greatest(520.25 - x1 - 1, 0), 1), 72.0) END::DOUBLE AS "right",
  CASE WHEN x0 IS NULL THEN 72.0 ELSE least(round(greatest(y0, 0) * 0.5, 1), 72.0) END::DOUBLE AS top, CASE WHEN x0 IS NULL THEN 72.0 ELSE least(round(greatest(180.5 - y1, 0) * 0.5, 1), 72.0) END::DOUBLE AS bottom FROM p LEFT JOIN u USING (doc_id, page)
""")
def page_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margins from the union of boxes; page -1 of each document is empty."""
    rows = derive.with_box(derive.boxes(spark, sf_dir))
    pages = rows.select("doc_id", "page").union(rows.select("doc_id", F.lit(-1)))
    return spatial.margins(rows, 520.25, 180.5, pages=pages)


@_query(f"""
WITH {derive.BOXES_SQL}, z AS (SELECT 60.0 AS x0, 70.0 AS y0, 250.0 AS x1, 105.0 AS y1)
SELECT doc_id, page, ordinal, coalesce(round(({_INTER.format(a="boxes", b="z")}) / nullif({_AREA.format(a="boxes")}, 0), 2) >= 0.5, FALSE) AS inside FROM boxes, z
""")
def zone_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes split by their share within a zone."""
    zone = geometry.box(F.lit(60.0), F.lit(70.0), F.lit(250.0), F.lit(105.0))
    return spatial.split_by_overlap(derive.with_box(derive.boxes(spark, sf_dir)), zone, 0.5).select("doc_id", "page", "ordinal", "inside")


@_query(f"""
WITH {derive.BOXES_SQL}, t AS (SELECT doc_id, page, o, 70.0 AS x0, 70.0 + 14 * o AS y0, 300.0 + 50 * o AS x1, 100.0 + 14 * o AS y1 FROM (SELECT DISTINCT doc_id, page FROM boxes), (SELECT unnest([0, 1]) AS o) UNION ALL SELECT DISTINCT doc_id, page, 2, 60.0, 60.0, 110.0, 160.0 FROM boxes),
h AS (SELECT b.doc_id, b.page, b.ordinal, min(t.o) AS container FROM boxes b JOIN t USING (doc_id, page) WHERE {_AREA.format(a="b")} > 0 AND round(({_INTER.format(a="b", b="t")}) / {_AREA.format(a="b")}, 2) >= 0.75 AND CASE WHEN t.x1 - t.x0 >= t.y1 - t.y0 THEN t.x1 - t.x0 + 1 >= b.x1 - b.x0 ELSE t.y1 - t.y0 + 1 >= b.y1 - b.y0 END GROUP BY 1, 2, 3)
SELECT boxes.doc_id, boxes.page, boxes.ordinal, coalesce(container, -1)::INTEGER AS container FROM boxes LEFT JOIN h USING (doc_id, page, ordinal)
""")
def table_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines assigned to the first table that covers them."""
    rows = derive.with_box(derive.boxes(spark, sf_dir))
    o = F.col("ordinal")
    zones = rows.select("doc_id", "page").distinct().withColumn("ordinal", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("box", geometry.box(F.lit(70.0), 70.0 + 14 * o, 300.0 + 50 * o, 100.0 + 14 * o))
    tall = zones.select("doc_id", "page").distinct().select("*", F.lit(2).alias("ordinal"), geometry.box(F.lit(60.0), F.lit(60.0), F.lit(110.0), F.lit(160.0)).alias("box"))
    zones = zones.unionByName(tall)
    return spatial.assign(rows, zones).select("doc_id", "page", "ordinal", F.coalesce("container", F.lit(-1)).alias("container"))


_CC = f"""
WITH RECURSIVE {derive.BOXES_SQL}, e AS (SELECT a.doc_id, a.page, a.ordinal AS i, b.ordinal AS j FROM boxes a JOIN boxes b USING (doc_id, page) WHERE least(a.x1, b.x1) - greatest(a.x0, b.x0) + 4 >= 0 AND least(a.y1, b.y1) - greatest(a.y0, b.y0) + 4 >= 0),
r AS (SELECT doc_id, page, ordinal AS i, ordinal AS j FROM boxes UNION SELECT r.doc_id, r.page, r.i, e.j FROM r JOIN e ON e.doc_id = r.doc_id AND e.page = r.page AND e.i = r.j)
SELECT doc_id, page, i AS ordinal, min(j)::INTEGER AS component FROM r GROUP BY 1, 2, 3
"""


@_query(_CC)
def box_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components of boxes that come within 4 points."""
    return spatial.components(derive.with_box(derive.boxes(spark, sf_dir)).select("doc_id", "page", "ordinal", "box"), 2.0, 2.0).select("doc_id", "page", "ordinal", "component")


@_query(f"""
WITH {derive.BOXES_SQL}, s AS (SELECT doc_id, page, ordinal, x0, y0, x1, y1, CASE WHEN ordinal % 2 = 0 THEN 'stroke' ELSE 'fill' END AS kind FROM boxes),
m AS (SELECT s.*, b.ordinal AS l, s.x0 >= b.x0 - 1 AND s.x1 <= b.x1 + 1 AS within, s.y1 - s.y0 <= b.y1 - b.y0 + 2 AS low FROM s JOIN boxes b USING (doc_id, page) WHERE s.y0 <= b.y1 AND s.y1 >= b.y0 AND s.x0 <= b.x1 AND s.x1 >= b.x0)
SELECT doc_id, page, ordinal, arg_min(CASE WHEN kind = 'stroke' THEN CASE WHEN within THEN 'underline_or_strike' ELSE 'border' END ELSE CASE WHEN low THEN 'highlight' ELSE 'shading' END END, l) AS meaning FROM m GROUP BY 1, 2, 3
""")
def shape_meanings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What strokes and fills mean next to text lines."""
    lines = derive.with_box(derive.boxes(spark, sf_dir)).select("doc_id", "page", "ordinal", "box")
    shapes = lines.withColumn("kind", F.when(F.col("ordinal") % 2 == 0, "stroke").otherwise("fill"))
    return spatial.shape_kinds(shapes, lines).where("meaning IS NOT NULL").select("doc_id", "page", "ordinal", "meaning")


# ---- relations


_KINDS = "CASE WHEN line_no % 5 = 2 THEN 'table' ELSE 'text' END"
_CAPTIONED = "CASE WHEN line_no % 5 = 3 THEN 'Table ' || (line_no // 5) || ' of ' || length(text) WHEN line_no % 7 = 1 THEN 'see Table ' || (line_no // 7) || ' there' ELSE 'plain' END"


def _captioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derive.lines(spark, sf_dir)
    return rows.select("doc_id", F.floor(F.col("line_no") / 10).cast("int").alias("page"), "line_no", (F.col("line_no") % 10).alias("ordinal"), F.expr(_KINDS).alias("type"), F.expr(_CAPTIONED.replace("//", "div")).alias("text"))


_CAPTION_SQL = f"""{derive.LINES_SQL}, b AS (SELECT doc_id, line_no // 10 AS page, line_no % 10 AS ordinal, {_KINDS} AS type, {_CAPTIONED} AS text FROM lines),
c AS (SELECT *, nullif(regexp_extract(text, '^Table [0-9|-]+'), '') AS tag FROM b),
w AS (SELECT *, lag(tag, 1) OVER w AS p1, lag(ordinal, 1) OVER w AS q1, lag(tag, 2) OVER w AS p2, lag(ordinal, 2) OVER w AS q2, lead(tag, 1) OVER w AS n1, lead(ordinal, 1) OVER w AS m1, lead(tag, 2) OVER w AS n2, lead(ordinal, 2) OVER w AS m2, min(ordinal) OVER (PARTITION BY doc_id, page) AS first FROM c WINDOW w AS (PARTITION BY doc_id, page ORDER BY ordinal)),
k AS (SELECT doc_id, page, ordinal, CASE WHEN q1 > first AND p1 IS NOT NULL THEN p1 WHEN q2 > first AND p2 IS NOT NULL THEN p2 WHEN n1 IS NOT NULL THEN n1 ELSE n2 END AS caption,
  CASE WHEN q1 > first AND p1 IS NOT NULL THEN q1 WHEN q2 > first AND p2 IS NOT NULL THEN q2 WHEN n1 IS NOT NULL THEN m1 WHEN n2 IS NOT NULL THEN m2 END AS caption_ordinal FROM w WHERE type = 'table')"""


@_query(f"WITH {_CAPTION_SQL} SELECT doc_id, page::INTEGER AS page, ordinal::INTEGER AS ordinal, caption, coalesce(caption_ordinal, -1)::INTEGER AS caption_ordinal FROM k")
def table_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The caption next to each table."""
    found = relations.captions(_captioned(spark, sf_dir), "table", text.table_caption("text"))
    return found.withColumn("caption_ordinal", F.coalesce("caption_ordinal", F.lit(-1)))


@_query(f"""
WITH {_CAPTION_SQL}, r AS (SELECT k.doc_id, k.page, k.ordinal, b.page AS rp, b.ordinal AS ro FROM k JOIN b USING (doc_id) WHERE b.type = 'text' AND contains(b.text, trim(caption)) AND NOT (b.page = k.page AND b.ordinal = caption_ordinal))
SELECT doc_id, page::INTEGER AS page, ordinal::INTEGER AS ordinal, min(rp * 10 + ro)::INTEGER // 10 AS ref_page, min(rp * 10 + ro)::INTEGER % 10 AS ref_ordinal FROM r GROUP BY 1, 2, 3
""")
def caption_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first text that names each table's caption."""
    rows = _captioned(spark, sf_dir)
    return relations.references(relations.captions(rows, "table", text.table_caption("text")), rows)


@_query(f"""
WITH {derive.LINES_SQL}, b AS (SELECT doc_id, page, ordinal, CASE WHEN line_no % 9 IN (3, 4) THEN 'table' ELSE 'text' END AS type, text, length(text) % 2 = 0 AS e, length(text) % 3 = 0 AS s FROM lines),
c AS (SELECT *, lag(page) OVER w AS pp, lag(type) OVER w AS pt, lag(e) OVER w AS pe FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY page, ordinal)),
d AS (SELECT *, sum(CASE WHEN page <> pp AND ((type = 'table' AND pt = 'table') OR (type = 'text' AND pt = 'text' AND NOT pe AND NOT s)) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY page, ordinal ROWS UNBOUNDED PRECEDING)::BIGINT AS chain FROM c)
SELECT doc_id, chain, min(page)::INTEGER AS page, arg_min(type, page * 4 + ordinal) AS type, count(*)::INTEGER AS n_parts, string_agg(text, '' ORDER BY page, ordinal) AS text FROM d GROUP BY 1, 2
""")
def continuation_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that go on over page ends, merged."""
    n = F.length("text")
    rows = derive.lines(spark, sf_dir).select("doc_id", "page", "ordinal", F.when((F.col("line_no") % 9).isin(3, 4), "table").otherwise("text").alias("type"), "text", (n % 2 == 0).alias("end_of_paragraph"), (n % 3 == 0).alias("start_of_paragraph"))
    return relations.merged_chains(relations.chains(rows))


@_query(f"""
WITH {derive.BOXES_SQL}, w AS (SELECT *, {_listed("text")[0]} IS NOT NULL AS tagged, lag(ordinal) OVER w AS po, lag(x0) OVER w AS px0, lag(x1) OVER w AS px1, max(x1) OVER (PARTITION BY doc_id, page) AS r, length(text) % 6 = 0 AS bold, lag(length(text) % 6 = 0) OVER w AS pb FROM boxes WINDOW w AS (PARTITION BY doc_id, page ORDER BY ordinal))
SELECT doc_id, page, ordinal, sum(CASE WHEN po IS NULL OR tagged OR x0 - px0 > 9 OR bold <> pb OR px1 < r - 12 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY ordinal ROWS UNBOUNDED PRECEDING)::BIGINT AS paragraph FROM w
""")
def paragraph_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of all lines by list tag, indent, boldness and short lines."""
    return _paragraphs(derive.boxes(spark, sf_dir))


def _paragraphs(boxes: DataFrame) -> DataFrame:
    rows = derive.with_box(boxes).select("doc_id", "page", "ordinal", "text", "box", F.lit(10.0).alias("size"), (F.length("text") % 6 == 0).alias("bold"))
    return relations.paragraphs(rows).select("doc_id", "page", "ordinal", "paragraph")


@_query(f"""
WITH {derive.LINES_SQL}, b AS (SELECT doc_id, page, ordinal, length(text) % 2 = 0 AS centred, CASE WHEN length(text) % 5 = 0 THEN 'image' ELSE 'text' END AS type, (length(text) % 3)::DOUBLE AS size, length(text) % 11 = 0 AS in_catalog, length(text) % 7 < 3 AS bold, CASE length(text) % 4 WHEN 0 THEN '' WHEN 1 THEN 'a' ELSE 'b' END AS font FROM lines),
n AS (SELECT *, lead(ordinal) OVER w AS no, lead(type) OVER w AS nt, lead(centred) OVER w AS nc, lead(size) OVER w AS ns, lead(bold) OVER w AS nb, lead(font) OVER w AS nf FROM b WINDOW w AS (PARTITION BY doc_id, page ORDER BY ordinal))
SELECT doc_id, page, ordinal, CASE WHEN no IS NULL OR type <> 'text' THEN FALSE WHEN in_catalog THEN TRUE WHEN nt <> 'text' OR NOT nc THEN centred
  ELSE centred AND ((ns <> 0 AND size <> 0 AND size <> ns) OR (bold AND NOT nb) OR (font <> '' AND nf <> '' AND font <> nf)) END AS is_title FROM n
""")
def title_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles by centring and change of font."""
    n = F.length("text")
    rows = derive.lines(spark, sf_dir).select("doc_id", "page", "ordinal", (n % 2 == 0).alias("centred"), F.when(n % 5 == 0, "image").otherwise("text").alias("type"), F.when(n % 4 == 0, "").when(n % 4 == 1, "a").otherwise("b").alias("font"), (n % 3).cast("double").alias("size"), (n % 7 < 3).alias("bold"), (n % 11 == 0).alias("in_catalog"))
    return relations.titles(rows).select("doc_id", "page", "ordinal", "is_title")


@_query(f"""
WITH {derive.BOXES_SQL}, a AS (SELECT doc_id, page, count(*) AS n, max(x0) - min(x0) AS dl, max(x1) - min(x1) AS dr, max(x0 + x1) - min(x0 + x1) AS dc, min(x0) AS l, max(x1) AS r FROM boxes GROUP BY 1, 2)
SELECT doc_id, page, CASE WHEN n = 1 THEN CASE WHEN abs(l + r - 72 - 500) <= 4 THEN 'center' WHEN l - 72 <= 500 - r THEN 'left' ELSE 'right' END WHEN dl <= 1 AND dr <= 1 AND n >= 3 THEN 'justify' WHEN dl <= 1 THEN 'left' WHEN dr <= 1 THEN 'right' WHEN dc <= 4 THEN 'center' ELSE 'none' END AS alignment FROM a
""")
def block_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of each page's lines."""
    return relations.alignment(derive.with_box(derive.boxes(spark, sf_dir)), 72.0, 500.0)


# ---- tables


_CELLS = """cells AS (SELECT n_regionkey::BIGINT AS doc_id, 0 AS sheet_no, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INTEGER AS row_index, n_nationkey, n_name FROM nation),
grid AS (SELECT doc_id, sheet_no, row_index, c AS col_index, CASE c WHEN 0 THEN n_nationkey::VARCHAR WHEN 1 THEN n_name ELSE NULL END AS value FROM cells, (SELECT unnest([0, 1, 2]) AS c)),
merges AS (SELECT doc_id, 0 AS sheet_no, 0 AS r0, 1 AS c0, 1 AS r1, 2 AS c1 FROM (SELECT DISTINCT doc_id FROM cells)),
shown AS (SELECT g.*, CASE WHEN g.row_index = 0 AND g.col_index = 1 THEN 2 ELSE 1 END AS span FROM grid g WHERE NOT (row_index <= 1 AND col_index >= 1 AND (row_index, col_index) <> (0, 1)))"""


def _cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nation = derive.table(spark, sf_dir, "nation")
    number = (F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1).cast("int")
    rows = nation.select(F.col("n_regionkey").cast("long").alias("doc_id"), F.lit(0).alias("sheet_no"), number.alias("row_index"), "n_nationkey", "n_name")
    c = F.col("col_index")
    grid = rows.withColumn("col_index", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("value", F.when(c == 0, F.col("n_nationkey").cast("string")).when(c == 1, F.col("n_name")))
    merges = rows.select("doc_id", "sheet_no").distinct().select("doc_id", "sheet_no", F.lit(0).alias("r0"), F.lit(1).alias("c0"), F.lit(1).alias("r1"), F.lit(2).alias("c1"))
    return grid.select("doc_id", "sheet_no", "row_index", "col_index", "value"), merges


@_query(f"""
WITH {_CELLS} SELECT doc_id, sheet_no, row_index, col_index, value, span > 1 AS is_merged_cell, span AS merged_width, span AS merged_height, col_index * 10 AS x0, row_index * 10 AS y0, (col_index + span) * 10 AS x1, (row_index + span) * 10 AS y1 FROM shown
""")
def sheet_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of sheets with merges resolved and boxes on a grid."""
    return tables.cell_boxes(tables.visible_cells(*_cells(spark, sf_dir)))


@_query(f"""WITH {_CELLS} SELECT doc_id, sheet_no, count(DISTINCT row_index) AS n_rows, count(*) AS n_cells, 0 AS x0, 0 AS y0, 30 AS x1, max(row_index + span)::INTEGER * 10 AS y1 FROM shown GROUP BY 1, 2""")
def sheet_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table for each sheet, its box around its cells."""
    return tables.sheet_tables(tables.cell_boxes(tables.visible_cells(*_cells(spark, sf_dir))))


@_query(f"""
WITH {_CELLS}, t AS (SELECT doc_id, row_index, string_agg('<td rowspan=''' || span || ''' colspan=''' || span || '''>' || coalesce(value, '') || '</td>', '' ORDER BY col_index) AS r FROM shown GROUP BY 1, 2)
SELECT doc_id, 0 AS sheet_no, '<table>' || string_agg('<tr>' || r || '</tr>', '' ORDER BY row_index) || '</table>' AS html FROM t GROUP BY 1
""")
def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets as HTML tables."""
    return tables.sheet_rows(tables.visible_cells(*_cells(spark, sf_dir))).select("doc_id", "sheet_no", text.html_table("rows").alias("html"))


@_query(f"""
WITH {_CELLS}, t AS (SELECT doc_id, row_index, string_agg(coalesce(value, 'None') || chr(9), '' ORDER BY col_index) || chr(10) AS r FROM grid GROUP BY 1, 2)
SELECT doc_id, 'Sheet: s' || chr(10) || string_agg(r, '' ORDER BY row_index) || chr(10) AS text FROM t GROUP BY 1
""")
def sheet_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets as plain text."""
    return tables.sheet_text(_cells(spark, sf_dir)[0].withColumn("sheet_name", F.lit("s")))


@_query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate + INTERVAL 3661 SECOND, '%Y-%m-%d %H:%M:%S') END AS shown FROM orders
""")
def sheet_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamps as sheets show them."""
    day = F.date_trunc("day", "o_orderdate")
    t = F.when(F.col("o_orderkey") % 2 == 0, day).otherwise(F.col("o_orderdate") + F.expr("INTERVAL 3661 SECONDS"))
    return derive.table(spark, sf_dir, "orders").select("o_orderkey", tables.date_text(t).alias("shown"))


@_query("""
SELECT s_suppkey AS table_id, r::INTEGER AS row, c::INTEGER AS col, (CASE WHEN r = 1 AND c = 2 THEN 0 ELSE 1 END)::BIGINT AS row_span, (CASE WHEN r = 1 AND c = 1 THEN 2 WHEN r = 1 AND c = 2 THEN 0 ELSE 1 END)::BIGINT AS col_span
FROM supplier, (SELECT unnest(range(1, 5)) AS r), (SELECT unnest(range(1, 4)) AS c) WHERE r <= 2 + s_suppkey % 3 AND c <= 2 + s_suppkey % 2
""")
def lattice_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells and spans of ruled tables: a grid for each supplier, the stroke between its first two cells missing."""
    s = derive.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("table_id"), (2 + F.col("s_suppkey") % 3).cast("int").alias("nr"), (2 + F.col("s_suppkey") % 2).cast("int").alias("nc"))
    rows = s.select("table_id", F.lit(True).alias("horizontal"), F.explode(F.sequence(F.lit(0), F.col("nr"))).alias("at"), F.lit(0).alias("low"), F.col("nc").alias("high"))
    cols = s.select("table_id", F.lit(False).alias("horizontal"), F.explode(F.sequence(F.lit(0), F.col("nc"))).alias("at"), F.lit(0).alias("low"), F.col("nr").alias("high"))
    cols = cols.withColumn("low", F.when(F.col("at") == 1, 1).otherwise(F.col("low")))
    return tables.lattice_spans(tables.lattice_cells(rows.unionByName(cols)))


# ---- trees


_PARENT = """p AS (SELECT *, last_value(CASE WHEN layout_type = 'Title' THEN ordinal END IGNORE NULLS) OVER w AS t, last_value(CASE WHEN layout_type = 'List' THEN ordinal END IGNORE NULLS) OVER w AS l FROM turns WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
n AS (SELECT doc_id, ordinal, layout_type, text, CASE layout_type WHEN 'Title' THEN NULL WHEN 'List' THEN t ELSE CASE WHEN l IS NOT NULL AND (t IS NULL OR t < l) THEN l ELSE t END END::INTEGER AS parent FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, parent ORDER BY ordinal) AS i FROM n),
tree AS (SELECT doc_id, ordinal, layout_type, text, parent, 1 AS level, i::VARCHAR AS order_num, lpad(i::VARCHAR, 6, '0') AS sort, CASE WHEN layout_type = 'Text' THEN 1 ELSE 0 END AS texts, 0 AS low FROM k WHERE parent IS NULL
  UNION ALL SELECT k.doc_id, k.ordinal, k.layout_type, k.text, k.parent, level + 1, order_num || '.' || k.i, sort || '.' || lpad(k.i::VARCHAR, 6, '0'), CASE WHEN k.layout_type = 'Text' THEN tree.texts + 1 ELSE 0 END, tree.texts FROM k JOIN tree ON tree.doc_id = k.doc_id AND tree.ordinal = k.parent)"""


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.stack_parents(derive.turns(spark, sf_dir), ["Title", "List", "Text"])


@_query(f"WITH RECURSIVE {derive.TURNS_SQL}, {_PARENT} SELECT doc_id, ordinal, coalesce(parent, -1) AS parent, order_num, level FROM tree")
def tree_order_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order numbers of conversation trees."""
    return tree.paths(_tree(spark, sf_dir)).select("doc_id", "ordinal", F.coalesce("parent", F.lit(-1)).alias("parent"), "order_num", "level")


@_query(f"""
WITH RECURSIVE {derive.TURNS_SQL}, {_PARENT}
SELECT doc_id, string_agg(CASE WHEN level <= 6 AND (layout_type = 'Title' OR (layout_type = 'List' AND low = 0)) THEN repeat('#', level) || ' ' || text ELSE text END || chr(10) || chr(10), '' ORDER BY sort) AS markdown FROM tree GROUP BY 1
""")
def tree_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation trees as Markdown."""
    return tree.markdown(_tree(spark, sf_dir))


@_query(f"""
WITH RECURSIVE {derive.TURNS_SQL}, {_PARENT}
SELECT a.doc_id, a.ordinal, a.order_num, sum(length(b.text))::BIGINT AS subtree_tokens FROM tree a JOIN tree b ON a.doc_id = b.doc_id AND (b.sort = a.sort OR starts_with(b.sort, a.sort || '.')) GROUP BY 1, 2, 3
""")
def tree_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token sums over subtrees (characters stand in for tokens)."""
    return tree.token_sums(_tree(spark, sf_dir).withColumn("tokens", F.length("text"))).select("doc_id", "ordinal", "order_num", "subtree_tokens")


@_query(f"""WITH RECURSIVE {derive.TURNS_SQL}, {_PARENT} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sort)::INTEGER AS no, order_num, layout_type, text FROM tree""")
def tree_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees as lists in pre-order."""
    return tree.flatten(_tree(spark, sf_dir))


_CAP_TYPES = "CASE turn % 4 WHEN 0 THEN 'Table' WHEN 1 THEN 'TableName' WHEN 2 THEN 'FigureName' ELSE 'List' END"


@_query(f"""
WITH t AS (SELECT conv_id AS doc_id, turn::INTEGER AS ordinal, {_CAP_TYPES} AS lt, text, length(text)::BIGINT AS tokens FROM conversations),
w AS (SELECT *, CASE lt WHEN 'List' THEN 'ListItem' ELSE lt END AS type, lag(lt) OVER w AS pt, lag(ordinal) OVER w AS po, lead(lt) OVER w AS nt, lead(ordinal) OVER w AS nx FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal)),
g AS (SELECT *, CASE WHEN lt = 'TableName' AND pt = 'Table' THEN po WHEN lt = 'TableName' AND nt = 'Table' THEN nx WHEN lt = 'FigureName' AND pt = 'Figure' THEN po WHEN lt = 'FigureName' AND nt = 'Figure' THEN nx END AS target FROM w),
m AS (SELECT doc_id, target AS ordinal, arg_max(text, ordinal) AS name, sum(tokens) AS more FROM g WHERE target IS NOT NULL GROUP BY 1, 2)
SELECT g.doc_id, g.ordinal, CASE WHEN type IN ('TableName', 'FigureName') THEN 'text' ELSE type END AS type, m.name, (g.tokens + coalesce(m.more, 0))::BIGINT AS tokens FROM g LEFT JOIN m USING (doc_id, ordinal) WHERE g.target IS NULL
""")
def caption_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions merged into the table or figure beside them."""
    rows = derive.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("ordinal"), F.lit(None).cast("int").alias("parent"), F.expr(_CAP_TYPES).alias("layout_type"), "text", F.length("text").cast("long").alias("tokens"))
    return tree.merge_captions(rows).select("doc_id", "ordinal", "type", "name", "tokens")


@_query()
def tree_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document trees by the stack rule over lines with list tags, sizes and tables."""
    tagged = F.when(F.col("line_no") % 6 == 1, F.concat(F.lit("1. "), F.col("text"))).when(F.col("line_no") % 6 == 3, F.concat(F.lit("（一）"), F.col("text"))).otherwise(F.col("text"))
    rows = derive.lines(spark, sf_dir).where("text <> ''").withColumn("text", tagged)
    none = F.lit(None)
    rows = rows.select("doc_id", F.col("line_no").alias("ordinal"), F.when(F.col("line_no") % 11 == 10, "table").otherwise("text").alias("type"), "text", text.list_type("text").alias("list_type"), F.when(F.col("line_no") == 0, 16.0).otherwise(10.0).alias("size"), (F.col("line_no") % 6 == 0).alias("bold"), (F.col("line_no") == 0).alias("is_title"), F.lit(False).alias("in_catalog"), F.lit(False).alias("has_link"), none.cast("int").alias("caption_ordinal"), none.cast("int").alias("ref_ordinal"))
    return tree.build(rows)


# ---- evaluation


_NODES = """labels_ AS (SELECT doc_id, ordinal, 'L' || ordinal AS order_num, -1 AS page_num, layout_type, text FROM turns),
parsed_ AS (SELECT doc_id, ordinal, 'P' || ordinal AS order_num, -1 AS page_num, CASE WHEN ordinal % 5 = 0 THEN 'Text' ELSE layout_type END AS layout_type, text FROM turns WHERE ordinal % 7 <> 3),
mapped AS (SELECT l.doc_id, l.order_num AS label, p.order_num AS parsed, p.ordinal AS no FROM labels_ l LEFT JOIN parsed_ p ON p.doc_id = l.doc_id AND (p.ordinal = l.ordinal OR (l.ordinal % 4 = 1 AND p.ordinal = l.ordinal + 1)))"""


def _nodes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    t = derive.turns(spark, sf_dir)
    o = F.col("ordinal")
    labels = t.select("doc_id", "ordinal", F.concat(F.lit("L"), o.cast("string")).alias("order_num"), F.lit(-1).alias("page_num"), "layout_type", "text")
    parsed = t.where("ordinal % 7 <> 3").select("doc_id", "ordinal", F.concat(F.lit("P"), o.cast("string")).alias("order_num"), F.lit(-1).alias("page_num"), F.when(o % 5 == 0, "Text").otherwise(F.col("layout_type")).alias("layout_type"), "text")
    near = labels.select("doc_id", o.alias("lo"), F.col("order_num").alias("label"), F.explode(F.when(o % 4 == 1, F.array(o, o + 1)).otherwise(F.array(o))).alias("ordinal"))
    hits = near.join(parsed.select("doc_id", "ordinal", F.col("order_num").alias("parsed")), ["doc_id", "ordinal"]).select("doc_id", "label", "parsed", F.col("ordinal").alias("no"))
    mapped = labels.select("doc_id", F.col("order_num").alias("label")).join(hits, ["doc_id", "label"], "left")
    return labels, parsed, mapped


_MATRIX = """per AS (SELECT m.doc_id, label, any_value(l.layout_type) AS lt, count(parsed) AS n, count_if(p.layout_type = l.layout_type) AS hits, arg_max(p.layout_type, no) AS last FROM mapped m JOIN labels_ l ON l.doc_id = m.doc_id AND l.order_num = m.label LEFT JOIN parsed_ p ON p.doc_id = m.doc_id AND p.order_num = m.parsed GROUP BY 1, 2),
flat AS (SELECT lt, CASE WHEN n = 0 THEN 'p_0' ELSE last END AS c, CASE WHEN n <= 1 THEN 1.0 ELSE hits / n END::DOUBLE AS w FROM per UNION ALL SELECT lt, 'p_N', 1 - hits / n FROM per WHERE n > 1)"""


@_query(f"""WITH {derive.TURNS_SQL}, {_NODES}, {_MATRIX} SELECT lt AS label_type, {", ".join(f"coalesce(sum(w) FILTER (WHERE c = '{c}'), 0)::DOUBLE AS " + '"' + c + '"' for c in [*evaluate.LABELS, "p_0", "p_N"])} FROM flat GROUP BY 1""")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of label types by parsed type."""
    labels, parsed, mapped = _nodes(spark, sf_dir)
    return evaluate.confusion(mapped, labels, parsed)


@_query(f"""
WITH {derive.TURNS_SQL}, {_NODES}, {_MATRIX}, s AS (SELECT lt, coalesce(sum(w) FILTER (WHERE c = lt), 0)::DOUBLE AS r, sum(w)::DOUBLE AS t FROM flat GROUP BY 1)
SELECT lt AS label_type, sum(r) AS "right", sum(t) AS total, sum(r) / sum(t) AS accuracy FROM s GROUP BY ROLLUP (lt)
""")
def label_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of each label type and over all."""
    labels, parsed, mapped = _nodes(spark, sf_dir)
    return evaluate.accuracies(evaluate.confusion(mapped, labels, parsed))


_ONE = "one AS (SELECT doc_id, label, any_value(parsed) AS parsed FROM mapped WHERE parsed IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1)"
_EDGES = "SELECT doc_id, order_num AS child, last_value(CASE WHEN layout_type = 'Title' THEN order_num END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent FROM"


@_query(f"""
WITH {derive.TURNS_SQL}, {_NODES}, {_ONE}, le AS ({_EDGES} labels_), pe AS ({_EDGES} parsed_)
SELECT e.doc_id, count(h.child) AS "right", count(*) AS total FROM le e LEFT JOIN one c ON c.doc_id = e.doc_id AND c.label = e.child LEFT JOIN one p ON p.doc_id = e.doc_id AND p.label = e.parent
LEFT JOIN pe h ON h.doc_id = e.doc_id AND h.child = c.parsed AND h.parent = p.parsed WHERE e.parent IS NOT NULL GROUP BY 1
""")
def structure_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label edges that the parser has too."""
    labels, parsed, mapped = _nodes(spark, sf_dir)
    return evaluate.structure_accuracy(mapped, evaluate.title_edges(labels), evaluate.title_edges(parsed))


@_query(f"WITH {derive.TURNS_SQL}, {_NODES}, {_ONE} SELECT doc_id, parsed, min(label) AS label FROM one GROUP BY 1, 2 HAVING count(*) = 1")
def reverse_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single matches turned round."""
    return evaluate.reverse_unique(_nodes(spark, sf_dir)[2])


def _recall(docs: DataFrame) -> DataFrame:
    t = docs.select(F.col("doc_id").alias("file"), "text")
    phrases = t.select("file", F.element_at(F.split("text", " "), 1).alias("phrase")).unionByName(t.where("file % 20 = 0").select("file", F.lit("zzqq").alias("phrase")))
    return evaluate.phrase_recall(phrases, t).select(F.coalesce("file", F.lit(-1)).alias("file"), F.col("found").cast("long").alias("found"), "phrases", "recall")


@_query("""
WITH t AS (SELECT doc_id AS f, text FROM documents WHERE text IS NOT NULL), ph AS (SELECT f, split_part(text, ' ', 1) AS p FROM t UNION ALL SELECT f, 'zzqq' FROM t WHERE f % 20 = 0),
h AS (SELECT f, p, contains(regexp_replace(text, '[^\\p{L}\\p{N}_]', '', 'g'), regexp_replace(p, '[^\\p{L}\\p{N}_]', '', 'g')) AS hit FROM ph JOIN t USING (f))
SELECT coalesce(f, -1) AS file, count_if(hit)::BIGINT AS found, count(*) AS phrases, count_if(hit) / count(*) AS recall FROM h GROUP BY ROLLUP (f)
""")
def phrase_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases found in recognised texts over the whole table, by file and over all."""
    return _recall(derive.table(spark, sf_dir, "documents").where("text IS NOT NULL"))


@_query()
def greedy_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy matches of labels to parsed nodes by text."""
    labels, parsed, _ = _nodes(spark, sf_dir)
    return evaluate.mapping(labels, parsed)


# ---- events


@_query("""
WITH e AS (SELECT *, (user_id % 60) * 500000 AS size, (event_id % 90)::INTEGER AS pages, ['pdf', 'docx', 'png', 'exe'][(event_id % 4 + 1)::INTEGER] AS ext FROM events)
SELECT event_id::VARCHAR AS id, CASE WHEN size > 20000000 OR pages > 5000 THEN 'reject' WHEN ext = 'png' THEN 'image' WHEN ext = 'docx' THEN 'document' WHEN size > 2000000 OR pages > 30 THEN 'long' ELSE 'short' END AS route, size AS bytes FROM e WHERE event_type = 'purchase' AND ext <> 'exe'
""")
def file_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File events parsed, filtered and routed."""
    e = derive.table(spark, sf_dir, "events")
    ext = F.element_at(F.array(*[F.lit(x) for x in ("pdf", "docx", "png", "exe")]), (F.col("event_id") % 4 + 1).cast("int"))
    data = F.struct(F.col("event_id").cast("string").alias("id"), (F.col("user_id") % 60 * 500000).alias("bytes"), F.unix_timestamp("ts").alias("created_at"), F.concat(F.lit("f."), ext).alias("filename"), F.lit("assistants").alias("purpose"), (F.col("event_id") % 90).cast("int").alias("pages"))
    value = F.to_json(F.struct(F.when(F.col("event_type") == "purchase", "file.created").otherwise("other").alias("event"), data.alias("data"), F.lit('{"user": "u"}').alias("metadata")))
    return events.accepted(e.select(value.alias("value"))).select("id", "route", "bytes")


from . import layout, pages  # noqa: E402,F401  (add their queries to those above)

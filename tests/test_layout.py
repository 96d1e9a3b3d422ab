"""Rows, stream lines, whole table blocks, whole parses and reports on small fixtures."""

import random

import pandas as pd
import pytest

from sparkleaf.operators import evaluate, spatial, tables
from sparkleaf.plans import parse

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
LINES = f"doc_id long, page int, ordinal int, box {BOX}, vertical boolean"


def box(x0, y0, x1, y1):
    return (float(x0), float(y0), float(x1), float(y1))


def stream(spark, rows, zones=()):
    lines = spark.createDataFrame([(1, 0, i, box(*b), v) for i, (b, v) in enumerate(rows)], LINES)
    shades = spark.createDataFrame([(1, 0, box(*b), c) for b, c in zones], f"doc_id long, page int, box {BOX}, color int")
    return {r["ordinal"]: r["table_no"] for r in spatial.stream_lines(lines, shades).collect()}


def test_stream_lines_of_columns_gaps_and_vertical_text(spark):
    two = lambda y: [((0, y, 40, y + 10), False), ((60, y, 90, y + 10), False)]
    assert stream(spark, [*two(0), ((0, 20, 90, 30), None), *two(40)]) == {0: 1, 1: 1, 3: 2, 4: 2}
    assert stream(spark, [*two(0), *two(60), *two(80)]) == {0: 1, 1: 1, 2: 1, 3: 1, 4: 2, 5: 2}  # a far row ends its table
    assert stream(spark, [((0, 0, 90, 10), True), ((0, 20, 90, 30), False)]) == {0: 1}
    assert stream(spark, []) == {}


def test_stream_lines_in_shadings(spark):
    rows = [((0, 0, 90, 10), False), ((0, 20, 90, 30), False)]
    assert stream(spark, rows, [((0, 0, 95, 12), 255), ((0, 18, 95, 32), 0xFFFFFF)]) == {0: 1}
    assert stream(spark, rows, [((0, 0, 95, 40), 255), ((0, 0, 95, 40), 9)]) == {0: 1, 1: 2}  # each row runs on, so ends the table before it


def test_neighbours_of_one_column_may_stand_apart(spark):
    wide = ((0, 0, 100, 30), False)  # joins both others into one column and one row of overlapping heights
    assert stream(spark, [((0, 0, 40, 10), False), ((60, 0, 100, 10), False), ((0, 8, 100, 40), False)]) == {0: 1, 1: 1, 2: 1}
    assert stream(spark, [wide, ((0, 28, 100, 60), False)]) == {}


def test_physical_rows_go_from_left_to_right(spark):
    rows = [(1, 0, i, box(*b), False) for i, b in enumerate([(50, 0, 90, 20), (0, 5, 40, 15), (0, 30, 10, 40), (0, 14, 9, 29)])]
    got = [(r["ordinal"], r["physical_row"], r["reading_pos"]) for r in spatial.physical_rows(spark.createDataFrame(rows, LINES)).orderBy("reading_pos").collect()]
    assert got == [(1, 1, 1), (0, 1, 2), (3, 2, 3), (2, 3, 4)]


def test_sections_of_lines_without_width(spark):
    rows = [(1, 0, 0, box(0, 0, 40, 30), False), (1, 0, 1, box(50, 0, 50, 30), False)]
    assert {(r["section"], r["column"]) for r in spatial.sections(spark.createDataFrame(rows, LINES)).collect()} == {(1, 1)}


def test_table_blocks_keep_swallowed_cells(spark):
    cells = spark.createDataFrame([(1, 1, c, 10.0 * c, 0.0, 10.0 * c + 10, 8.0) for c in (1, 2)], "table_id long, row int, col int, x0 double, y0 double, x1 double, y1 double")
    spans = spark.createDataFrame([(1, 1, 1, 1, 2), (1, 1, 2, 0, 0)], "table_id long, row int, col int, row_span long, col_span long")
    borders = spark.createDataFrame([(1, 1, 1, "left", 2.0, 5), (1, 1, 1, "top", 1.0, None)], "table_id long, row int, col int, side string, width double, color int")
    shades = spark.createDataFrame([(1, 1, 1, 0, 9)], "table_id long, row int, col int, fill int, color int")
    a, b = tables.table_blocks(cells, spans, borders, shades).orderBy("col").collect()
    assert (b["row_height"], b["cell"]) == (8.0, None)
    assert tuple(a["cell"]) == (1, 2, 10.0, 0.0, 30.0, 8.0, 9, [1.0, None, None, 2.0], [None, None, None, 5])


def test_parses_with_settings_of_one_call(spark):
    rows = [(1, "a.txt", bytearray(b"text")), (2, "b.csv", bytearray(b"x,y\n1,2\n")), (3, "c.docx", bytearray(b"broken")), (4, "d.bin", bytearray(b"?")), (5, "e.md", None)]
    named = spark.createDataFrame(rows, "doc_id long, name string, content binary")
    got = {(r["doc_id"], r["parse_type"], r["type"], r["text"], r["error"] is not None) for r in parse.parsed(named).collect()}
    assert got == {(1, "layout", "text", "text", False), (1, "dom", "Text", "text", False), (2, "layout", "text", "x,y\n1,2\n", False), (2, "dom", "Text", "x,y\n1,2\n", False), (3, "layout", None, None, True), (5, "layout", None, None, True), (5, "dom", "Text", "", False)}
    later = parse.Settings().but(start=1)
    assert {r["doc_id"] for r in parse.parsed(named, "layout", later).collect()} == {3, 5}  # pages from the second on; errors stay
    assert parse.Settings() == parse.Settings(0, None, ())
    with pytest.raises(ValueError, match="no such parse type"):
        parse.parsed(named, "other")


def test_report_of_bad_cases(spark):
    labels = spark.createDataFrame([(1, "1", "Title"), (1, "2", None), (2, "1", "x")], "doc_id long, order_num string, text string")
    mapped = spark.createDataFrame([(1, "1", "a", 0.9), (1, "2", None, 0.0), (2, "1", "b", 1.0)], "doc_id long, label string, parsed string, score double")
    edges = spark.createDataFrame([(1, "2", "1", False), (2, "1", "0", True)], "doc_id long, child string, parent string, found boolean")
    out = evaluate.report(evaluate.bad_cases(labels, mapped, edges)).collect()
    assert [tuple(r) for r in out] == [(1, 1, 1, "edge 2 under 1: Title | \nsplit 2: ")]


def test_matches_are_those_without_bounds():
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "", "中文", "alphabet"]

    def side(n):
        texts = ["".join(rng.choices(words, k=rng.randint(0, 6))) for _ in range(n)]
        return pd.DataFrame({"ordinal": range(n), "order_num": [str(i) for i in range(n)], "page_num": [rng.choice([-1, 0, 1]) for _ in range(n)], "clean": texts})

    for _ in range(40):
        a, b = side(8), side(9)
        free, expect = list(b.itertuples()), []
        for x in a.itertuples():
            found, score = [], 0.0
            for y in free:
                if -1 not in (x.page_num, y.page_num) and x.page_num != y.page_num:
                    continue
                ratio = round(evaluate.similarity(x.clean, y.clean), 2)
                if ratio >= 0.8:
                    found.append(y.order_num)
                    score = ratio
                    free.remove(y)
                    break
                if x.clean in y.clean or y.clean in x.clean:
                    found.append(y.order_num)
            expect += [(x.order_num, f, score, i) for i, f in enumerate(found)] or [(x.order_num, None, 0.0, 0)]
        assert evaluate._match(a, b, 0.8) == expect

"""Operators with state, trees, files and streams on hand-made rows."""

import io
import itertools
import json
import random
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from sparkleaf.functions import text as text_functions
from sparkleaf.operators import blocks as page_blocks
from sparkleaf.operators import charstyles, evaluate, relations, spatial, standard, tables, tree, votes
from sparkleaf.sources import adapters, files, sinks
from sparkleaf.streaming import events

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def blocks(spark, rows):
    schema = "doc_id long, ordinal int, type string, text string, list_type string, size double, bold boolean, is_title boolean, in_catalog boolean, has_link boolean, caption_ordinal int, ref_ordinal int"
    return spark.createDataFrame([(1, i, *r, *[None] * (10 - len(r))) for i, r in enumerate(rows)], schema)


def test_tree_build(spark):
    rows = [
        ("text", "Book", None, 20.0, True, True), ("text", "1. One", "11", 12.0, False), ("text", "body", None, 10.0, False), ("text", "2. Two", "11", 12.0, False),
        ("table", "", None, 10.0, False), ("text", "(a) x", "19", 10.0, False), ("text", "(b) y", "19", 10.0, False),
    ]
    got = {r["ordinal"]: (r["parent"], r["layout_type"]) for r in tree.build(blocks(spark, rows)).collect()}
    assert got == {0: (None, "Title"), 1: (0, "Title"), 2: (1, "Text"), 3: (0, "Title"), 4: (3, "Table"), 5: (3, "List"), 6: (3, "List")}


def test_tree_attaches_tables_to_their_reference(spark):
    rows = [("text", "As Table 1 shows, it grows and grows and grows", None, 10.0, False), ("text", "other words that are long enough to stay text", None, 10.0, False), ("text", "Table 1 Growth", None, 10.0, False), ("table", "", None, 10.0, False, None, None, None, 2, 0)]
    got = [(r["ordinal"], r["parent"]) for r in tree.build(blocks(spark, [rows[0], rows[1], rows[3][:8] + (3, 0), rows[2]])).orderBy("position").collect()]
    assert got == [(0, None), (1, None), (2, 0), (3, 0)]


def test_catalog_node_takes_leader_lines_only(spark):
    rows = [("text", "目 录", None, 12.0, True), ("text", "Part ..........3", "40", 10.0, False), ("text", "Part B", "40", 10.0, False), ("text", "plain", None, 10.0, False)]
    got = {r["ordinal"]: (r["parent"], r["is_catalog"]) for r in tree.build(blocks(spark, rows)).collect()}
    assert got == {0: (None, True), 1: (0, True), 2: (None, False), 3: (2, False)}


def test_markdown_and_numbers(spark):
    rows = [(1, 0, None, "Title", "A"), (1, 1, 0, "List", "b"), (1, 2, 0, "Text", "c"), (1, 3, 2, "List", "d"), (1, 4, None, "Table", "<table></table>"), (1, 5, 2, "Text", "e"), (1, 6, 5, "List", "f")]
    nodes = spark.createDataFrame(rows, "doc_id long, ordinal int, parent int, layout_type string, text string")
    assert tree.markdown(nodes).first()["markdown"] == "# A\n\n## b\n\nc\n\n- d\n\ne\n\n\t- f\n\n<table></table>\n\n"
    assert [(r["order_num"], r["text"]) for r in tree.flatten(nodes).orderBy("no").collect()] == [("1", "A"), ("1.1", "b"), ("1.2", "c"), ("1.2.1", "d"), ("1.2.2", "e"), ("1.2.2.1", "f"), ("2", "<table></table>")]
    sums = {r["order_num"]: r["subtree_tokens"] for r in tree.token_sums(nodes.withColumn("tokens", F.lit(1))).collect()}
    assert sums == {"1": 6, "1.1": 1, "1.2": 4, "1.2.1": 1, "1.2.2": 2, "1.2.2.1": 1, "2": 1}


def test_caption_merge(spark):
    rows = [(1, 0, None, "Table", "t", 5), (1, 1, None, "TableName", "n1", 2), (1, 2, None, "FigureName", "n2", 3), (1, 3, None, "Figure", "f", 4), (1, 4, None, "TableName", "n3", 1), (1, 5, 4, "Odd", "x", 1)]
    nodes = spark.createDataFrame(rows, "doc_id long, ordinal int, parent int, layout_type string, text string, tokens int")
    got = {r["ordinal"]: (r["type"], r["name"], r["tokens"]) for r in tree.merge_captions(nodes).collect()}
    assert got == {0: ("Table", "n1", 7), 3: ("Figure", "n2", 7), 4: ("text", None, 2), 5: ("Text", None, 1)}  # tokens of the whole subtree


def test_components_against_search(spark):
    rng = random.Random(3)
    rows = []
    for page, i in itertools.product(range(6), range(25)):
        x, y = rng.randint(0, 90), rng.randint(0, 90)
        rows.append((1, page, i, (float(x), float(y), float(x + rng.randint(1, 15)), float(y + rng.randint(1, 15)))))
    got = {(r["page"], r["ordinal"]): r["component"] for r in spatial.components(spark.createDataFrame(rows, f"doc_id long, page int, ordinal int, box {BOX}"), 1.0, 1.0).collect()}
    for page in range(6):
        own = [b for _, p, _, b in rows if p == page]
        near = lambda a, b: min(a[2], b[2]) - max(a[0], b[0]) + 2 >= 0 and min(a[3], b[3]) - max(a[1], b[1]) + 2 >= 0
        seen = {}
        for s in range(len(own)):
            if s not in seen:
                todo = [s]
                while todo:
                    i = todo.pop()
                    if i not in seen:
                        seen[i] = s
                        todo += [j for j in range(len(own)) if near(own[i], own[j])]
        assert {i: got[page, i] for i in range(len(own))} == seen


def test_overlaps_floats_and_shapes(spark):
    rows = [(1, 0, 0, "text", (0.0, 0.0, 10.0, 10.0), 1), (1, 0, 1, "text", (0.0, 0.0, 10.0, 9.5), 1), (1, 0, 2, "image", (20.0, 0.0, 60.0, 40.0), 2), (1, 0, 3, "text", (30.0, 10.0, 50.0, 30.0), 2), (1, 0, 4, "image", (100.0, 0.0, 120.0, 20.0), 3)]
    df = spark.createDataFrame(rows, f"doc_id long, page int, ordinal int, type string, box {BOX}, color int")
    assert [r["ordinal"] for r in spatial.drop_overlapped(df.where("ordinal < 2")).collect()] == [0]
    assert {r["ordinal"] for r in spatial.floating(df).where("floats").collect()} == {2}
    assert {(r["color"], r["n"], r["merged"]) for r in spatial.merge_shapes(df).collect()} == {(1, 2, True), (2, 2, True), (3, 1, False)}


def test_hidden_text_and_pseudo_bold(spark):
    b = spark.createDataFrame([(1, 0, 0), (1, 0, 1)], "doc_id long, page int, ordinal int")
    s = spark.createDataFrame([(1, 0, 0, "F", (0.0, 0.0, 10.0, 10.0)), (1, 0, 1, "F", (20.0, 0.0, 30.0, 10.0))], f"doc_id long, page int, block_no int, font string, box {BOX}")
    t = spark.createDataFrame([(1, 0, 0, 3, "x", "F", (0.0, 0.0, 10.0, 5.0)), (1, 0, 1, 0, "ab", "F", (0.0, 0.0, 1.0, 1.0)), (1, 0, 2, 1, "ab", "F", (0.0, 0.0, 1.0, 1.0)), (1, 0, 3, 0, "c", "F", (0.0, 0.0, 1.0, 1.0))], f"doc_id long, page int, ordinal int, type int, chars string, font string, box {BOX}")
    assert [r["ordinal"] for r in spatial.hidden_text(b, s, t).collect()] == [1]
    assert {(r["chars"], r["pseudo_bold"]) for r in spatial.pseudo_bold(t).collect()} == {("ab", True), ("c", False)}


def test_ties_go_to_the_first(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(["b", "a", "a", "b", None])], "k int, i int, v string")
    assert tuple(votes.most_common(df, ["k"], "v", F.col("i")).first()) == (1, "b", 2, 5)


def test_joined_words(spark):
    rows = [(1, 0, 1, 0, "exam-"), (1, 0, 1, 1, "ple text"), (1, 0, 1, 2, "goes on"), (1, 0, 1, 3, "结束")]
    df = spark.createDataFrame(rows, "doc_id long, page int, paragraph int, ordinal int, text string")
    assert relations.joined_words(df, hyphens=True).first()["text"] == "example text goes on结束"


def test_greedy_mapping(spark):
    schema = "doc_id long, ordinal int, order_num string, page_num int, layout_type string, text string"
    labels = spark.createDataFrame([(1, 0, "1", 0, "Text", "the quick brown fox"), (1, 1, "2", 0, "Text", "jumps over"), (1, 2, "3", 1, "Text", "nothing like it"), (1, 3, "4", -1, "Text", "the quick brown fix")], schema)
    parsed = spark.createDataFrame([(1, 0, "a", 0, "Text", "the quick"), (1, 1, "b", 0, "Text", "the quick brown fox"), (1, 2, "c", 0, "Text", "he jumps over it all"), (1, 3, "d", 3, "Text", "nothing like it")], schema)
    rows = evaluate.mapping(labels, parsed).orderBy("label", "no").collect()
    assert [(r["label"], r["parsed"], r["score"]) for r in rows] == [("1", "a", 1.0), ("1", "b", 1.0), ("2", "c", 0.0), ("3", None, 0.0), ("4", "a", 0.0)]
    assert tuple(evaluate.block_scores(evaluate.mapping(labels, parsed)).where("doc_id IS NULL").first())[1:] == (0.25, 1, 4)


def test_box_mapping_and_filled_boxes(spark):
    schema = f"doc_id long, ordinal int, order_num string, page_num int, text string, box {BOX}"
    labels = spark.createDataFrame([(1, 0, "1", 0, "a", (0.0, 0.0, 10.0, 10.0))], schema)
    parsed = spark.createDataFrame([(1, 0, "x", 0, "a", (0.0, 0.0, 3.0, 3.0)), (1, 1, "y", 0, "b", (0.0, 0.0, 10.0, 9.0)), (1, 2, "z", 0, "c", (0.0, 0.0, 10.0, 10.0))], schema)
    assert [(r["parsed"], r["kind"]) for r in evaluate.box_mapping(labels, parsed).orderBy("parsed").collect()] == [("x", "small"), ("y", "match")]
    mapped = spark.createDataFrame([(1, "1", "y")], "doc_id long, label string, parsed string")
    assert evaluate.filled_boxes(labels, mapped, parsed).first()["differs"]


def xlsx_bytes():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", "<workbook><sheets><sheet name='S1'/></sheets></workbook>")
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>head</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", "<worksheet><sheetData><row r='1'><c r='A1' t='s'><v>0</v></c><c r='B1'/></row><row r='2'><c r='A2'><v>3.5</v></c><c r='AA2' t='inlineStr'><is><t>in</t></is></c></row></sheetData><mergeCells><mergeCell ref='A1:B1'/></mergeCells></worksheet>")
    return out.getvalue()


def test_office_decoders(spark):
    docx, pptx = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(docx, "w") as z:
        z.writestr("word/document.xml", "<w:document xmlns:w='w'><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc/></w:tr></w:tbl></w:body></w:document>")
    with zipfile.ZipFile(pptx, "w") as z:
        z.writestr("ppt/slides/slide1.xml", "<p:sld xmlns:p='p'><p:sp><p:p><p:t>one</p:t></p:p></p:sp><p:pic/></p:sld>")
    of = lambda b: spark.createDataFrame([(1, bytearray(b)), (2, bytearray(b"broken")), (3, None)], "doc_id long, content binary")
    assert [(r["type"], r["text"]) for r in files.docx(of(docx.getvalue())).where("doc_id = 1").collect()] == [("text", "Hello"), ("table", " | a | ")]
    assert [(r["type"], r["text"]) for r in files.pptx(of(pptx.getvalue())).where("doc_id = 1").collect()] == [("text", "one"), ("image", None)]
    assert files.docx(of(docx.getvalue())).where("error IS NOT NULL").count() == 2
    cells, merges = files.xlsx(of(xlsx_bytes()))
    assert sorted((r["row_index"], r["col_index"], r["value"] or "") for r in cells.collect()) == [(0, 0, "head"), (0, 1, ""), (1, 0, "3.5"), (1, 26, "in")]
    shown = tables.visible_cells(cells, merges)
    assert sorted((r["row_index"], r["col_index"], r["merged_width"]) for r in shown.collect()) == [(0, 0, 2), (1, 0, 1), (1, 26, 1)]
    assert tables.sheet_text(cells).first()["text"] == "Sheet: S1\nhead\tNone\t\n3.5\tin\t\n\n"


def test_text_decoders(spark):
    df = spark.createDataFrame([(1, bytearray("héllo".encode())), (2, bytearray("中文".encode("gbk"))), (3, bytearray(b"\xff\xfe"))], "doc_id long, content binary")
    assert [r["text"] for r in files.text_blocks(df).orderBy("doc_id").collect()] == ["héllo", None, None]
    assert [r["text"] for r in files.tree_text(df).orderBy("doc_id").collect()][:2] == ["héllo", "中文"]
    assert files.markdown_nodes("# A\n\ntext\nmore\n- i\n| a | b |\n|---|\n\n```\ncode\n```\n![p](u)") == [(0, "Title", 1, "A"), (1, "Text", 0, "text\nmore"), (2, "List", 0, "- i"), (3, "Table", 0, "| a | b |\n|---|"), (4, "Code", 0, "code"), (5, "Figure", 0, "![p](u)")]


def test_raw_pages(spark, tmp_path):
    line = lambda t, d=(1.0, 0.0): {"wmode": 0, "dir": list(d), "bbox": [0, 0, 1, 1], "spans": [{"text": t}]}
    page = {"doc_id": 1, "page": 0, "blocks": [{"ordinal": 0, "type": 0, "bbox": [0.0, 50.0, 9.0, 60.0], "lines": [line("low"), line("x", (0.5, 0.5))]}, {"ordinal": 1, "type": 0, "bbox": [0.0, 5.0, 9.0, 9.0], "lines": [line("top "), line("two")]}, {"ordinal": 2, "type": 1, "bbox": [0.0, 20.0, 9.0, 30.0], "lines": []}, {"ordinal": 3, "type": 0, "bbox": [0.0, 1.0, 9.0, 2.0], "lines": [line(" ")]}]}
    (tmp_path / "p.json").write_text(json.dumps(page))
    got = files.page_blocks(files.raw_pages(spark, str(tmp_path))).orderBy("ordinal").collect()
    assert [(r["ordinal"], r["type"], r["text"]) for r in got] == [(0, "text", "top two"), (1, "image", None), (2, "text", "low")]


def test_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    assert sinks.not_cached(docs, sinks.cache_get(spark, path), ["layout"]).count() == 2
    sinks.cache_put(spark.createDataFrame([(1, "layout", "{}")], "doc_id long, parse_type string, result string"), path)
    assert [r["doc_id"] for r in sinks.not_cached(docs, sinks.cache_get(spark, path), ["layout"]).collect()] == [2]


def message(i, name="a.pdf", **more):
    data = {"id": f"f{i}", "bytes": 1000, "created_at": 1700000000 + i, "filename": name, "purpose": "assistants", "pages": 3} | more
    return json.dumps({"event": "file.created", "data": data, "metadata": json.dumps({"user": "u", "callbacks": ["c1", "c2"]})})


def test_event_stream(spark, tmp_path):
    lines = [message(1), message(1), message(2, "b.png"), message(3, "c.docx"), message(4, bytes=3_000_000), message(5, pages=31), message(6, bytes=25_000_000), message(7, pages=6000), message(8, "d.exe"), message(9, purpose="other"), "no json", json.dumps({"event": "file.created", "data": {"id": "x", "filename": "a.pdf", "purpose": "assistants"}, "metadata": "[1]"})]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "m.txt").write_text("\n".join(lines))
    stream = events.once(events.accepted(events.folder_source(spark, str(tmp_path / "in"))))
    query = events.run_routes(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    got = {r["id"]: r["route"] for r in spark.read.option("recursiveFileLookup", "false").parquet(str(tmp_path / "out")).collect()}
    assert got == {"f1": "short", "f2": "image", "f3": "document", "f4": "long", "f5": "long", "f6": "reject", "f7": "reject"}


def test_retries_status_progress(spark):
    failed = spark.createDataFrame([("a", 0), ("b", 2)], "id string, tries int")
    assert [(r["id"], r["tries"], r["next"]) for r in events.retries(failed).orderBy("id").collect()] == [("a", 1, "retry"), ("b", 3, "dead")]
    results = spark.createDataFrame([(1, None, None), (2, "x", None)], "doc_id long, layout string, dom string")
    assert [r["status"] for r in events.parse_status(results).orderBy("doc_id").collect()] == ["failed", "finished"]
    rows = spark.createDataFrame([(1, "finish", ["u", "v"])], "doc_id long, status string, callbacks array<string>")
    assert [(r["callback"], r["percent"]) for r in sinks.progress(rows).orderBy("callback").collect()] == [("u", 100), ("v", 100)]


def test_place_is_plain_python():
    page = pd.DataFrame([{"ordinal": 0, "type": "table", "text": "", "list_type": None, "size": None, "bold": None, "is_title": None, "in_catalog": None, "has_link": None, "caption_ordinal": None, "ref_ordinal": None}])
    assert tree.place(page)["parent"].isna().all()


def test_strokes_and_cells(spark):
    rows = [(1, True, 0.0, 0.0, 30.0), (1, True, 1.5, 0.0, 10.0), (1, True, 10.0, 0.0, 30.0), (1, False, 0.0, 0.0, 10.0), (1, False, 30.0, 0.0, 10.0)]
    strokes = spark.createDataFrame(rows, "table_id long, horizontal boolean, at double, low double, high double")
    got = sorted(tuple(r)[1:3] for r in tables.clustered_strokes(strokes).collect())
    assert got == [(False, 0.0), (False, 30.0), (True, 0.75), (True, 10.0)]
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 60.0, 10.0)], "table_id long, x0 double, y0 double, x1 double, y1 double")
    assert tables.outer_strokes(strokes, boxes).where("NOT horizontal").count() == 3
    cells = tables.lattice_cells(tables.clustered_strokes(strokes))
    lines = spark.createDataFrame([(1, 1, "b", (1.0, 2.0, 9.0, 5.0)), (1, 0, "a", (1.0, 1.0, 9.0, 2.0)), (1, 2, "out", (50.0, 1.0, 59.0, 2.0))], f"table_id long, ordinal int, text string, box {BOX}")
    texts = tables.cell_texts(cells, lines)
    assert [tuple(r) for r in texts.collect()] == [(1, 1, 1, "a\nb")]
    grid = tables.text_grid(texts.withColumn("nested", F.lit(False)), tables.lattice_spans(cells))
    assert grid.first()["grid"] == [["a\nb"]]


def test_adapters(spark):
    items = spark.createDataFrame([(1, 5, "Header", "A", 1, "p1", None), (1, 2, "NarrativeText", None, 1, "p0", "gone")], "doc_id long, ordinal int, kind string, text string, page int, id string, up string")
    got = adapters.flat_list(items, "text", "kind", "page", {"Header": "Title"}, page_base=1).orderBy("ordinal").collect()
    assert [(r["order_num"], r["page_num"], r["layout_type"], r["text"]) for r in got] == [("1", 0, "Text", ""), ("2", 0, "Title", "A")]
    assert {(r["child"], r["parent"]) for r in adapters.parent_edges(items, "id", "up").collect()} == {("p0", None), ("p1", None)}
    assert tuple(spark.range(1).select(adapters.corner_box(F.array(F.array(F.lit(1.0), F.lit(9.0)), F.array(F.lit(4.0), F.lit(2.0)))).alias("b")).first()["b"]) == (1.0, 2.0, 4.0, 9.0)
    assert adapters.from_markdown(spark.createDataFrame([(1, 0, "Odd", "x")], "doc_id long, ordinal int, layout_type string, text string")).first()["layout_type"] == "Text"


def test_styled_spans(spark):
    char = lambda i, c: (c, (10.0 * i, 0.0, 10.0 * i + 10, 12.0))
    spans = spark.createDataFrame([(1, 0, 0, 0, [char(i, c) for i, c in enumerate("abcdef")])], f"doc_id long, page int, line_no int, span_no int, chars array<struct<c:string,box:{BOX}>>")
    shapes = spark.createDataFrame([(1, 0, 0, (20.0, 11.0, 40.0, 12.0)), (1, 0, 1, (50.0, 0.0, 60.0, 12.0))], f"doc_id long, page int, ordinal int, box {BOX}")
    got = [(r["text"], r["style"]) for r in spatial.styled_spans(spans, shapes).orderBy("part").collect()]
    assert got == [("ab", None), ("cd", "underline"), ("e", None), ("f", "highlight")]

SPANS = f"doc_id long, page int, line_no int, span_no int, chars array<struct<c:string,box:{BOX}>>"


def plain_styles(chars, shapes):
    """Parts of one span, a character and a shape at a time."""
    least, most = (lambda *x: min([v for v in x if v is not None], default=None)), (lambda *x: max([v for v in x if v is not None], default=None))
    parts = []
    for ch in chars:
        c, box = ch or (None, None)
        style = None
        for _, z in sorted((s for s in shapes if s[0] is not None), key=lambda s: s[0]):
            z = z or (None,) * 4
            if box is None or None in box or not box[2] > box[0] or least(box[2], z[2]) - most(box[0], z[0]) < 0.5 * (box[2] - box[0]) or least(box[3], z[3]) < most(box[1], z[1]):
                continue
            height = box[3] - box[1]
            if None not in (z[1], z[3]):
                below = (z[1] + z[3]) / 2 - box[1]
                style = "highlight" if z[3] - z[1] >= 0.5 * height else "underline" if below > 0.75 * height else "strike" if below >= 0.25 * height else None
            break
        if not parts or parts[-1][0] != style:
            parts.append([style, ""])
        parts[-1][1] += c or ""
    return [tuple(p) for p in parts]


def test_styled_spans_against_plain_styles(spark):
    rng = random.Random(8)
    spans, shapes = [], []
    for page in range(20):
        for k in rng.sample(range(20), rng.randint(0, 8) if page else 0):
            x, y = rng.uniform(-5, 50), rng.uniform(0, 50)
            z = [x, y, x + rng.uniform(0, 40), y + rng.choice([0.5, 2, 9, 12])]
            if rng.random() < 0.15:
                z[rng.randrange(4)] = None
            shapes.append((1, page, rng.choice([k, k, k, None]), tuple(z) if rng.random() < 0.95 else None))
        for line in range(5):
            x, chars = 0.0, []
            for _ in range(rng.choice([0, 1, 30, 40])):
                w = rng.choice([5.0, 0.1, 3.3, 0.0]) if line % 2 else 2.0
                c = rng.choice(["a", "é", "日", "😀", "ﬁ", " ", *(["fi", "", None] if line > 2 else [])])
                box = (x, 12.0 * line, x + w, 12.0 * line + 10) if line < 4 or rng.random() < 0.8 else rng.choice([None, (x, None, x + w, 9.0)])
                chars.append((c, box) if line < 4 or rng.random() < 0.9 else None)
                x += w
            spans.append((1, page, line, 0, chars if chars or line else None))
    spans += [(None, 1, 0, 0, [("n", (0.0, 0.0, 9.0, 9.0))]), (2, 0, 0, 0, [(None, None)]), (2, 0, 1, 0, [("", (0.0, 0.0, 1.0, 1.0))] * 2)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = spatial.styled_spans(spark.createDataFrame(spans, SPANS), spark.createDataFrame(shapes, f"doc_id long, page int, ordinal int, box {BOX}")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {}
    for r in sorted(found, key=lambda r: r["part"]):
        parts = got.setdefault((r["doc_id"], r["page"], r["line_no"]), [])
        assert r["part"] == len(parts) + 1
        parts.append((r["style"], r["text"]))
    assert got == {s[:3]: plain_styles(s[4], [z[2:] for z in shapes if z[:2] == s[:2]]) for s in spans if s[4]}
    assert len({style for parts in got.values() for style, _ in parts}) == 4


def test_styled_spans_pack_characters(spark):
    """A row for each character went through four exchanges, with its box; now a span is one row of about its text's size."""
    spans = spark.createDataFrame([(1, 0, 0, 0, [("x", (72.0 + 2 * i, 72.0, 74.0 + 2 * i, 84.0)) for i in range(1000)])], SPANS)
    shapes = spark.createDataFrame([(1, 0, 0, (82.0, 83.0, 102.0, 84.0))], f"doc_id long, page int, ordinal int, box {BOX}")
    rows = spatial.styled_spans(spans, shapes)
    assert "explode" not in rows._jdf.queryExecution().analyzed().toString()
    assert [(r["style"], len(r["text"])) for r in rows.orderBy("part").collect()] == [(None, 5), ("underline", 10), (None, 985)]
    packed = next(charstyles.packed(iter(spans.toArrow().to_batches())))
    assert packed.column("ends").null_count == 1 and len(packed.column("boxes")[0].as_py()) < 500


def test_sections(spark):
    rows = [(1, 0, 0, (0.0, 0.0, 100.0, 10.0))]
    for i in range(3):
        rows += [(1, 0, 1 + 2 * i, (0.0, 12.0 * i + 12, 48.0, 12.0 * i + 22)), (1, 0, 2 + 2 * i, (52.0, 12.0 * i + 12, 100.0, 12.0 * i + 22))]
    rows += [(1, 0, 9, (0.0, 60.0, 90.0, 70.0)), (2, 0, 0, (0.0, 0.0, 45.0, 10.0)), (2, 0, 1, (50.0, 0.0, 100.0, 10.0))]
    got = {(r["doc_id"], r["ordinal"]): (r["section"], r["column"]) for r in spatial.sections(spark.createDataFrame(rows, f"doc_id long, page int, ordinal int, box {BOX}")).collect()}
    assert got == {(1, 0): (1, 1), **{(1, i): (2, 2 - i % 2) for i in range(1, 7)}, (1, 9): (3, 1), (2, 0): (1, 1), (2, 1): (1, 1)}


def test_nodes_below_a_merged_caption_go(spark):
    rows = [(1, 0, None, "Table", "t", 5), (1, 1, None, "TableName", "n", 2), (1, 2, 1, "Text", "a", 3), (1, 3, 2, "Text", "b", 4), (2, 0, None, "Text", None, None)]
    nodes = spark.createDataFrame(rows, "doc_id long, ordinal int, parent int, layout_type string, text string, tokens int")
    got = {(r["doc_id"], r["ordinal"]): (r["type"], r["name"], r["tokens"]) for r in tree.merge_captions(nodes).collect()}
    assert got == {(1, 0): ("Table", "n", 14), (2, 0): ("Text", None, 0)}


def test_deep_trees_and_lost_nodes(spark):
    """A chain of 500 levels in each of 30 documents; nodes that hang on no root are left out."""
    rows = [(d, i, i - 1 if i else None, "Text", "x", 1) for d in range(30) for i in range(500)] + [(0, 900, 901, "Text", "lost", 1), (0, 901, 900, "Text", "lost", 1), (None, 0, None, "Title", "n", 1)]
    nodes = spark.createDataFrame(rows, "doc_id long, ordinal int, parent int, layout_type string, text string, tokens int")
    got = {(r["doc_id"], r["ordinal"]): r for r in tree.paths(nodes).collect()}
    assert len(got) == 30 * 500 + 1
    assert all(got[d, i]["path"] == [1] * (i + 1) and got[d, i]["level"] == i + 1 for d in (0, 17) for i in (0, 13, 499))
    sums = {(r["doc_id"], r["ordinal"]): r["subtree_tokens"] for r in tree.token_sums(nodes).collect()}
    assert sums[3, 0] == 500 and sums[3, 499] == 1
    assert tree.flatten(nodes).where("doc_id = 4").count() == 500 and tree.markdown(nodes).count() == 31
    assert tree.paths(nodes.limit(0)).count() == 0


def test_greedy_mapping_of_one_sided_documents(spark):
    node = "doc_id long, ordinal int, order_num string, page_num int, text string"
    labels = spark.createDataFrame([(1, 0, "1", -1, "alpha"), (2, 0, "1", -1, None)], node)
    parsed = spark.createDataFrame([(2, 0, "1", -1, "x"), (3, 0, "1", -1, "y")], node)
    got = sorted((r["doc_id"], r["label"], r["parsed"], r["score"]) for r in evaluate.mapping(labels, parsed).collect())
    assert got == [(1, "1", None, 0.0), (2, "1", "1", 0.0)]


def test_images_stay_and_blank_texts_go(spark):
    rows = [(1, 0, 0, "text", "h"), (1, 0, 1, "image", None), (1, 0, 2, "text", "\t\u3000"), (1, 0, 3, "text", "body"), (1, 0, 4, "text", "end")]
    got = votes.layout_blocks(spark.createDataFrame(rows, "doc_id long, page int, ordinal int, type string, text string")).collect()
    assert [(r["type"], r["text"]) for r in sorted(got, key=lambda r: r["block_no"])] == [("text", "h"), ("image", None), ("text", "body"), ("text", "end")]


def test_titles_by_rule(spark):
    cols = "doc_id long, page int, ordinal int, type string, centred boolean, in_catalog boolean, font string, size double, bold boolean"
    def titles(*blocks):
        rows = [(1, 0, i, *b) for i, b in enumerate(blocks)]
        return [r["is_title"] for r in sorted(relations.titles(spark.createDataFrame(rows, cols)).collect(), key=lambda r: r["ordinal"])]
    text_ = lambda c=True, cat=False, font="a", size=10.0, bold=False: ("text", c, cat, font, size, bold)
    image = ("image", True, True, None, None, None)
    assert titles(text_(), text_()) == [False, False]
    assert titles(text_(), text_(c=False)) == [True, False]
    assert titles(text_(bold=True), text_()) == [True, False] and titles(text_(), text_(bold=True)) == [False, False]
    assert titles(text_(size=0.0), text_()) == [False, False] and titles(text_(font=""), text_()) == [False, False]
    assert titles(image, text_(c=False)) == [False, False] and titles(text_(), image) == [True, False]
    assert titles(text_(c=False, cat=True), text_(cat=True)) == [True, False]


def page_lines(spark, *texts, gap=4, indent=None):
    rows = [(1, 0, i, "text", t, False, 72.0 + (indent or {}).get(i, 0), 72.0 + i * (10 + gap), 72.0 + (indent or {}).get(i, 0) + 5 * len(t), 82.0 + i * (10 + gap)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, page int, ordinal int, type string, text string, has_image boolean, x0 double, y0 double, x1 double, y1 double")


def block_numbers(df):
    return [r["block_no"] for r in sorted(page_blocks.joined(df).collect(), key=lambda r: (r["doc_id"], r["page"], r["ordinal"]))]


def test_lines_are_joined_to_blocks(spark):
    long = "words that fill the line from its left to its right"
    assert block_numbers(page_lines(spark, long, long, long)) == [1, 1, 1]
    assert block_numbers(page_lines(spark, "1. first item of a list of some length", "2. second item of that list, as long")) == [1, 2]
    assert block_numbers(page_lines(spark, "1. first item,", "   goes on here at length")) == [1, 1]
    first = page_lines(spark, long, "a table", long).withColumn("type", F.when(F.col("ordinal") == 1, "table").otherwise("text"))
    assert block_numbers(first) == [1, 2, 3]
    images = page_lines(spark, long, long, long).withColumn("has_image", F.col("ordinal") == 1)
    assert block_numbers(images) == [1, 2, 3]
    indented = page_lines(spark, long, long, long, long, indent={0: 20, 2: 20})
    assert block_numbers(indented) == [1, 1, 1, 1]  # alike gaps decide before indents
    apart = page_lines(spark, long, long).withColumns({c: F.col(c) + F.when(F.col("ordinal") == 1, 40.0).otherwise(0.0) for c in ("y0", "y1")})
    assert block_numbers(apart.unionByName(page_lines(spark, long, long, long).withColumn("page", F.lit(1)))) == [1, 1, 1, 1, 1]
    body = page_lines(spark, "centred title", long * 2, long * 2, long * 2)
    for title in ({"x0": 297.0, "x1": 357.0, "y0": 62.0, "y1": 72.0}, {"x0": 72.0, "x1": 132.0, "y0": 62.0, "y1": 72.0}):
        moved = body.withColumns({c: F.when(F.col("ordinal") == 0, v).otherwise(F.col(c)) for c, v in title.items()})
        assert block_numbers(moved) == [1, 2, 2, 2]  # centred before one that isn't, or farther off than lines usually are
    near = body.withColumns({c: F.when(F.col("ordinal") == 0, v).otherwise(F.col(c)) for c, v in {"x0": 297.0, "x1": 357.0}.items()})
    assert block_numbers(near) == [1, 1, 1, 1]  # in one group an indent decides
    assert page_blocks.joined(page_lines(spark, "x").limit(0)).count() == 0
    odd = page_lines(spark, "(an open", "bracket) closes").withColumn("text", F.when(F.col("ordinal") == 0, "(an open").otherwise(F.col("text")))
    assert block_numbers(odd) == [1, 1]
    got = page_blocks.block_texts(page_blocks.joined(page_lines(spark, long, long))).collect()
    assert [(r["n_lines"], r["text"], r["y1"]) for r in got] == [(2, f"{long}\n{long}", 96.0)]


def test_pages_of_one_document_are_joined_apart(spark):
    rng = random.Random(3)
    rows = []
    for page in range(40):
        y = 72.0
        for i in range(rng.randint(1, 30)):
            t = rng.choice(["1. item", "words here", "(open", "close)", "ends,", "a much longer line of words here"]) + "x" * rng.randint(0, 20)
            rows.append((page % 7, page, i, rng.choice(["text"] * 9 + ["table"]), t, rng.random() < 0.05, 72.0 + rng.choice([0, 0, 0, 20]), y, 72.0 + 5 * len(t), y + 10))
            y += 10 + rng.choice([0, 2, 2, 2, 9, 20, -10])
    names = ["doc_id", "page", "ordinal", "type", "text", "has_image", "x0", "y0", "x1", "y1"]
    df = spark.createDataFrame(rows, "doc_id long, page int, ordinal int, type string, text string, has_image boolean, x0 double, y0 double, x1 double, y1 double")
    got = {(r["doc_id"], r["page"], r["ordinal"]): r["block_no"] for r in page_blocks.joined(df).collect()}
    tags = {(r["doc_id"], r["page"], r["ordinal"]): r["t"] for r in df.select("doc_id", "page", "ordinal", text_functions.list_tag("text").alias("t")).collect()}
    for page in range(40):
        own = [dict(zip(names, r), list_tag=tags[r[:3]]) for r in rows if r[1] == page]
        assert [got[page % 7, page, r["ordinal"]] for r in own] == page_blocks.join_numbers(own)
        numbers = page_blocks.join_numbers(own)
        assert numbers[0] == 1 and all(b - a in (0, 1) for a, b in zip(numbers, numbers[1:]))
        assert all(numbers.count(n) == 1 for n, r in zip(numbers, own) if r["type"] == "table")


def test_standard_tree_of_tables_images_and_captions(spark):
    cells = [[("a", 0, 0, 0, 1)], [("b", 1, 1, 0, 0), (None, 1, 1, 1, 1)]]
    rows = [
        (1, 0, None, "Title", "Head line", 0, [0.0, 0.0, 9.0, 1.0], None, None, None),
        (1, 1, 0, "TableName", "Table 1 sizes", 0, [0.0, 1.0, 9.0, 2.0], None, None, None),
        (1, 2, 0, "Table", None, 0, [0.0, 2.0, 9.0, 5.0], None, None, cells),
        (1, 3, 0, "Figure", None, 1, [0.0, 0.0, 9.0, 5.0], "http://p/1.png", "seen words", None),
        (1, 4, 0, "FigureNote", "a note", 1, [0.0, 6.0, 9.0, 7.0], None, None, None),
        (1, 5, 0, "FigureName", "alone", 1, [0.0, 8.0, 9.0, 9.0], None, None, None),
        (1, 6, None, "Strange", None, 2, None, None, None, None),
    ]
    schema = f"doc_id long, ordinal int, parent int, layout_type string, text string, page_num int, bbox array<double>, image_link string, image_ocr_result string, rows {standard.CELLS}"
    nodes = standard.standard_nodes(spark.createDataFrame(rows, schema))
    got = {r["ordinal"]: r for r in nodes.collect()}
    assert {i: r["path"] for i, r in got.items()} == {0: [1], 2: [1, 1], 3: [1, 2], 4: [1, 3], 5: [1, 4], 6: [2]}
    assert [got[i]["element"]["type"] for i in (0, 2, 3, 4, 5, 6)] == ["Title", "Table", "Figure", "Text", "text", "Text"]
    table = got[2]["element"]
    assert table["name"] == "Table 1 sizes" and table["text"] is None and [p["bbox"][1] for p in table["positions"]] == [2.0, 1.0]
    assert [[(c["path"], c["text"], [n["text"] for n in c["nodes"]]) for c in r] for r in table["rows"]] == [[([0, 0, 0, 1], "a", ["a"])], [([1, 1, 0, 0], "b", ["b"]), ([1, 1, 1, 1], None, [None])]]
    assert got[3]["element"]["image"]["url"] == "http://p/1.png" and got[3]["element"]["text"] == "seen words" and got[3]["element"]["name"] == ""
    assert got[2]["tokens"] == 2 + 3 and got[0]["tokens"] == 2 + 3 + 2 + 2 + 2 + 1 and got[6]["tokens"] == 0
    out = standard.standard_documents(nodes).collect()
    assert [(r["doc_id"], r["tokens"], len(json.loads(r["json"]))) for r in out] == [(1, 12, 6)]


def test_bold_traces_are_assigned_to_spans(spark):
    spans = [(1, 0, 0, "bold words"), (1, 0, 1, "plain"), (1, 0, 2, "mixed up"), (1, 1, 0, "alone"), (2, 0, 0, "x")]
    traces = [(1, 0, 0, "bold ", True), (1, 0, 1, "words", True), (1, 0, 2, "plain", False), (1, 0, 3, "mixed", False), (1, 0, 4, " up", True), (2, 0, 0, "other", True)]
    got = page_blocks.assign_pseudo_bold(spark.createDataFrame(spans, "doc_id long, page int, ordinal int, text string"), spark.createDataFrame(traces, "doc_id long, page int, ordinal int, chars string, pseudo_bold boolean")).collect()
    assert {(r["doc_id"], r["page"], r["ordinal"]): r["pseudo_bold"] for r in got} == {(1, 0, 0): True, (1, 0, 1): False, (1, 0, 2): True, (1, 1, 0): False, (2, 0, 0): False}

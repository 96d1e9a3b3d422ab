"""The standard tree: nodes with positions, images and tables with cell paths as nested columns, captions merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tree

CELLS = "array<array<struct<text:string,start_row:int,end_row:int,start_col:int,end_col:int>>>"


def _own_text(kind: Column, rows: Column) -> Column:
    """What a node's tokens count: a figure's recognised text, all cells of a table, else the text."""
    cells = F.array_join(F.transform(F.flatten(rows), lambda c: F.coalesce(c["text"], F.lit(""))), " ")
    return F.coalesce(F.when(kind == "Figure", F.col("image_ocr_result")).when(kind == "Table", cells).otherwise(F.col("text")), F.lit(""))


def standard_nodes(nodes: DataFrame, count: Column | None = None) -> DataFrame:
    """(doc_id, ordinal, parent, path array<int>, tokens, element struct): the nodes of standard trees.

    nodes: (doc_id, ordinal, parent, layout_type, text, page_num, bbox array<double>), and optionally position, image_link,
    image_ocr_result, rows (CELLS). element: type, positions (bbox, page; those of merged captions after the own one), name, text
    (null for tables), image (type, url), rows of cells with path [start_row, end_row, start_col, end_col], text and one text
    node. Layout types are mapped, unknown ones to Text. Captions are merged into the sibling before, else after; paths are
    counted after that. tokens: of the whole subtree, by `count` (a Column over own_text; None: words and marks).
    """
    given = {c: (F.col(c) if c in nodes.columns else F.lit(None)) for c in ("position", "image_link", "image_ocr_result", "rows", "bbox", "page_num")}
    rows = nodes.select("doc_id", "ordinal", "parent", F.coalesce(given["position"].cast("long"), F.col("ordinal").cast("long")).alias("position"), "layout_type", "text", given["image_link"].cast("string").alias("image_link"), given["image_ocr_result"].cast("string").alias("image_ocr_result"), given["rows"].cast(CELLS).alias("rows"), given["bbox"].cast("array<double>").alias("bbox"), given["page_num"].cast("int").alias("page_num"))
    kinds = F.create_map(*[F.lit(x) for pair in tree.STANDARD_TYPES.items() for x in pair])
    kind = F.coalesce(kinds[F.col("layout_type")], F.lit("Text"))
    rows = rows.withColumn("own_text", _own_text(kind, F.col("rows")))
    rows = rows.withColumn("tokens", (tree.words_as_tokens("own_text") if count is None else count).cast("long"))
    merged = tree.merge_captions(rows.select("doc_id", "ordinal", "parent", "position", "layout_type", "text", "tokens"))
    own = rows.select("doc_id", "ordinal", F.struct("bbox", F.col("page_num").alias("page")).alias("here"), "image_link", "own_text", "rows", kind.alias("kind"))
    more = tree.caption_targets(rows).select("doc_id", F.col("target").alias("ordinal"), F.col("position").alias("p"), F.struct("bbox", F.col("page_num").alias("page")).alias("at"))
    more = more.groupBy("doc_id", "ordinal").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "at"))), lambda x: x["at"]).alias("captions"))
    found = tree.paths(merged).drop("order_num", "level").join(own, ["doc_id", "ordinal"]).join(more, ["doc_id", "ordinal"], "left")
    cell = lambda c: F.struct(F.array(c["start_row"], c["end_row"], c["start_col"], c["end_col"]).alias("path"), c["text"].alias("text"), F.array(F.struct(F.array(F.lit(1)).alias("path"), F.lit("Text").alias("type"), c["text"].alias("text"))).alias("nodes"))
    image = F.when((F.col("type") == "Figure") & (F.col("image_link") != ""), F.struct(F.lit("image_url").alias("type"), F.col("image_link").alias("url")))
    holder = F.col("type").isin("Figure", "Table")
    element = F.struct(
        F.col("type"),
        F.concat(F.array("here"), F.coalesce("captions", F.array().cast("array<struct<bbox:array<double>,page:int>>"))).alias("positions"),
        F.when(holder, F.coalesce("name", F.lit(""))).alias("name"),
        F.when(F.col("type") != "Table", F.col("own_text")).alias("text"),
        image.alias("image"),
        F.when(F.col("type") == "Table", F.transform("rows", lambda r: F.transform(r, cell))).alias("rows"),
    )
    return found.select("doc_id", "ordinal", "parent", "path", F.col("tokens"), element.alias("element"))


def standard_documents(nodes: DataFrame) -> DataFrame:
    """(doc_id, tokens, json): each document's standard nodes in pre-order as a JSON array; tokens: the sum over the top nodes."""
    rows = F.array_sort(F.collect_list(F.struct("path", "tokens", "element")))
    own = F.sum(F.when(F.col("parent").isNull(), F.col("tokens")))
    return nodes.groupBy("doc_id").agg(F.coalesce(own, F.lit(0)).alias("tokens"), F.to_json(rows).alias("json"))

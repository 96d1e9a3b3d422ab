"""Outputs of other engines as evaluation nodes: (doc_id, ordinal, order_num, page_num, layout_type, text, box)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def typed(kind, mapping: dict[str, str], default: str = "Text") -> Column:
    """A layout type by another engine's name for it."""
    kind = F.col(kind) if isinstance(kind, str) else kind
    return F.coalesce(F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])[kind], F.lit(default)) if mapping else F.lit(default)


def flat_list(items: DataFrame, text: str, kind: str, page: str | None, mapping: dict[str, str], page_base: int = 0, box: Column | None = None, order: str = "ordinal") -> DataFrame:
    """Nodes from a flat list of items, numbered in its order: the shape of most engines' JSON after an explode.

    page: the page column (None: any page, -1), counted from page_base. Null texts are empty.
    """
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy(order))
    where = F.lit(-1) if page is None else (F.col(page) - page_base).cast("int")
    return items.select("doc_id", (number - 1).alias("ordinal"), number.cast("string").alias("order_num"), where.alias("page_num"), typed(kind, mapping).alias("layout_type"), F.coalesce(F.col(text), F.lit("")).alias("text"), (F.lit(None).cast(_BOX) if box is None else box).alias("box"))


def corner_box(points) -> Column:
    """The box of a list of (x, y) points."""
    points = F.col(points) if isinstance(points, str) else points
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def parent_edges(items: DataFrame, own: str, parent: str) -> DataFrame:
    """(doc_id, child, parent) from an engine's own parent ids; parents that aren't among the items are null."""
    known = items.select("doc_id", F.col(own).alias("__p")).distinct().withColumn("__k", F.lit(True))
    rows = items.select("doc_id", F.col(own).alias("child"), F.col(parent).alias("__p")).join(known, ["doc_id", "__p"], "left")
    return rows.select("doc_id", "child", F.when(F.col("__k"), F.col("__p")).alias("parent"))


def tree_rows(nodes: DataFrame) -> DataFrame:
    """Evaluation nodes from a tree with order numbers, in pre-order: (doc_id, order_num, layout_type, text, page_num, path)."""
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("path"))
    return nodes.select("doc_id", (number - 1).alias("ordinal"), "order_num", "page_num", "layout_type", F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast(_BOX).alias("box"))


def from_markdown(nodes: DataFrame) -> DataFrame:
    """Evaluation nodes from Markdown nodes (doc_id, ordinal, layout_type, text); pages are unknown."""
    return flat_list(nodes, "text", "layout_type", None, {k: k for k in ("Title", "List", "Table", "Figure", "Code", "Text")})

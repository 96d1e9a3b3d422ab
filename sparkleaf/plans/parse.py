"""Whole parses: files to blocks and tree nodes in one plan, with settings that hold for one call."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import blocks
from ..sources import files

PARSE_TYPES = ("layout", "dom")
COLUMNS = ("doc_id", "file_md5", "parse_type", "page_num", "ordinal", "type", "text", "error")


@dataclass(frozen=True)
class Settings:
    """What one parse may set; a call never changes the defaults of the next."""

    start: int = 0
    end: int | None = None
    pages: tuple[int, ...] = ()

    def but(self, **changes) -> Settings:
        return replace(self, **changes)


def _blocks(found: DataFrame, type_column: str = "type", page: bool = True) -> DataFrame:
    """The decoder's rows under common names; ordinals count the rows of a page in the decoder's order."""
    order = Window.partitionBy("doc_id", "page_num").orderBy("__at")
    rows = found.withColumn("page_num", F.when(F.col("error").isNull(), F.col("page_num") if page else F.lit(0)))
    rows = rows.withColumn("__at", F.monotonically_increasing_id()).withColumn("ordinal", F.when(F.col("error").isNull(), F.row_number().over(order) - 1))
    return rows.select("doc_id", "page_num", "ordinal", F.when(F.col("error").isNull(), F.col(type_column)).alias("type"), "text", "error")


_LAYOUT = {"text": files.text_blocks, "csv": files.csv_blocks, "docx": files.docx, "pptx": files.pptx}


def parsed(named: DataFrame, parse_type: str = "all", settings: Settings | None = None) -> DataFrame:
    """(doc_id, file_md5, parse_type, page_num, ordinal, type, text, error): blocks (`layout`) and nodes (`dom`) of files.

    named: (doc_id, name, content), a file for each doc_id. Files go to a parser by their extension; those that none takes give no
    rows, damaged ones a row with an error. Pages outside the settings are left out. file_md5 identifies name, content and parse_type.
    """
    if parse_type not in (*PARSE_TYPES, "all"):
        raise ValueError(f"no such parse type: {parse_type}")
    settings = settings or Settings()
    kinds = PARSE_TYPES if parse_type == "all" else (parse_type,)
    parts = []
    if "layout" in kinds:
        of = named.withColumn("__parser", files.layout_parser("name"))
        parts += [_blocks(decode(of.where(F.col("__parser") == kind).drop("__parser"))).withColumn("parse_type", F.lit("layout")) for kind, decode in _LAYOUT.items()]
    if "dom" in kinds:
        texts = named.where(files.dom_parser("name") == "text")
        parts.append(_blocks(files.tree_text(texts), "layout_type", page=False).withColumn("parse_type", F.lit("dom")))
    rows = reduce(DataFrame.unionByName, parts)
    kept = blocks.selected_pages(rows.withColumn("page", F.coalesce("page_num", F.lit(settings.start))), settings.start, settings.end, list(settings.pages))
    rows = rows.where("page_num IS NULL").unionByName(kept.where("page_num IS NOT NULL").drop("page"))
    ids = named.select("doc_id", text.unified_md5("name", F.col("content"), F.lit(parse_type)).alias("file_md5"))
    return rows.join(ids, "doc_id").select(*COLUMNS)

"""Relations between blocks: captions, references, continuation over pages, paragraphs and titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def captions(blocks: DataFrame, kind: str, caption: Column, reach: int = 2) -> DataFrame:
    """(doc_id, page, ordinal, caption, caption_ordinal) of blocks of a type: the nearest caption up to two blocks away.

    Blocks before go first, nearer ones before farther ones; a page's first block is never taken as one before.
    """
    w = Window.partitionBy("doc_id", "page").orderBy("ordinal")
    first = F.min("ordinal").over(Window.partitionBy("doc_id", "page"))
    rows = blocks.withColumn("__tag", caption).withColumn("__first", first)
    before = [F.when(F.lag("ordinal", i).over(w) > F.col("__first"), F.struct(F.lag("__tag", i).over(w).alias("tag"), F.lag("ordinal", i).over(w).alias("at"))) for i in range(1, reach + 1)]
    after = [F.struct(F.lead("__tag", i).over(w).alias("tag"), F.lead("ordinal", i).over(w).alias("at")) for i in range(1, reach + 1)]
    found = F.coalesce(*[F.when(c["tag"].isNotNull(), c) for c in [*before, *after]])
    return rows.withColumn("__found", found).where(F.col("type") == kind).select("doc_id", "page", "ordinal", F.col("__found.tag").alias("caption"), F.col("__found.at").alias("caption_ordinal"))


def references(captioned: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, page, ordinal, ref_page, ref_ordinal): the first text block of the document that names the caption, itself aside."""
    texts = blocks.where("type = 'text'").select("doc_id", F.col("page").alias("ref_page"), F.col("ordinal").alias("ref_ordinal"), F.col("text").alias("__t"))
    met = captioned.where(F.col("caption").isNotNull()).join(texts, "doc_id").where(F.contains("__t", F.trim("caption")) & ~((F.col("ref_page") == F.col("page")) & (F.col("ref_ordinal") == F.col("caption_ordinal"))))
    return met.groupBy("doc_id", "page", "ordinal").agg(F.min(F.struct("ref_page", "ref_ordinal")).alias("r")).select("doc_id", "page", "ordinal", "r.*")


def chains(blocks: DataFrame) -> DataFrame:
    """All columns and chain: the number of the chain of blocks that go on over page ends, from 1 in each document.

    The last block of a page and the first of the next are one if both are tables, or both texts of which the first doesn't
    end a paragraph (end_of_paragraph) and the second doesn't start one (start_of_paragraph).
    """
    w = Window.partitionBy("doc_id").orderBy("page", "ordinal")
    before = lambda c: F.lag(c).over(w)
    over = F.col("page") != before("page")
    tables = (F.col("type") == "table") & (before("type") == "table")
    texts = (F.col("type") == "text") & (before("type") == "text") & ~before("end_of_paragraph") & ~F.col("start_of_paragraph")
    goes_on = F.coalesce(over & (tables | texts), F.lit(False))
    return blocks.withColumn("__new", F.when(goes_on, 0).otherwise(1)).withColumn("chain", F.sum("__new").over(w)).drop("__new")


def merged_chains(chained: DataFrame) -> DataFrame:
    """(doc_id, chain, page, type, n_parts, text): each chain as one block, its parts' texts in order."""
    parts = F.array_sort(F.collect_list(F.struct("page", "ordinal", "text")))
    out = chained.groupBy("doc_id", "chain").agg(parts.alias("p"), F.min_by("type", F.struct("page", "ordinal")).alias("type"))
    return out.select("doc_id", "chain", F.col("p")[0]["page"].alias("page"), "type", F.size("p").alias("n_parts"), F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))


def paragraphs(lines: DataFrame, char_width: float = 6.0) -> DataFrame:
    """All columns (doc_id, page, ordinal, text, box, size, bold) and paragraph from 1 within the page.

    A line starts a paragraph if it is the first, carries a list tag, is indented by more than 1.5 characters against
    the line before, or changes font size by more than 0.5 or boldness; the line before ends one if it stops more than two
    characters short of the page's widest line.
    """
    page = Window.partitionBy("doc_id", "page")
    w = page.orderBy("ordinal")
    right = F.max("box.x1").over(page)
    size_change = F.abs(F.col("size") - F.lag("size").over(w)) > 0.5
    short = F.lag("box.x1").over(w) < right - 2 * char_width
    start = F.lag("ordinal").over(w).isNull() | text.list_type("text").isNotNull() | (F.col("box.x0") - F.lag("box.x0").over(w) > 1.5 * char_width) | size_change | (F.col("bold") != F.lag("bold").over(w)) | short
    return lines.withColumn("__s", F.when(F.coalesce(start, F.lit(False)), 1).otherwise(0)).withColumn("paragraph", F.sum("__s").over(w)).drop("__s")


def joined_words(lines: DataFrame, hyphens: bool = False) -> DataFrame:
    """(doc_id, page, paragraph, text): lines joined, with a blank between Latin word or mark ends; hyphens before lower case may go."""
    w = Window.partitionBy("doc_id", "page", "paragraph").orderBy("ordinal")
    nxt = F.substring(F.lead("text").over(w), 1, 1)
    own = F.rtrim("text")
    blank = own.rlike(r"[A-Za-z0-9,.;:!?)]$") & nxt.rlike(r"[A-Za-z0-9(]")
    piece = F.when(blank, F.concat(own, F.lit(" "))).otherwise(F.col("text"))
    if hyphens:
        piece = F.when(own.rlike("[A-Za-z]-$") & nxt.rlike("[a-z]"), F.regexp_replace(own, "-$", "")).otherwise(piece)
    rows = lines.withColumn("__p", F.when(nxt.isNull(), F.col("text")).otherwise(piece))
    return rows.groupBy("doc_id", "page", "paragraph").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "__p"))), lambda x: x["__p"]), "").alias("text"))


def titles(blocks: DataFrame) -> DataFrame:
    """All columns and is_title, of text blocks that aren't the last of their page.

    A title is a catalog entry, or a centred block before one that isn't text, isn't centred, has another size or font (where both are
    known and not 0 or empty), or isn't bold where the block is. Needs type, centred, in_catalog, font, size, bold.
    """
    w = Window.partitionBy("doc_id", "page").orderBy("ordinal")
    nxt = lambda c: F.lead(c).over(w)
    other = lambda c, none: (F.col(c) != none) & (nxt(c) != none) & (F.col(c) != nxt(c))
    known = [F.coalesce(x, F.lit(False)) for x in (~nxt("centred"), other("size", F.lit(0)), other("font", F.lit("")), F.col("bold") & ~F.coalesce(nxt("bold"), F.lit(False)))]
    follows = (nxt("type") != "text") | known[0] | known[1] | known[2] | known[3]
    text_before = (F.col("type") == "text") & nxt("ordinal").isNotNull()
    return blocks.withColumn("is_title", F.coalesce(text_before & (F.coalesce("in_catalog", F.lit(False)) | (F.col("centred") & follows)), F.lit(False)))


def spacing(blocks: DataFrame) -> DataFrame:
    """All columns and before_space: the free height between a block and the one before it on the page, not below 0; the first: null."""
    w = Window.partitionBy("doc_id", "page").orderBy("ordinal")
    return blocks.withColumn("before_space", F.greatest(F.lit(0.0), F.col("box.y0") - F.lag("box.y1").over(w)))


def alignment(lines: DataFrame, left: float, right: float) -> DataFrame:
    """(doc_id, page, alignment): left, right, center or justify (3 rows or more) by tolerances of 1, 1 and 2 points; else none."""
    a = lines.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n"), (F.max("box.x0") - F.min("box.x0")).alias("dl"), (F.max("box.x1") - F.min("box.x1")).alias("dr"), (F.max(F.col("box.x0") + F.col("box.x1")) - F.min(F.col("box.x0") + F.col("box.x1"))).alias("dc"), F.min("box.x0").alias("l"), F.max("box.x1").alias("r"))
    one = F.when(F.abs(F.col("l") + F.col("r") - left - right) <= 4, "center").when(F.col("l") - left <= right - F.col("r"), "left").otherwise("right")
    many = F.when((F.col("dl") <= 1) & (F.col("dr") <= 1) & (F.col("n") >= 3), "justify").when(F.col("dl") <= 1, "left").when(F.col("dr") <= 1, "right").when(F.col("dc") <= 4, "center").otherwise("none")
    return a.select("doc_id", "page", F.when(F.col("n") == 1, one).otherwise(many).alias("alignment"))


def tab_stops(lines: DataFrame, least: float = 1.0) -> DataFrame:
    """(doc_id, page, stops): the distinct offsets of a block's lines from its left edge, sorted, from 1 point on."""
    w = Window.partitionBy("doc_id", "page")
    rows = lines.withColumn("__o", F.col("box.x0") - F.min("box.x0").over(w))
    return rows.groupBy("doc_id", "page").agg(F.sort_array(F.collect_set(F.when(F.col("__o") >= least, F.col("__o")))).alias("stops"))

"""Votes over the blocks of a document: running headers and footers, fonts, line gaps. Ties go to what comes first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, text


def most_common(df: DataFrame, keys: list[str], value: str, position: Column, out: str = "value") -> DataFrame:
    """(keys, out, n, total): the most frequent value of each group, ties to the one met first; nulls count as a value.

    Counts are pre-aggregated by (keys, value), so a hot group arrives as one row for each distinct value.
    """
    counts = df.groupBy(*keys, F.col(value).alias(out)).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("__at"))
    return counts.groupBy(*keys).agg(F.max_by(F.struct(out, "n"), F.struct(F.col("n"), -F.col("__at"))).alias("__v"), F.sum("n").alias("total")).select(*keys, F.col(f"__v.{out}").alias(out), F.col("__v.n").alias("n"), "total")


def edge_blocks(blocks: DataFrame, last: bool = False) -> DataFrame:
    """The first (last) block of each page."""
    pick = F.max_by if last else F.min_by
    rest = [c for c in blocks.columns if c not in ("doc_id", "page")]
    return blocks.groupBy("doc_id", "page").agg(pick(F.struct(*rest), F.col("ordinal")).alias("__b")).select("doc_id", "page", "__b.*")


def holder_values(blocks: DataFrame, last: bool, share: float = 0.5) -> DataFrame:
    """(doc_id, value): the cleaned text that the first (last) blocks of a document's pages share, if any does.

    Its share of the pages is above `share` and it is on two pages at least; a null winner marks nothing.
    """
    kind = F.when(F.col("type") == "image", F.lit("image")).otherwise(text.remove_number("text"))
    edge = edge_blocks(blocks, last).where(F.col("type").isin("image", "text")).select("doc_id", "page", kind.alias("value"))
    top = most_common(edge, ["doc_id"], "value", F.col("page"))
    return top.where((F.col("n") > share * F.col("total")) & (F.col("n") > 1) & F.col("value").isNotNull()).select("doc_id", "value")


def mark_holders(blocks: DataFrame, share: float = 0.5) -> DataFrame:
    """All columns of blocks (doc_id, page, ordinal, type, text), and is_header, is_footer booleans.

    A page's first (last) block is one if its cleaned text is the document's header (footer) value. Null texts never match.
    """
    w = Window.partitionBy("doc_id", "page")
    rows = blocks.withColumn("__first", F.min("ordinal").over(w)).withColumn("__last", F.max("ordinal").over(w))
    clean = F.when(F.col("type") == "image", F.lit("image")).otherwise(text.remove_number("text"))
    head = holder_values(blocks, False, share).withColumnRenamed("value", "__head")
    foot = holder_values(blocks, True, share).withColumnRenamed("value", "__foot")
    rows = rows.join(head, "doc_id", "left").join(foot, "doc_id", "left")
    is_head = (F.col("ordinal") == F.col("__first")) & (clean == F.col("__head"))
    is_foot = (F.col("ordinal") == F.col("__last")) & (clean == F.col("__foot"))
    return rows.select(*blocks.columns, F.coalesce(is_head, F.lit(False)).alias("is_header"), F.coalesce(is_foot, F.lit(False)).alias("is_footer"))


def layout_blocks(blocks: DataFrame) -> DataFrame:
    """The images and the blocks with more than white space that are neither header nor footer, numbered anew within the document."""
    live = mark_holders(blocks.where((F.col("type") == "image") | F.col("text").rlike(r"(?U)\S"))).where(~F.col("is_header") & ~F.col("is_footer"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "ordinal"))
    return live.select("doc_id", F.col("page").alias("page_num"), number.cast("int").alias("block_no"), "type", "text")


def band_heights(strokes: DataFrame, pages: DataFrame, share: float = 0.4, least: int = 2) -> DataFrame:
    """(doc_id, band): the likely height of a document's header zone, 0 if pages don't agree.

    A page votes for the lower edge of its first wide, thin stroke in the top quarter plus 5, else for a tenth of its height.
    """
    wide = strokes.join(pages, ["doc_id", "page"]).where((F.col("x1") - F.col("x0") > F.col("width") * 2 / 3) & (F.col("y1") - F.col("y0") < 3) & (F.col("y1") < F.col("height") / 4))
    first = wide.groupBy("doc_id", "page").agg(F.min_by("y1", "ordinal").alias("edge"))
    votes = pages.join(first, ["doc_id", "page"], "left").select("doc_id", "page", F.coalesce(F.col("edge") + 5, F.col("height") / 10).alias("band"))
    top = most_common(votes, ["doc_id"], "band", F.col("page"), "band")
    return top.select("doc_id", F.when((F.col("n") >= share * F.col("total")) & (F.col("n") >= least), F.col("band")).otherwise(F.lit(0.0)).alias("band"))


def repeated_boxes(candidates: DataFrame, page_counts: DataFrame, share: float = 0.4, least: int = 2, place: float = 0.7) -> DataFrame:
    """Candidates (doc_id, page, ordinal, text, box) with a partner in the same place on enough pages.

    Partners have equal cleaned text (null for images) and boxes that overlap by 0.7; page_counts: (doc_id, n_pages). The
    number of pages on which a partner is found, its own included, is a share of 0.4 of all and two at least.
    """
    rows = candidates.withColumn("__clean", F.coalesce(text.remove_number("text"), F.lit("\0image")))
    other = rows.select("doc_id", "__clean", F.col("page").alias("__page"), F.col("box").alias("__box"))
    met = rows.join(other, ["doc_id", "__clean"]).where((F.col("page") == F.col("__page")) | geometry.same_place("box", "__box", place))
    hits = met.groupBy("doc_id", "page", "ordinal").agg(F.count_distinct("__page").alias("hits")).join(page_counts, "doc_id")
    return candidates.join(hits.where((F.col("hits") >= share * F.col("n_pages")) & (F.col("hits") >= least)).select("doc_id", "page", "ordinal", "hits"), ["doc_id", "page", "ordinal"])


def geometric_headers(blocks: DataFrame, zone: float, first_pages: int = 30) -> DataFrame:
    """Blocks (doc_id, page, ordinal, text, box) with is_header: those above the lower edge of the confirmed header boxes."""
    pages = blocks.groupBy("doc_id").agg(F.count_distinct("page").alias("n_pages"))
    candidates = blocks.where((F.col("box.y1") < zone) & (F.col("page") < first_pages))
    band = repeated_boxes(candidates, pages).groupBy("doc_id").agg(F.max("box.y1").alias("__band"))
    middle = (F.col("box.y0") + F.col("box.y1")) / 2
    edge = F.when(F.col("text").isNull(), F.col("box.y0")).otherwise(middle)
    return blocks.join(band, "doc_id", "left").withColumn("is_header", F.coalesce(edge <= F.col("__band"), F.lit(False))).drop("__band")


def geometric_footers(blocks: DataFrame, height: float, first_pages: int = 30) -> DataFrame:
    """Blocks with is_footer: those below the upper edge of the confirmed footer boxes."""
    pages = blocks.groupBy("doc_id").agg(F.count_distinct("page").alias("n_pages"))
    candidates = blocks.where((F.col("box.y0") > 0.8 * height - 10) & (F.col("page") < first_pages))
    band = repeated_boxes(candidates, pages).groupBy("doc_id").agg(F.min("box.y0").alias("__band"))
    return blocks.join(band, "doc_id", "left").withColumn("is_footer", F.coalesce(F.col("box.y0") >= F.col("__band"), F.lit(False))).drop("__band")


def font_size_bold(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, font, size, bold): most frequent font and size of a line's spans, bold if all spans are by flag or by trace."""
    at = F.col("span_no")
    font = most_common(spans, keys, "font", at, "font").select(*keys, "font")
    size = most_common(spans, keys, "size", at, "size").select(*keys, "size")
    bold = spans.groupBy(*keys).agg((F.bool_and(F.col("flags").bitwiseAND(16) != 0) | F.bool_and(F.coalesce("pseudo_bold", F.lit(False)))).alias("bold"))
    return font.join(size, keys).join(bold, keys)


def common_line_gap(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, gap): the most frequent gap, not below 0 and rounded up, between neighbouring lines that aren't in one row.

    The first of equally frequent ones wins; without such lines it is 0.
    """
    w = Window.partitionBy(*keys).orderBy("ordinal")
    rows = lines.withColumn("__before", F.lag("box").over(w)).where(F.col("__before").isNotNull() & ~geometry.in_row("__before", "box"))
    gaps = rows.withColumn("gap", F.ceil(F.greatest(F.col("box.y0") - F.col("__before.y1"), F.lit(0.0))))
    found = most_common(gaps, keys, "gap", F.col("ordinal"), "gap").select(*keys, "gap")
    return lines.select(*keys).distinct().join(found, keys, "left").select(*keys, F.coalesce("gap", F.lit(0)).cast("long").alias("gap"))


def cover_pages(blocks: DataFrame, page_area: float, max_chars: int = 200, blank: float = 0.5, least_pages: int = 3) -> DataFrame:
    """(doc_id, is_cover): whether page 0 is a cover: a document of 3 pages or more, little text, more than half of the page blank."""
    pages = blocks.groupBy("doc_id").agg(F.count_distinct("page").alias("n"))
    first = blocks.where("page = 0").groupBy("doc_id").agg(F.sum(F.length("text")).alias("chars"), F.sum(geometry.area("box")).alias("used"))
    cover = (F.col("n") >= least_pages) & (F.coalesce("chars", F.lit(0)) <= max_chars) & (1 - F.coalesce("used", F.lit(0.0)) / page_area > blank)
    return pages.join(first, "doc_id", "left").select("doc_id", cover.alias("is_cover"))


def catalog_rows(lines: DataFrame, run: int = 3) -> DataFrame:
    """Lines (doc_id, page, ordinal, text) of the first table of contents in the first third of the pages, with its titles.

    A table of contents is the first unbroken run of three lines or more with leaders; a heading line right before it
    belongs to it. title: the text before the leader.
    """
    doc = Window.partitionBy("doc_id")
    at = doc.orderBy("page", "ordinal")
    rows = lines.withColumn("__pages", F.max("page").over(doc) + 1).where(F.col("page") < F.greatest(F.lit(3), F.floor(F.col("__pages") / 3)))
    rows = rows.withColumn("__hit", text.has_leader(F.replace("text", F.lit(" "), F.lit(""))) ).withColumn("__n", F.row_number().over(at))
    rows = rows.withColumn("__island", F.col("__n") - F.sum(F.col("__hit").cast("int")).over(at)).withColumn("__next", F.lead("__hit").over(at))
    hits = rows.where("__hit")
    first = hits.groupBy("doc_id", "__island").agg(F.count(F.lit(1)).alias("__size"), F.min("__n").alias("__start")).where(F.col("__size") >= run)
    first = first.groupBy("doc_id").agg(F.min(F.struct("__start", "__size")).alias("__f")).select("doc_id", F.col("__f.__start").alias("__start"), (F.col("__f.__start") + F.col("__f.__size") - 1).alias("__end"))
    heading = F.replace(F.trim("text"), F.lit(" "), F.lit("")).isin("目录", "目次")
    joined = rows.join(first, "doc_id").where(F.col("__n").between(F.col("__start"), F.col("__end")) | ((F.col("__n") == F.col("__start") - 1) & heading))
    title = F.trim(F.regexp_replace("text", r"(?U)(.)\1{9,}\s*\d+.*$", ""))
    return joined.select("doc_id", "page", "ordinal", "text", F.when(F.col("__hit"), title).otherwise(F.trim("text")).alias("title"))


def in_catalog(lines: DataFrame, titles: DataFrame) -> DataFrame:
    """Lines whose text, blanks aside, is one of the document's titles (doc_id, title)."""
    bare = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    keys = titles.select(F.col("doc_id"), bare("title").alias("__t")).distinct()
    return lines.withColumn("__t", bare("text")).join(keys, ["doc_id", "__t"], "left_semi").drop("__t")

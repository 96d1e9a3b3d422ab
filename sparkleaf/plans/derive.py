"""Document inputs derived from the plain tables: lines with pages and boxes, files, cells, trees. Each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry

PAGE_LINES = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page, ordinal, line_no, text): newline-separated lines of documents, four to a page."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return rows.select("doc_id", F.floor(F.col("line_no") / PAGE_LINES).cast("int").alias("page"), (F.col("line_no") % PAGE_LINES).alias("ordinal"), "line_no", "text")


LINES_SQL = f"""lines AS (SELECT doc_id, ((i - 1) // {PAGE_LINES})::INTEGER AS page, ((i - 1) % {PAGE_LINES})::INTEGER AS ordinal, (i - 1)::INTEGER AS line_no, text
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL))"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a box: 14 points a line; every third line stands 250 points to the right of the others, on the line before it."""
    rows = lines(spark, sf_dir)
    shift = F.when(F.col("ordinal") == 3, 250).otherwise(0)
    row = F.when(F.col("ordinal") == 3, 2).otherwise(F.col("ordinal"))
    width = F.least(F.length("text") * 2, F.lit(400))
    return rows.select("*", (72 + shift).cast("double").alias("x0"), (72 + 14 * row).cast("double").alias("y0"), (72 + shift + width).cast("double").alias("x1"), (84 + 14 * row).cast("double").alias("y1"))


BOXES_SQL = f"""{LINES_SQL},
boxes AS (SELECT * EXCLUDE (s, r), (72 + s)::DOUBLE AS x0, (72 + 14 * r)::DOUBLE AS y0, (72 + s + least(length(text) * 2, 400))::DOUBLE AS x1, (84 + 14 * r)::DOUBLE AS y1
  FROM (SELECT *, CASE WHEN ordinal = 3 THEN 250 ELSE 0 END AS s, CASE WHEN ordinal = 3 THEN 2 ELSE ordinal END AS r FROM lines))"""


def with_box(df: DataFrame) -> DataFrame:
    return df.withColumn("box", geometry.box("x0", "y0", "x1", "y1")).drop("x0", "y0", "x1", "y1")


EXTENSIONS = ("txt", "CSV", "pdf", "docx", "xlsx", "png", "bin")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, name, bytes, pages, content): a file for each document, its extension by doc_id."""
    names = F.array(*[F.lit(x) for x in EXTENSIONS])
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    ext = F.element_at(names, (F.col("doc_id") % len(EXTENSIONS)).cast("int") + 1)
    return docs.select("doc_id", F.concat(F.lit("report."), F.col("doc_id").cast("string"), F.lit("."), ext).alias("name"), (F.col("n_chars") * 5000).alias("bytes"), (F.col("n_chars") % 7000).cast("int").alias("pages"), F.col("text").cast("binary").alias("content"))


FILES_SQL = f"""files AS (SELECT doc_id, 'report.' || doc_id || '.' || [{", ".join(repr(x) for x in EXTENSIONS)}][(doc_id % {len(EXTENSIONS)} + 1)::INTEGER] AS name, n_chars * 5000 AS bytes, (n_chars % 7000)::INTEGER AS pages, text FROM documents WHERE text IS NOT NULL)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as an ordered tree input: system turns are titles, user turns lists, others texts."""
    kind: Column = F.when(F.col("role") == "system", "Title").when(F.col("role") == "user", "List").otherwise("Text")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("ordinal"), kind.alias("layout_type"), "text")


TURNS_SQL = """turns AS (SELECT conv_id AS doc_id, turn::INTEGER AS ordinal, CASE role WHEN 'system' THEN 'Title' WHEN 'user' THEN 'List' ELSE 'Text' END AS layout_type, text FROM conversations)"""

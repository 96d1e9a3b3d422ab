"""A training corpus from documents: quality rules, line dedup, near-dedup, personal data masked, packed sequences.

Each stage takes (spark, docs, sf_dir), where docs are all rows that the stage before kept, and returns a DataFrame: all but the
last with the columns of documents (others are dropped). run() writes each stage's rows as Parquet in the shared folder, reads
them again, and deletes them when the next stage has written its own. An empty table gives no rows; a null doc_id is kept as
it is; null texts fail the quality rules.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkleaf.llm import linededup, minhash, packing, pii, quality
from sparkleaf.llm.common import discard, settle

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, n_chars counted anew where a stage changes texts."""
    return df.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go."""
    return quality.repetition(docs).where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a smaller document holds go; a document that loses all its words by that goes."""
    out = linededup.dedup_lines(docs, min_chars=10)
    return _documents(out.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (5-word shingles, similarity 0.8 or more) stays: its smallest."""
    groups = minhash.near_duplicates(docs, shingle_words=5, percent=80).where(~F.col("kept")).select("doc_id")
    return docs.join(groups, "doc_id", "left_anti").select(*COLUMNS)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; every document stays."""
    return _documents(pii.mask(docs.select(*COLUMNS)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 2048 tokens."""
    pieces = packing.tokenize_pieces(docs, 2048, "byte_bpe_50k.json", 0)
    sized = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(sized, 2048, groups=packing.groups_for(docs))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup), ("mask pii", mask_pii), ("pack", pack)]

#: Masking and packing have no SQL form; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole documents table."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)


if here := os.path.dirname(os.path.abspath(__file__)):  # Python workers import the package from where this file lies
    os.environ["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([here, *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]))

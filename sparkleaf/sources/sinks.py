"""Sinks: a result cache by parse type, Markdown files, JSON with ordered keys, progress rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

# Percent of each status.
PROGRESS = {"begin": 0, "layout_finish": 50, "domtree_finish": 50, "finish": 100, "fail": 100}


def cache_put(results: DataFrame, path: str) -> None:
    """Append results (doc_id, parse_type, result) to the cache, a partition for each parse type."""
    results.write.mode("append").partitionBy("parse_type").parquet(path)


def cache_get(spark: SparkSession, path: str) -> DataFrame:
    """The cached results; an empty table where there is no cache yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], "doc_id bigint, result string, parse_type string")


def not_cached(files: DataFrame, cached: DataFrame, parse_types: list[str]) -> DataFrame:
    """Files for which not all of the parse types are cached."""
    have = cached.where(F.col("parse_type").isin(parse_types)).groupBy("doc_id").agg(F.count_distinct("parse_type").alias("n")).where(F.col("n") == len(parse_types))
    return files.join(have, "doc_id", "left_anti")


def write_markdown(rendered: DataFrame, path: str) -> None:
    """(doc_id, markdown) as text, one document a row."""
    rendered.select(F.to_json(F.struct("doc_id", "markdown")).alias("value")).write.mode("overwrite").text(path)


def ordered_json(columns: list[str]) -> Column:
    """A JSON object whose keys stand in the given order; nulls are written."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def progress(rows: DataFrame, callbacks: str = "callbacks") -> DataFrame:
    """(doc_id, callback, percent): a row for each callback address of a document's status."""
    percent = F.create_map(*[F.lit(x) for pair in PROGRESS.items() for x in pair])
    return rows.select("doc_id", F.explode(callbacks).alias("callback"), percent[F.col("status")].alias("percent"))


def rewritten_url(url, inner: str, outer: str) -> Column:
    """An object's address with the outer endpoint, over https."""
    url = F.col(url) if isinstance(url, str) else url
    return F.regexp_replace(F.replace(url, F.lit(inner), F.lit(outer)), "^http:", "https:")

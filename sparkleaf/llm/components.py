"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settle


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over distinct edges (a, b) with a > b."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v") if large else edges.toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:  # a node's larger neighbours go to its least neighbour
        out = joined.where(F.col("v") > F.col("u")).select("v", "m")
    else:  # a node and its smaller neighbours go to the least of them
        out = joined.select("v", "m").union(least.select("u", "m"))
    return out.toDF("a", "b").where(F.col("a") > F.col("b")).distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id long, component long) of every id in links (a long, b long): the smallest id reachable.

    Links may repeat, run in either direction or join an id to itself; null ends are passed over. Each round is written to the
    shared folder; the rounds end when one changes nothing. No group of neighbours is collected.
    """
    edges = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    edges = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    state = mark(edges)
    for _ in range(max_rounds):
        if not state[0]:
            break
        last, edges = edges, settle(_stars(_stars(edges, True), False), "stars")
        discard(last)
        before, state = state, mark(edges)
        if before == state:
            break
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    roots = edges.select(F.col("b").alias("id")).distinct().withColumn("component", F.col("id"))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)

"""Exact top-k search by exhaustive term-at-a-time accumulation.

Rows are sparse integer vectors. Candidates are dealt by hash into blocks of bounded size and each block meets the
stated query set in query blocks of bounded size. In a block, postings (a dimension's candidates with their weights)
are scattered, weighted by the query's component, into dense score arrays; partition selection keeps the k best of the
block, and a rank over the blocks' winners merges them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPARSE = "id long, dims array<int>, weights array<long>"
#: Candidates of a block, queries of a query block, queries whose score arrays are held at once.
BLOCK_ROWS, QUERY_ROWS, TILE = 16_384, 4_096, 32


def sparse_rows(df: DataFrame, id_col: str, vector_col: str, scale: int = 1024) -> DataFrame:
    """(id, dims, weights) with weight floor(scale * component) of each component, zero weights left out.

    Rows with a null id, a null vector, or a null or non-finite component are left out; an empty vector stays, with
    no dimension. Weights must fit into 32 bits for scores to be exact in 64.
    """
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.where(F.col(id_col).isNotNull() & v.isNotNull()).where(finite)
    w = F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    pairs = F.filter(F.transform(w, lambda x, i: F.struct(i.alias("d"), x.alias("w"))), lambda p: p["w"] != 0)
    return rows.select(F.col(id_col).cast("long").alias("id"), pairs.alias("p")).select("id", F.col("p.d").cast("array<int>").alias("dims"), F.col("p.w").alias("weights"))


def _csr(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, row of each entry, dimension, weight; rows in order of id."""
    table = table.sort_by("id").combine_chunks()
    ids = table["id"].to_numpy().astype(np.int64)
    dims, weights = table["dims"].combine_chunks(), table["weights"].combine_chunks()
    lens = np.diff(np.asarray(dims.offsets))
    return ids, np.repeat(np.arange(len(ids)), lens), np.asarray(dims.flatten()).astype(np.int64), np.asarray(weights.flatten()).astype(np.int64)


def best_of_block(queries: pa.Table, items: pa.Table, k: int, own: bool) -> pa.Table:
    """The k best items of this block for each query; own: an item with the query's id takes part."""
    ids, row, dim, weight = _csr(items)
    q_ids, q_row, q_dim, q_weight = _csr(queries)
    by_dim = np.argsort(dim, kind="stable")
    row, weight, dim = row[by_dim], weight[by_dim], dim[by_dim]
    terms, starts = np.unique(dim, return_index=True)
    postings = {int(t): (row[a:b], weight[a:b]) for t, a, b in zip(terms, starts, [*starts[1:], len(dim)])}
    out_q, out_i, out_s = [], [], []
    q_starts = np.searchsorted(q_row, np.arange(len(q_ids) + 1))
    for lo in range(0, len(q_ids) if len(ids) else 0, TILE):
        hi = min(lo + TILE, len(q_ids))
        scores = np.zeros((hi - lo, len(ids)), np.int64)
        a, b = q_starts[lo], q_starts[hi]
        d, w, r = q_dim[a:b], q_weight[a:b], q_row[a:b] - lo
        for t in np.unique(d):
            found = postings.get(int(t))
            if found is None:
                continue
            at, of = found
            for qr, qw in zip(r[d == t], w[d == t]):
                if len(at) == len(ids):  # every candidate holds the term: its postings are the rows in order
                    scores[qr] += of * qw
                else:
                    scores[qr, at] += of * qw
        for j in range(hi - lo):
            keep = np.arange(len(ids)) if own else np.flatnonzero(ids != q_ids[lo + j])
            s = scores[j][keep]
            if len(s) > k:
                edge = np.partition(s, len(s) - k)[len(s) - k]
                over = np.flatnonzero(s > edge)
                at = np.concatenate((over, np.flatnonzero(s == edge)[: k - len(over)]))
            else:
                at = np.arange(len(s))
            out_q.append(np.full(len(at), q_ids[lo + j]))
            out_i.append(ids[keep[at]])
            out_s.append(s[at])
    join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
    return pa.table({"query_id": join(out_q), "item_id": join(out_i), "score": join(out_s)})


def search(queries: DataFrame, items: DataFrame, k: int = 10, own: bool = False, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, item_id, score): the k highest inner products of each query, ties to the smaller item id.

    queries, items: sparse rows as from sparse_rows; other columns are not read. Without `own` items with the query's
    own id are left out. Fewer than k candidates: all of them. Repeated item rows compete as rows of their own;
    repeated query ids count as one query, of the row that sorts first. Empty inputs give no rows.
    """
    items = items.select("id", "dims", "weights")
    queries = queries.select("id", "dims", "weights").groupBy("id").agg(F.min(F.struct("dims", "weights")).alias("q")).select("id", "q.dims", "q.weights")
    blocks = max(1, -(-items.count() // block_rows))
    q_blocks = max(1, -(-queries.count() // query_rows))
    key: Column = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    q_key: Column = F.pmod(F.xxhash64("id"), F.lit(q_blocks)).cast("int")
    left = queries.withColumn("q_block", q_key).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = items.withColumn("block", key).withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    near = left.groupBy("block", "q_block").cogroup(right.groupBy("block", "q_block")).applyInArrow(lambda q, i: best_of_block(q, i, k, own), "query_id long, item_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("item_id"))
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "item_id", "score")

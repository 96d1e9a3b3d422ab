"""Vector best-fit packing of token pieces into sequences.

A sequence has three capacities: tokens, documents, and attention cost (the sum of squared piece lengths). Pieces go, by
falling length, into the open sequence that fits best under every constraint: the one whose weighted residual is
smallest in norm after the piece, or whose residual before it has the largest weighted dot product with the piece's
demand. Pieces are dealt by hash into groups of bounded expected size, each of which is packed alone; a group of thousands
of pieces leaves about one sequence that isn't full, so the number of sequences stays near its lower bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Payload, releasing, sliced, tokenizer_file
from .tokencount import BATCH_BYTES, bpe, bpe_table, cuts_at_spaces

#: Documents of a packing group, on average.
GROUP_DOCS = 4_096


def tokenize_pieces(docs: DataFrame, max_tokens: int = 2048, tokenizer: str = "byte_bpe_50k.json", end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(doc_id, piece int, start long, length long, ids binary): the ids of each whole text, cut for packing.

    ids: little-endian unsigned 32-bit ids by the tokenizers library without special tokens, then end_id (None: none). A
    document of more than max_tokens is cut into pieces of max_tokens of which the first may be shorter; others are one
    piece. A null text counts as empty (its end id alone; without end id it has no piece). A null doc_id stays null.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer_file(tokenizer)
        if cuts_at_spaces(path):
            ids_of = bpe_table(path).ids
        else:
            whole = bpe(path)

            def ids_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
                ids = [e.ids for e in whole.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
                return np.array([x for i in ids for x in i], "<i4"), np.cumsum([0, *map(len, ids)])

        for batch in sliced(batches, "text", batch_bytes):
            ids, ends = ids_of(batch.column("text"))
            if end_id is not None:
                ids, ends = np.insert(ids, ends[1:], end_id), ends + np.arange(len(ends))
            lens = np.diff(ends)
            n = -(-lens // max_tokens)
            doc = np.repeat(np.arange(len(lens)), n)
            piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            first = (lens - (n - 1) * max_tokens)[doc]  # of the first piece; the others are full
            start = np.where(piece == 0, 0, first + (piece - 1) * max_tokens)
            length = np.where(piece == 0, first, max_tokens)
            offsets = np.concatenate((ends[:-1][doc] + start, ends[-1:])) * 4
            blob = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids.astype("<i4")))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), blob], ["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(releasing(cut), "doc_id long, piece int, start long, length long, ids binary")


def best_fit(lengths: np.ndarray, max_tokens: int, max_docs: int, max_attention: int, weights: tuple[float, float, float], by: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece. Lengths are at most max_tokens and come in the order in which they are placed."""
    if by not in ("norm", "dot"):
        raise ValueError("by: norm or dot")
    n = len(lengths)
    cap = np.array([max_tokens, max_docs, max_attention], float)
    w = np.array(weights) / cap**2
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    left = np.empty((64, 3))  # residual capacities of the open bins
    label = np.empty(64, np.int64)
    used = made = 0
    for i, t in enumerate(lengths.tolist()):
        demand = np.array([t, 1, t * t], float)
        j = -1
        if used:
            r = left[:used]
            fits = (r[:, 0] >= t) & (r[:, 1] >= 1) & (r[:, 2] >= demand[2])
            at = np.flatnonzero(fits)
            if len(at):
                score = ((r[at] - demand) ** 2) @ w if by == "norm" else -(r[at] @ (w * demand))
                j = int(at[np.argmin(score)])
        if j < 0:
            if used == len(left):
                left, label = np.concatenate((left, np.empty_like(left))), np.concatenate((label, np.empty_like(label)))
            left[used], label[used], j = cap, made, used
            used, made = used + 1, made + 1
        bins[i], offsets[i] = label[j], max_tokens - left[j, 0]
        left[j] -= demand
        if left[j].min() < 1:  # full
            used -= 1
            left[j], label[j] = left[used], label[used]
    return bins, offsets


def pack(pieces: DataFrame, max_tokens: int = 2048, max_docs: int | None = None, max_attention: int | None = None, weights: tuple[float, float, float] = (1.0, 0.01, 0.01), by: str = "norm", groups: int = 1) -> DataFrame:
    """All columns of pieces (doc_id, piece and length among them), and sequence_id long, offset long.

    Each sequence holds at most max_tokens tokens, max_docs pieces (None: as many as fit) and max_attention of summed
    squared lengths (None: not binding), gapless from offset 0. Pieces are dealt into `groups` by a hash of doc_id and
    piece, whatever repeats; equal lengths go by doc_id, piece. A piece of length 0 (or null) takes a place of its own
    length; one that no empty sequence can hold fails. A null doc_id or piece goes before others of its length. Columns sequence_id
    and offset of the input (in any case) are replaced; other columns may have any name.
    """
    docs_cap, cost_cap = max_docs or max(max_tokens, 1), max_attention or max_tokens**2
    held = Payload(pieces, ("sequence_id", "offset"))

    def place(key: tuple, group: pa.Table) -> pa.Table:
        lengths = np.asarray(group["length"].fill_null(0)).astype(np.int64)
        if len(lengths) and (lengths.max() > max_tokens or int(lengths.max()) ** 2 > cost_cap):
            raise ValueError("a piece is longer than a sequence may hold")
        ids = np.asarray(group["doc_id"].fill_null(-1)).astype(np.int64)
        order = np.lexsort((np.asarray(group["piece"].fill_null(0)), ids, -lengths))
        bins, offsets = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        bins[order], offsets[order] = best_fit(lengths[order], max_tokens, docs_cap, cost_cap, weights, by)
        return pa.table({"row": group["row"], "sequence_id": pa.array(bins + (key[0].as_py() << 32)), "offset": pa.array(offsets)})

    own = held.df.select(held.row(), *[held[c].cast("long").alias(c) for c in ("doc_id", "piece", "length")])
    dealt = own.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("long"))
    schema = own.select("row").schema.add("sequence_id", "long").add("offset", "long")
    return dealt.groupBy("part").applyInArrow(place, schema).select(*held.back(), "sequence_id", "offset")


def groups_for(docs: DataFrame, group_docs: int = GROUP_DOCS) -> int:
    """Packing groups for this many documents."""
    return max(1, round(docs.count() / group_docs))

"""SentencePiece encoding and decoding by a table of distinct chunks.

In the BPE models meant here no piece crosses from a non-blank into a white-space marker, so a marked word (a run of
markers and what follows) is segmented alone: each distinct one once, and its ids are joined back by position. The
table is kept for each task and is bounded, so the vocabulary of the corpus is never gathered in one place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkTable
from .common import Payload, releasing, row_type, sliced, tokenizer_file

#: Text bytes and ids that are coded at once, and distinct chunks that a worker keeps: a task has a worker to encode and one to decode.
SLICE_BYTES, SLICE_IDS, TABLE_CHUNKS = 1 << 20, 1 << 18, 300_000
MARK = "▁"
_MARKED = re.compile(f"[ {MARK}]*[^ {MARK}\n]+|[ {MARK}]+|\n")


@lru_cache(2)
def processor(path: str):
    """The library's processor; a model whose pieces could cross a cut is refused."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    if any("\n" in p or re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
        raise ValueError(f"{path}: pieces cross white space, so words can't be segmented one by one")
    for probe in ("a  b", " a", "\n", "ＡÅﬁ"):
        if sp.decode(sp.encode(probe)) != probe:
            raise ValueError(f"{path}: the model normalises text, so words can't be segmented one by one")
    return sp


def cut_soundly(text: str) -> list[str]:
    """Marked words and newlines of a text, with the space that the library puts before a text that isn't empty."""
    return _MARKED.findall(" " + text) if text else []


def table_of(path: str) -> ChunkTable:
    """Ids of texts by their distinct marked words. A newline before a chunk keeps the library from marking it itself."""
    sp = processor(path)
    head = len(sp.encode("\n"))

    def make(chunks: list[str]) -> list[bytes]:
        return [np.array(ids[head:], "<i4").tobytes() for ids in sp.encode(["\n" + c for c in chunks], num_threads=1)]

    return ChunkTable(make, lambda c: c == " " or MARK in c, cut_soundly, lead=" ", rows=TABLE_CHUNKS)


def _mapped(df: DataFrame, read_col: str, read_type: str, out_col: str, out_type: str, made) -> DataFrame:
    """df with out_col by `made` over batches (row, value). A column that is read as it is goes to the worker once, as value."""
    held = Payload(df, (out_col,))
    once = held.place(read_col) in held.kept and df.dtypes[held.place(read_col)][1] == read_type
    row = held.df.select(held.row(*[read_col] * once), held[read_col].cast(read_type).alias("value"))
    out = row.mapInArrow(releasing(made), f"{row_type(row)}, value {read_type}, made {out_type}")
    return out.select(*held.back(**{read_col: F.col("value")} if once else {}), F.col("made").alias(out_col))


def encode(df: DataFrame, text_col: str = "text", model: str = "piece_bpe_32k.model", out_col: str = "ids", end: bool = True, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """All columns of df, and ids array<int>: exactly the library's ids of the whole text, with the end id if `end`.

    model: a path or the name of an installed public tokenizer file. A null text counts as empty (the end id alone, or
    an empty array). An existing column out_col is replaced; rows keep their number and order.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer_file(model)
        table = table_of(path)
        last = np.array([processor(path).eos_id()] * end, "<i4")
        for batch in sliced(batches, "value", slice_bytes):
            ids, ends = table.ids(batch.column("value"))
            if end:
                ids, ends = np.insert(ids, ends[1:], last[0]), ends + np.arange(len(ends))
            out = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("value"), out], ["row", "value", "made"])

    return _mapped(df, text_col, "string", out_col, "array<int>", made)


def decode(df: DataFrame, ids_col: str = "ids", model: str = "piece_bpe_32k.model", out_col: str = "decoded", slice_ids: int = SLICE_IDS) -> DataFrame:
    """All columns of df, and the string that the library decodes from the ids.

    Ids are cut before each marked word, distinct id chunks are decoded once and their texts are joined by position. Null
    ids, or an empty array: an empty string. Null ids inside an array are passed over. Control ids (begin, end) decode
    to nothing; an id outside of the vocabulary fails, as it does in the library.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(tokenizer_file(model))
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        blank = np.array([set(p) == {MARK} for p in pieces])
        # a cut stands before a piece that opens a marked word, but not inside a run of blank pieces
        opens = np.array([p.startswith(MARK) for p in pieces])
        nl = sp.encode("\n")[-1]
        table: dict[bytes, str] = {}

        def texts_of(column: pa.Array) -> pa.Array:
            lens = np.where(np.asarray(column.is_valid()), np.diff(np.asarray(column.offsets)), 0)
            values = column.flatten()
            doc = np.repeat(np.arange(len(lens)), lens)
            if values.null_count:
                doc = doc[np.asarray(values.is_valid())]
                values = values.drop_null()
            ids = np.ascontiguousarray(np.asarray(values), "<i4")
            if not len(ids):
                return pa.array([""] * len(lens), pa.string())
            if ids.min() < 0 or ids.max() >= len(pieces):
                raise ValueError("an id is outside of the vocabulary")
            first = np.ones(len(ids), bool)
            first[1:] = doc[1:] != doc[:-1]
            cut = opens[ids]
            cut[1:] &= ~blank[ids[:-1]]
            starts = np.flatnonzero(cut | first)
            offsets = np.append(starts, len(ids)).astype(np.int32) * 4
            coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(ids)]).dictionary_encode()
            keys = coded.dictionary.to_pylist()
            new = [x for x in keys if x not in table]
            made = {x: t[1:] for x, t in zip(new, sp.decode([[nl, *np.frombuffer(x, "<i4").tolist()] for x in new]), strict=True)} if new else {}
            distinct = [made[x] if x in made else table[x] for x in keys]
            if len(table) < TABLE_CHUNKS:
                table.update(made)
            index = np.asarray(coded.indices).astype(np.int64)
            index[first[starts] & opens[ids[starts]]] += len(distinct)  # a text's first mark isn't part of it
            chunks = pa.array([*distinct, *(t[1:] for t in distinct)], pa.string()).take(pa.array(index))
            ends = np.searchsorted(doc[starts], np.arange(len(lens) + 1))
            whole = np.asarray(np.frombuffer(chunks.buffers()[1], np.int32)[: len(chunks) + 1])
            return pa.Array.from_buffers(pa.string(), len(lens), [None, pa.py_buffer(np.ascontiguousarray(whole[ends])), chunks.buffers()[2]])

        for batch in batches:
            column = batch.column("value")
            sizes = np.cumsum(np.diff(np.asarray(column.offsets)))
            start = 0
            while start < len(column):
                done = sizes[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(sizes, done + slice_ids, "right")))
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("value"), texts_of(part.column("value"))], ["row", "value", "made"])
                start = stop

    return _mapped(df, ids_col, "array<int>", out_col, "string", made)

"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sentencepieces
from .chunks import ChunkTable, unsafe
from .common import Payload, row_type, sliced, tokenizer_file

#: Bytes of texts that are encoded at once.
BATCH_BYTES = 8 << 20
#: Chunks that are encoded as lines of one string.
LINES = 128
#: White space inside a chunk or at its end.
_SPACED = re.compile(r".\s|\n", re.S).search


def bpe(path: str):
    """The tokenizers library's tokenizer of a file, without truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def cuts_at_spaces(path: str) -> bool:
    """Whether this tokenizer file is plain byte-level BPE, for which the cuts of `chunks` are safe."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    pre = made.get("pre_tokenizer") or {}
    plain = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and not re.search(r"\s", t["content"]) for t in made["added_tokens"])
    return bool(plain and made.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"))


def bpe_table(path: str) -> ChunkTable:
    """A chunk table over a byte-level BPE file.

    Chunks are encoded many in one string, each on a line of its own, and the ids are cut again at the newline's id.
    """
    tokenizer = bpe(path)
    nl = tokenizer.encode("\n", add_special_tokens=False).ids

    def encoded(texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<i4").tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def make(chunks: list[str]) -> list[bytes]:
        if len(nl) != 1:
            return encoded(chunks)
        out: list[bytes] = []
        blocks = [chunks[i : i + LINES] for i in range(0, len(chunks), LINES)]
        for block, ids in zip(blocks, encoded(["\n".join(b) for b in blocks]), strict=True):
            at = np.flatnonzero(np.frombuffer(ids, "<i4") == nl[0])
            if len(at) != len(block) - 1 or any(map(_SPACED, block)):  # a chunk that isn't one line
                out += encoded(block)
            else:
                out += map(ids.__getitem__, map(slice, [0, *(4 * at + 4).tolist()], [*(4 * at).tolist(), len(ids)]))
        return out

    return ChunkTable(make, unsafe)


def counter(path: str) -> Callable[[pa.Array], np.ndarray]:
    """A function that gives the number of tokens of each of an array of texts."""
    if path.endswith(".model"):
        return sentencepieces.table_of(path).counts
    if cuts_at_spaces(path):
        return bpe_table(path).counts
    tokenizer = bpe(path)  # of another kind: whole texts
    return lambda texts: np.array([len(e.ids) for e in tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)], np.int64)


def token_counts(df: DataFrame, text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", out_col: str = "n_tokens", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """All columns of df, and n_tokens long: the text's number of tokens as the file's library counts them.

    tokenizer: a path, or the name of an installed public tokenizer file (.json: tokenizers, .model: sentencepiece). No
    begin, end or other special token is added, and special strings inside texts are handled as the library's default
    does. A null text counts as empty (0). Batches are cut by bytes, whole texts are split at places where no token
    can span, and each distinct split of a batch is encoded once; only lengths come back. An existing column out_col
    (in any case) is replaced, others may have any name. Rows keep their number and order; empty tables give none.
    """
    held = Payload(df, (out_col,))
    row = held.df.select(held.row(text_col), held[text_col].cast("string").alias("text"))
    schema = f"{row_type(row)}, text string, n long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(tokenizer_file(tokenizer))
        for batch in batches:
            n = [counts(x.column("text")) for x in sliced([batch], "text", batch_bytes)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), pa.array(np.concatenate(n) if n else np.empty(0, np.int64))], ["row", "text", "n"])

    return row.mapInArrow(count, schema).select(*held.back(**{text_col: F.col("text")}), F.col("n").alias(out_col))

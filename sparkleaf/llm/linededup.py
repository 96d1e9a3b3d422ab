"""Line dedup with levelled sorted runs of line hashes.

An index of the lines seen so far is kept as sorted runs of 128-bit line hashes with the smallest document that holds
each. A new batch is sorted, merge-anti-joined with the runs, and what is new becomes a run of its own on level 0; when a
level is full its runs are compacted into one on the next. Each task runs such an index over its own documents first, so a
line leaves a task once however often it occurs there; the tasks' runs are then dealt by hash and merged in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOR_DOCS, U64, WORD_SPACE, Payload, as_bytes, blob_column, bounds, by_document, documents, for_docs, partitions, releasing, row_type, sliced, unblob

KEY = "S16"
#: Runs of a level before they are compacted.
FANOUT = 4
#: Lines that a task holds before it passes its runs on.
TASK_LINES = 4_000_000


def key_of(line: bytes, min_chars: int) -> bytes | None:
    """The hash of a line stripped of ASCII white space and with A-Z in lower case; None if it is too short."""
    key = line.strip(WORD_SPACE).lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and not key.isascii() and len(key.decode()) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


class LevelledRuns:
    """Sorted runs of (key, owner), the smallest document that holds the key; each key stands in one run."""

    def __init__(self, fanout: int = FANOUT):
        self.fanout = fanout
        self.levels: list[list[tuple[np.ndarray, np.ndarray]]] = []

    def __len__(self) -> int:
        return sum(len(k) for level in self.levels for k, _ in level)

    def add(self, keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge a batch; returns the (keys, docs) that another, smaller document holds."""
        if not len(keys):
            return keys, docs
        order = np.lexsort((docs, keys))
        keys, docs = keys[order], docs[order]
        starts = bounds(keys)
        owners = docs[starts[:-1]]
        again = docs != np.repeat(owners, np.diff(starts))
        lost_k, lost_d = [keys[again]], [docs[again]]
        keys = keys[starts[:-1]]
        for level in self.levels:
            for run_keys, run_owners in level:
                at = np.searchsorted(run_keys, keys)
                at[at == len(run_keys)] = 0
                hit = run_keys[at] == keys
                old, new = run_owners[at[hit]], owners[hit]
                lost_k.append(keys[hit][old != new])
                lost_d.append(np.maximum(old, new)[old != new])
                run_owners[at[hit]] = np.minimum(old, new)
                keys, owners = keys[~hit], owners[~hit]
        if len(keys):
            self._push(0, keys, owners)
        return np.concatenate(lost_k), np.concatenate(lost_d)

    def _push(self, depth: int, keys: np.ndarray, owners: np.ndarray) -> None:
        if depth == len(self.levels):
            self.levels.append([])
        level = self.levels[depth]
        level.append((keys, owners.copy()))
        if len(level) >= self.fanout:
            self.levels[depth] = []
            self._push(depth + 1, *self._merged(level))

    @staticmethod
    def _merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([k for k, _ in runs])
        order = np.argsort(keys, kind="stable")
        return keys[order], np.concatenate([o for _, o in runs])[order]

    def drain(self) -> tuple[np.ndarray, np.ndarray]:
        """All keys with their owners, sorted; the index is empty afterwards."""
        runs = [run for level in self.levels for run in level]
        self.levels = []
        return self._merged(runs) if runs else (np.empty(0, KEY), np.empty(0, np.int64))


_ROW = f"own boolean, {FOR_DOCS}"


def _lost(keys: np.ndarray, docs: np.ndarray, parts: int) -> pa.RecordBatch:
    """Rows of lost (key, document) pairs, dealt by document."""
    rows = for_docs(documents(docs), keys, parts)
    return pa.RecordBatch.from_arrays([pa.array(np.zeros(rows.num_rows, bool)), *rows.columns], ["own", *rows.schema.names])


def lost_lines(docs: DataFrame, min_chars: int = 10, fanout: int = FANOUT) -> DataFrame:
    """(doc_id long, found binary): a blob of the 16-byte keys that each document loses to a smaller doc_id."""
    parts = partitions(docs.sparkSession)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = LevelledRuns(fanout)

        def passed_on() -> pa.RecordBatch:
            keys, owners = runs.drain()
            part = (np.frombuffer(keys.tobytes(), "<u8")[::2] % U64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            keys, owners, part = keys[order], owners[order], part[order]
            cuts = bounds(part)
            n = len(cuts) - 1
            return pa.RecordBatch.from_arrays([pa.array(np.ones(n, bool)), pa.array(part[cuts[:-1]]), blob_column(owners, cuts), pa.nulls(n, pa.binary()), blob_column(keys, cuts)], ["own", "part", "docs", "counts", "values"])

        for batch in sliced(batches, "text"):
            keys: list[bytes] = []
            holder: list[int] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text"))):
                found = {k for line in text.split(b"\n") if len(line) >= min_chars and (k := key_of(line, min_chars))}
                keys += found
                holder += [doc] * len(found)
            lost = runs.add(np.array(keys, KEY), np.array(holder, np.int64))
            if len(lost[0]):
                yield _lost(*lost, parts)
            if len(runs) > TASK_LINES:
                yield passed_on()
        if len(runs):
            yield passed_on()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = LevelledRuns(fanout)
        for batch in batches:
            known = batch.filter(pc.invert(batch.column("own")))
            if known.num_rows:
                yield known
            rest = batch.filter(batch.column("own"))
            if rest.num_rows:
                lost = runs.add(unblob(rest.column("values"), KEY), unblob(rest.column("docs"), np.int64))
                if len(lost[0]):
                    yield _lost(*lost, parts)

    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    lost = rows.mapInArrow(releasing(local), _ROW).repartitionById(parts, F.col("part")).mapInArrow(releasing(merged), _ROW)
    return by_document(lost.drop("own"), parts, KEY).select("doc_id", "found")


def dedup_lines(docs: DataFrame, min_chars: int = 10, fanout: int = FANOUT) -> DataFrame:
    """All columns of docs with text replaced, and n_lines long (before), n_dropped long.

    Texts are split at newlines (null or empty: one empty line, and the text stays what it is). A line's key is the line
    without ASCII white space at its ends and with A-Z in lower case. Keys of min_chars code points or more that are found
    in several documents lose all their lines except in the smallest doc_id that holds them; repeats inside a document
    stay together. The other lines stay, joined by newlines. Rows with a null doc_id hold no line and lose none; rows of
    one doc_id count as one document. Keys are compared by 128-bit hashes. Columns n_lines and n_dropped (in any case) are replaced;
    other columns may have any name.
    """
    held = Payload(docs, ("n_lines", "n_dropped"))
    base = held.df.select(held.row("text"), held["text"].cast("string").alias("text"), held["doc_id"].cast("long").alias("doc_id"))
    lost = lost_lines(base.select("doc_id", "text"), min_chars, fanout).withColumnRenamed("found", "keys")
    row = base.join(lost, "doc_id", "left").select("row", "text", "keys")
    schema = f"{row_type(row)}, text string, n_lines long, n_dropped long"

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            column = batch.column("text")
            raw, blobs = as_bytes(column), batch.column("keys")
            n_lines = [(t or b"").count(b"\n") + 1 for t in raw]
            dropped = [0] * len(raw)
            for i in np.flatnonzero(np.asarray(blobs.is_valid())):
                blob = blobs[int(i)].as_py()
                keys = {blob[j : j + 16] for j in range(0, len(blob), 16)}
                lines = (raw[i] or b"").split(b"\n")
                stay = [x for x in lines if len(x) < min_chars or key_of(x, min_chars) not in keys]
                dropped[i] = len(lines) - len(stay)
                raw[i] = raw[i] if raw[i] is None else b"\n".join(stay)
            text = pa.array(raw, pa.binary()).cast(pa.string()) if any(dropped) else column
            yield pa.RecordBatch.from_arrays([batch.column("row"), text, pa.array(n_lines, pa.int64()), pa.array(dropped, pa.int64())], ["row", "text", "n_lines", "n_dropped"])

    return row.mapInArrow(releasing(rewrite), schema).select(*held.back(text=F.col("text")), "n_lines", "n_dropped")

"""Substring dedup with difference-cover anchors.

Of the positions modulo 7 only 1, 2 and 4 are anchors: whatever two positions a match of 13 words has in two documents, a
shift below 7 brings both onto anchors, and the 7 words there lie within the match. So only 3 of 7 positions are hashed
and dealt out; anchors found in several documents send those documents to the second step, where the windows around
shared anchors are hashed whole (96 bits) and the smallest document of each window is found; the last step drops the
words that such windows of larger documents cover. Copies of whole texts are known by their digest and skip the middle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DOCUMENT, FOR_DOCS, U64, Payload, WordHashes, as_bytes, blob_column, bounds, by_document, discard, for_docs, mixed, parts_for, row_type, settle, sliced

PERIOD, COVER = 7, (1, 2, 4)
#: Entries that a task gathers before it deals them out, and documents that these may come from (numbered in 16 bits).
TASK_ENTRIES, TASK_DOCS = 2_000_000, 65_000
#: Bytes of text whose anchors make a hash part, on average: about 2 million.
PART_BYTES = 24 << 20
_BASES = (0xD1B54A32D192ED03, 0xABC98388FB8FAC03)
_LOW = U64((1 << 40) - 1)


def _rolled(hashes: np.ndarray, n: int, base: int) -> np.ndarray:
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, U64)
    out = hashes[:m].copy()
    for j in range(1, n):
        out *= U64(base)
        out += hashes[j : j + m]
    return mixed(out)


def _anchors(hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of a document's anchors."""
    width = words - PERIOD + 1
    n = len(hashes) - width + 1
    if len(hashes) < words:
        return np.empty(0, np.int64), np.empty(0, U64)
    at = np.arange(n)
    at = at[np.isin(at % PERIOD, COVER)]
    out = hashes[at]
    for j in range(1, width):
        out *= U64(_BASES[0])
        out += hashes[at + j]
    return at, mixed(out)


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> U64(40)) % U64(parts)).astype(np.int64)


def _narrow(keys: np.ndarray, width: int) -> np.ndarray:
    """The low `width` bytes of 64-bit values, as fixed strings of bytes."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).view(f"V{width}").ravel()


def _wide(blob: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").ravel()


class _Dealer:
    """Gathers entries (64-bit key, document, further column) and deals them out as blobs for each part."""

    def __init__(self, parts: int, key_bytes: int):
        self.parts, self.key_bytes = parts, key_bytes
        self.keys: list[np.ndarray] = []
        self.more: list[np.ndarray] = []
        self.sizes: list[int] = []
        self.docs: list[tuple[int, int]] = []
        self.n = 0

    def add(self, doc: tuple[int, int], keys: np.ndarray, more: np.ndarray) -> None:
        if len(keys):
            self.keys.append(keys)
            self.more.append(more)
            self.sizes.append(len(keys))
            self.docs.append(doc)
            self.n += len(keys)

    def full(self) -> bool:
        return self.n >= TASK_ENTRIES or len(self.docs) >= TASK_DOCS

    def rows(self) -> Iterator[pa.RecordBatch]:
        """Rows (part, keys, more, doc, ids): doc holds 16-bit numbers into ids."""
        if not self.n:
            return
        keys, more = np.concatenate(self.keys), np.concatenate(self.more)
        doc = np.repeat(np.arange(len(self.docs), dtype=np.uint16), self.sizes)
        part = _part_of(keys, self.parts)
        order = np.argsort(part, kind="stable")
        part = part[order]
        cuts = bounds(part)
        ids = np.array(self.docs, DOCUMENT)
        sent = [blob_column(_narrow(keys[order], self.key_bytes), cuts), blob_column(more[order], cuts) if more.dtype.itemsize else pa.nulls(len(cuts) - 1, pa.binary()), blob_column(doc[order], cuts)]
        used = [np.unique(doc[order][a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        if sum(map(len, used)) < 0.7 * len(self.docs) * len(used):  # few documents for each part: their ids alone
            numbers = doc[order].copy()
            for (a, b), u in zip(zip(cuts[:-1], cuts[1:], strict=True), used, strict=True):
                numbers[a:b] = np.searchsorted(u, numbers[a:b])
            sent[2] = blob_column(numbers, cuts)
            id_column = pa.array([ids[u].tobytes() for u in used], pa.binary())
        else:
            id_column = pa.array([ids.tobytes()] * len(used), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]].astype(np.int32)), *sent, id_column], ["part", "keys", "more", "doc", "ids"])
        self.__init__(self.parts, self.key_bytes)


_DEALT = "part int, keys binary, more binary, doc binary, ids binary"


def _gathered(batches: Iterator[pa.RecordBatch], key_bytes: int, more_dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """(part, key, document, further column) of all entries of a task."""
    part, keys, docs, more = [], [], [], []
    for batch in batches:
        for p, k, m, d, i in zip(*(batch.column(c).to_pylist() for c in ("part", "keys", "more", "doc", "ids")), strict=True):
            wide = _wide(k, key_bytes)
            keys.append(wide)
            part.append(np.full(len(wide), p, np.int64))
            docs.append(np.frombuffer(i, DOCUMENT)[np.frombuffer(d, np.uint16)])
            if more_dtype is not None:
                more.append(np.frombuffer(m, more_dtype))
    if not keys:
        return None
    return np.concatenate(part), np.concatenate(keys), np.concatenate(docs), np.concatenate(more) if more else np.empty(0)


def shared_anchors(docs: DataFrame, words: int, parts: int) -> DataFrame:
    """(doc_id, text_hash, found): blobs of 64-bit (part, low 40 bits) keys of the anchors that other documents have too."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes_of, dealer = WordHashes(), _Dealer(parts, 5)
        for batch in sliced(batches, "text"):
            for *doc, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash")), as_bytes(batch.column("text"))):
                keys = np.unique(_anchors(hashes_of(text.split()), words)[1])
                dealer.add(tuple(doc), keys, np.empty(len(keys), "V0"))
                if dealer.full():
                    yield from dealer.rows()
        yield from dealer.rows()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _gathered(batches, 5, None)
        if held is None:
            return
        part, keys, docs, _ = held
        keys = keys | (part.astype(U64) << U64(40))
        order = np.argsort(keys, kind="stable")
        keys, docs = keys[order], docs[order]
        cuts = bounds(keys)
        several = np.minimum.reduceat(docs["id"], cuts[:-1]) != np.maximum.reduceat(docs["id"], cuts[:-1])
        at = np.repeat(several, np.diff(cuts))
        if at.any():
            yield for_docs(docs[at], keys[at], parts)

    return by_document(docs.mapInArrow(deal, _DEALT).repartitionById(parts, F.col("part")).mapInArrow(find, FOR_DOCS), parts, U64)


def later_windows(docs: DataFrame, words: int, parts: int) -> DataFrame:
    """(doc_id, text_hash, found): blobs of 32-bit starts of windows of (doc_id, text_hash, text, found) that a smaller document has too."""
    reach = PERIOD

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes_of, dealer = WordHashes(), _Dealer(parts, 8)
        for batch in sliced(batches, "text"):
            for *doc, found, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "found")), as_bytes(batch.column("text"))):
                hashes = hashes_of(text.split())
                at, keys = _anchors(hashes, words)
                keys = (keys & _LOW) | (_part_of(keys, parts).astype(U64) << U64(40))
                at = at[np.isin(keys, np.frombuffer(found, U64))]
                near = np.zeros(len(hashes) + reach, bool)
                for shift in range(reach):  # a window that starts up to 6 words before an anchor holds it
                    near[at[at >= shift] - shift] = True
                starts = np.flatnonzero(near[: max(0, len(hashes) - words + 1)])
                if len(starts):
                    key = _rolled(hashes, words, _BASES[0])[starts]
                    check = (_rolled(hashes, words, _BASES[1])[starts] >> U64(32)).astype("<u4")
                    more = np.empty(len(starts), [("check", "<u4"), ("start", "<u4")])
                    more["check"], more["start"] = check, starts
                    dealer.add(tuple(doc), key, more)
                    if dealer.full():
                        yield from dealer.rows()
        yield from dealer.rows()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _gathered(batches, 8, np.dtype([("check", "<u4"), ("start", "<u4")]))
        if held is None:
            return
        _, keys, docs, more = held
        order = np.lexsort((more["check"], keys))
        keys, docs, more = keys[order], docs[order], more[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (more["check"][1:] != more["check"][:-1])
        cuts = np.append(np.flatnonzero(new), len(keys))
        later = docs["id"] > np.repeat(np.minimum.reduceat(docs["id"], cuts[:-1]), np.diff(cuts))
        if later.any():
            yield for_docs(docs[later], more["start"][later], parts)

    return by_document(docs.mapInArrow(deal, _DEALT).repartitionById(parts, F.col("part")).mapInArrow(find, FOR_DOCS), parts, "<u4")


def dedup_substrings(docs: DataFrame, words: int = 13) -> DataFrame:
    """All columns of docs with text replaced by the kept words joined by single spaces, and n_words, n_removed long.

    Words: runs of other characters than ASCII white space, unchanged. A window is `words` (at least 7) consecutive words of
    one document; each word covered by a window whose words also start in a document with a smaller doc_id is removed. Windows
    are judged on the input. Null texts have no words and give an empty text; texts shorter than a window keep all words.
    Rows with a null doc_id keep all words and count for no other. Rows of one doc_id don't count against each other; each is judged
    by its own words. Windows are compared by 96 bits of hash. Columns n_words and n_removed (in any case) are replaced; other
    columns may have any name.
    """
    if words < PERIOD:
        raise ValueError(f"a window has {PERIOD} words at least")
    held = Payload(docs, ("n_words", "n_removed"))
    text = held["text"].cast("string")
    # a text is told from others of its doc_id by the first half of its digest
    digest = F.md5(text.cast("binary"))
    text_hash = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("text_hash")
    rows = held.df.select(held.row("text"), text.alias("text"), held["doc_id"].cast("long").alias("doc_id"), digest.alias("digest"), text_hash)
    base = rows.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text_hash", "text", "digest")
    digests = settle(base.select("doc_id", "text_hash", "digest", F.octet_length("text").alias("n")), "digests")
    parts = parts_for(docs.sparkSession, digests.agg(F.sum("n")).first()[0] or 0, PART_BYTES)
    first = digests.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    copies = settle(digests.join(first, "digest").where(F.col("doc_id") > F.col("first")).select("doc_id", "text_hash").distinct(), "copies")
    key = ["doc_id", "text_hash"]
    anchors = settle(shared_anchors(base, words, parts), "anchors")
    windows = later_windows(base.join(copies, key, "left_anti").join(anchors, key), words, parts)
    marks = settle(windows.withColumn("whole", F.lit(False)).unionByName(copies.withColumns({"found": F.lit(None).cast("binary"), "whole": F.lit(True)})), "windows")
    discard(digests, copies, anchors)
    row = rows.join(marks, key, "left").select("row", "text", "found", F.coalesce("whole", F.lit(False)).alias("whole"))
    schema = f"{row_type(row)}, text string, n_words long, n_removed long"

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            texts, n_words, n_removed = [], [], []
            for text, found, whole in zip(as_bytes(batch.column("text")), batch.column("found").to_pylist(), batch.column("whole").to_pylist()):
                own = (text or b"").split()
                n_words.append(len(own))
                if whole and len(own) >= words:
                    own = []
                elif found:
                    starts = np.frombuffer(found, "<u4").astype(np.int64)
                    steps = np.bincount(starts, minlength=len(own) + 1)[: len(own) + 1] - np.bincount(np.minimum(starts + words, len(own)), minlength=len(own) + 1)[: len(own) + 1]
                    own = [own[i] for i in np.flatnonzero(np.cumsum(steps)[:-1] == 0)]
                n_removed.append(n_words[-1] - len(own))
                texts.append(b" ".join(own))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], ["row", "text", "n_words", "n_removed"])

    return row.mapInArrow(rewrite, schema).select(*held.back(text=F.col("text")), "n_words", "n_removed")

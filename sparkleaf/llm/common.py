"""Helpers that the training-data operators share: bounded Arrow slices, word hashes, hash-part blobs, working tables."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
WORD_SPACE = b" \t\n\v\f\r"
#: Text bytes that a worker holds as Python objects at a time.
SLICE_BYTES = 4 << 20
#: Distinct strings that a worker keeps in one of its tables; a full table is emptied.
TABLE_ROWS = 200_000


def partitions(spark: SparkSession) -> int:
    """Hash parts to deal rows into: the session's number of shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset on a local master an own one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    set_before = spark.sparkContext.getCheckpointDir()
    if set_before is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="sparkleaf-"))
        set_before = spark.sparkContext.getCheckpointDir()
    return set_before.rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends there and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparkleaf-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that `settle` wrote and that nothing unfinished reads any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(df._settled_at)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def parts_for(spark: SparkSession, entries: int, part_entries: int = 2_000_000) -> int:
    """Hash parts for so many entries: part_entries in each at most on average, and no fewer than the session's partitions."""
    return max(partitions(spark), -(-entries // part_entries))


class Payload:
    """A DataFrame under neutral column names, so that no name of its columns can clash or need quoting.

    Names are looked up as they are written, else without regard to case. Columns named like one of `replaced` (in any case) are
    left out of `row` and `back`, to be added anew.
    """

    def __init__(self, df: DataFrame, replaced: tuple[str, ...] = ()):
        gone = {x.lower() for x in replaced}
        self.names = df.columns
        self.df = df.toDF(*[f"c{i}" for i in range(len(self.names))])
        self.kept = [i for i, c in enumerate(self.names) if c.lower() not in gone]

    def place(self, name: str) -> int:
        found = [i for i, c in enumerate(self.names) if c == name] or [i for i, c in enumerate(self.names) if c.lower() == name.lower()]
        if not found:
            raise ValueError(f"no column {name}")
        return found[0]

    def __getitem__(self, name: str) -> Column:
        return F.col(f"c{self.place(name)}")

    def row(self, *without: str) -> Column:
        """A struct of the columns that stay, but for `without`."""
        out = {self.place(x) for x in without}
        return F.struct(F.lit(True).alias("r"), *[F.col(f"c{i}") for i in self.kept if i not in out]).alias("row")

    def back(self, **new: Column) -> list[Column]:
        """The columns that stay under their names, read from `row` but for those in `new`."""
        at = {self.place(x): c for x, c in new.items()}
        return [at.get(i, F.col(f"row.c{i}")).alias(self.names[i]) for i in self.kept]


def row_type(df: DataFrame) -> str:
    """The type of the column `row`, as it is written in a schema."""
    return f"row {df.schema['row'].dataType.simpleString()}"


def sliced(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices whose `column` holds about max_bytes at most; a longer single value stands alone."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < n:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + max_bytes, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def give_back() -> None:
    """Return freed memory to the system; where the C library has no call for that, only Arrow's is returned."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def releasing(func: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """func for mapInArrow, after which the worker gives back what it freed: workers outlive their tasks, and idle ones would keep it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from func(batches)
        give_back()

    return run


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 of each string."""
    return column.cast(pa.binary()).to_pylist()


def strings(values: list[str]) -> pa.Array:
    return pa.array(values, pa.string())


def blob_column(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """A binary column of the bytes of data between neighbouring cuts (row indices, from 0 to len(data))."""
    width = data.dtype.itemsize
    if int(cuts[-1]) * width >= 1 << 31:
        raise ValueError("blobs of a batch are limited to 2 GiB")
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def unblob(column: pa.Array, dtype) -> np.ndarray:
    """All values of a column of blobs, one after another."""
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), dtype)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits (xor-shift and multiply)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


class WordHashes:
    """64-bit xxh3 of words, from a bounded table of the distinct ones met."""

    def __init__(self, rows: int = TABLE_ROWS):
        self.rows, self.table = rows, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        table, digest = self.table, xxhash.xxh3_64_intdigest
        if len(table) > self.rows:
            table.clear()
        for w in set(words):
            if w not in table:
                table[w] = digest(w)
        return np.fromiter(map(table.__getitem__, words), U64, len(words))


def rolled(hashes: np.ndarray, n: int, base: int) -> np.ndarray:
    """Polynomial hashes of each n consecutive values, modulo 2^64 (not yet mixed)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, U64)
    out, b = hashes[:m].copy(), U64(base)
    for j in range(1, n):
        out *= b
        out += hashes[j : j + m]
    return out


def bounds(sorted_values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, with the length at the end."""
    n = len(sorted_values)
    if not n:
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [n])).astype(np.int64)


#: A document: its id, and a hash of its text where rows of one id are kept apart (else 0).
DOCUMENT = np.dtype([("id", "<i8"), ("text", "<i8")])
FOR_DOCS = "part int, docs binary, counts binary, values binary"


def documents(ids: np.ndarray, text_hashes: np.ndarray | int = 0) -> np.ndarray:
    out = np.empty(len(ids), DOCUMENT)
    out["id"], out["text"] = ids, text_hashes
    return out


def for_docs(docs: np.ndarray, values: np.ndarray, parts: int) -> pa.RecordBatch:
    """Rows (part, docs, counts, values): the values of each document (of type DOCUMENT), a row for each part they are dealt to."""
    part = mixed(docs["id"].astype(U64)) % U64(parts)
    order = np.lexsort((docs["text"], docs["id"], part))
    docs, values, part = docs[order], values[order], part[order].astype(np.int32)
    new = np.ones(len(docs), bool)
    new[1:] = docs[1:] != docs[:-1]
    cuts = np.append(np.flatnonzero(new), len(docs))
    part = part[cuts[:-1]]
    at = bounds(part)
    return pa.RecordBatch.from_arrays([pa.array(part[at[:-1]]), blob_column(docs[cuts[:-1]], at), blob_column(np.diff(cuts), at), blob_column(values, cuts[at])], ["part", "docs", "counts", "values"])


def by_document(rows: DataFrame, parts: int, dtype) -> DataFrame:
    """(doc_id, text_hash, found): one blob of all values for each document of rows from for_docs."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(unblob(b.column("docs"), DOCUMENT), unblob(b.column("counts"), np.int64), unblob(b.column("values"), dtype)) for b in batches]
        if not held:
            return
        docs, counts, values = (np.concatenate(x) for x in zip(*held, strict=True))
        docs = np.repeat(docs, counts)
        order = np.lexsort((docs["text"], docs["id"]))
        docs, values = docs[order], values[order]
        new = np.ones(len(docs), bool)
        new[1:] = docs[1:] != docs[:-1]
        cuts = np.append(np.flatnonzero(new), len(docs))
        for lo in range(0, len(cuts) - 1, 10_000):  # batches of blobs stay small
            at = cuts[lo : lo + 10_001]
            first = docs[at[:-1]]
            yield pa.RecordBatch.from_arrays([pa.array(first["id"]), pa.array(first["text"]), blob_column(values[at[0] : at[-1]], at - at[0])], ["doc_id", "text_hash", "found"])

    return rows.repartitionById(parts, F.col("part")).mapInArrow(join, "doc_id long, text_hash long, found binary")


def tokenizer_file(name_or_path: str) -> str:
    """A path as it is; a bare name is looked up among the installed public tokenizer files of this worker."""
    if os.sep in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)

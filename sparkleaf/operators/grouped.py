"""Whole groups in Arrow batches: rows are dealt by a key and sorted, and a worker sees each group in one table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def starts(keys: pa.Array) -> np.ndarray:
    """Whether each row opens a group: its key (never null) differs from the one before."""
    new = np.ones(len(keys), bool)
    if len(keys) > 1:
        new[1:] = np.asarray(pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)))
    return new


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches in order of the key; what is held is one batch and the group that it ends in."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = (table if held is None else pa.concat_tables([held, table])).combine_chunks()
        if not table.num_rows:
            continue
        end = int(np.flatnonzero(starts(table[key].combine_chunks()))[-1])
        if end:
            yield table.slice(0, end).combine_chunks()
        held = table.slice(end)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def numbered(rows: DataFrame, keys: list[str], order: list[str], read: list[str], out: str, number: Callable[[list[dict]], list[int]]) -> DataFrame:
    """All columns and `out` int, which `number` gives for the rows of a group, sorted, from the columns of `read`."""
    names = rows.columns
    at = {c: i for i, c in enumerate(names)}
    neutral = rows.toDF(*[f"c{i}" for i in range(len(names))])
    col = lambda c: F.col(f"c{at[c]}")
    key = F.to_json(F.struct(*[col(c) for c in keys])).alias("key")
    base = neutral.select(F.struct(F.lit(True).alias("r"), *[F.col(f"c{i}") for i in range(len(names))]).alias("row"), key, F.struct(*[col(c).alias(c) for c in read]).alias("read"), *[col(c).alias(f"o{i}") for i, c in enumerate(order)])
    dealt = base.repartition("key").sortWithinPartitions("key", *[f"o{i}" for i in range(len(order))])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "key"):
            cuts = [*np.flatnonzero(starts(table["key"].combine_chunks())).tolist(), table.num_rows]
            found = table["read"].to_pylist()
            numbers = [n for a, b in zip(cuts[:-1], cuts[1:], strict=True) for n in number(found[a:b])]
            yield from table.select(["row"]).append_column("n", pa.array(numbers, pa.int32())).combine_chunks().to_batches()

    made_rows = dealt.mapInArrow(made, f"row {base.schema['row'].dataType.simpleString()}, n int")
    return made_rows.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names) if c != out], F.col("n").alias(out))

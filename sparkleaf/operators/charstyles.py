"""Spans of characters packed for a join with the shapes of their page, and cut by the shapes that they meet.

A span travels as its text, where its characters end, and its characters' boxes: the bit patterns' differences from one
character to the next, compressed. Nothing is rounded. Null coordinates are kept as NaN.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters that a worker holds unpacked at a time; a longer span stands alone.
SLICE_CHARS = 1 << 17
SIDES = ("x0", "y0", "x1", "y1")
PACKED = "n int, text string, ends binary, boxes binary, x0 double, y0 double, x1 double, y1 double"
CUT = "part long, style string, text string"
_STYLES = pa.array([None, "highlight", "underline", "strike"], pa.string())


def _field(values: pa.StructArray, name: str) -> pa.Array:
    """A field of structs, null where the struct is."""
    return values.flatten()[values.type.get_field_index(name)]


def _coordinates(boxes: pa.StructArray) -> np.ndarray:
    """Boxes as rows of four doubles."""
    return np.stack([_field(boxes, s).cast(pa.float64()).to_numpy(zero_copy_only=False) for s in SIDES], axis=1)


def _slices(lens: np.ndarray) -> Iterator[tuple[int, int]]:
    ends, start = np.cumsum(lens), 0
    while start < len(lens):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE_CHARS, "right")))
        yield start, stop
        start = stop


def _joined(values: pa.StringArray, cuts: np.ndarray) -> pa.Array:
    """The strings between neighbouring cuts (from 0 to all), one after another."""
    offsets = np.asarray(np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1])
    return pa.Array.from_buffers(pa.string(), len(cuts) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets[cuts])), values.buffers()[2] or pa.py_buffer(b"")])


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns but for chars array<struct<c, box>>, and those of PACKED; spans without characters are left out."""
    codec = pa.Codec("zstd")
    for batch in batches:
        lens = np.asarray(pc.fill_null(pc.list_value_length(batch.column("chars")), 0)).astype(np.int64)
        if not lens.all():
            batch, lens = batch.filter(pa.array(lens > 0)), lens[lens > 0]
        for start, stop in _slices(lens):
            part = batch.slice(start, stop - start)
            values = part.column("chars").flatten()
            cuts = np.concatenate(([0], np.cumsum(lens[start:stop])))
            c = pc.fill_null(_field(values, "c").cast(pa.string()), "")
            odd = np.logical_or.reduceat(np.asarray(pc.utf8_length(c)) != 1, cuts[:-1])
            sizes = np.asarray(pc.binary_length(c)).astype("<i4")
            ends = [sizes[a:b].tobytes() if o else None for o, a, b in zip(odd.tolist(), cuts.tolist(), cuts[1:].tolist(), strict=False)]
            at = _coordinates(_field(values, "box"))
            bits = np.ascontiguousarray(at).view("<i8")
            steps = bits.copy()
            steps[1:] -= bits[:-1]
            steps[cuts[:-1]] = bits[cuts[:-1]]
            boxes = [codec.compress(memoryview(steps[a:b]).cast("B"), asbytes=True) for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]
            low, high = np.fmin.reduceat(at, cuts[:-1]), np.fmax.reduceat(at, cuts[:-1])
            around = [pa.array(np.ascontiguousarray(x)) for x in (low[:, 0], low[:, 1], high[:, 2], high[:, 3])]
            rest = {k: part.column(k) for k in part.schema.names if k != "chars"}
            new = [pa.array(lens[start:stop], pa.int32()), _joined(c, cuts), pa.array(ends, pa.binary()), pa.array(boxes, pa.binary()), *around]
            yield pa.RecordBatch.from_arrays([*rest.values(), *new], [*rest, "n", "text", "ends", "boxes", *SIDES])


def _unpacked(boxes: pa.Array, lens: np.ndarray) -> np.ndarray:
    codec = pa.Codec("zstd")
    steps = np.concatenate([np.frombuffer(codec.decompress(b, n * 32, asbytes=True), "<i8") for b, n in zip(boxes.to_pylist(), lens.tolist(), strict=True)]).reshape(-1, 4)
    sums = np.concatenate((np.zeros((1, 4), "<i8"), np.cumsum(steps, axis=0)))
    starts = np.cumsum(lens) - lens
    return np.ascontiguousarray(sums[1:] - np.repeat(sums[starts], lens, axis=0)).view("<f8")


def _sizes(text: pa.Array, ends: pa.Array, lens: np.ndarray) -> np.ndarray:
    """Bytes of each character."""
    offsets = np.asarray(np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1])
    if ends.null_count == len(ends):
        data = np.frombuffer(text.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        return np.diff(np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data)))
    out = []
    for value, end, n in zip(text.cast(pa.binary()).to_pylist(), ends.to_pylist(), lens.tolist(), strict=True):
        data = np.frombuffer(value, np.uint8)
        out.append(np.diff(np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))) if end is None else np.frombuffer(end, "<i4"))
        assert len(out[-1]) == n
    return np.concatenate(out)


def _styles(at: np.ndarray, lens: np.ndarray, zones: pa.ListArray) -> np.ndarray:
    """The place in _STYLES of each character: of the first zone that covers half of its width and meets its height."""
    counts = np.asarray(pc.fill_null(pc.list_value_length(zones), 0)).astype(np.int64)
    z = _coordinates(zones.flatten())
    firsts, starts = np.cumsum(counts) - counts, np.cumsum(lens) - lens
    out, open_ = np.zeros(len(at), np.int8), np.ones(len(at), bool)
    for k in range(int(counts.max(initial=0))):
        live = np.flatnonzero(counts > k)
        index = np.repeat(starts[live] - (np.cumsum(lens[live]) - lens[live]), lens[live]) + np.arange(lens[live].sum())
        zone = np.repeat(firsts[live] + k, lens[live])
        kept = open_[index]
        index, zone = index[kept], zone[kept]
        (x0, y0, x1, y1), (zx0, zy0, zx1, zy1) = at[index].T, z[zone].T
        hit = (np.fmin(x1, zx1) - np.fmax(x0, zx0) >= 0.5 * (x1 - x0)) & (np.fmin(y1, zy1) >= np.fmax(y0, zy0)) & (x1 > x0)
        height, below = y1 - y0, (zy0 + zy1) / 2 - y0
        style = np.where(zy1 - zy0 >= 0.5 * height, 1, np.where(below > 0.75 * height, 2, np.where(below >= 0.25 * height, 3, 0)))
        out[index[hit]] = style[hit]
        open_[index[hit]] = False
    return out


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows of keys, n, text, ends, boxes and zones array<box>: the keys and the columns of CUT, a row for each part."""
    for batch in batches:
        lens = np.asarray(batch.column("n")).astype(np.int64)
        for start, stop in _slices(lens):
            part, n = batch.slice(start, stop - start), lens[start:stop]
            text = part.column("text").cast(pa.string())
            style = _styles(_unpacked(part.column("boxes"), n), n, part.column("zones"))
            starts = np.cumsum(n) - n
            new = np.ones(len(style), bool)
            new[1:] = style[1:] != style[:-1]
            new[starts] = True
            at = np.flatnonzero(new)
            row = np.repeat(np.arange(len(n)), n)[at]
            number = np.cumsum(new)
            offsets = np.concatenate(([0], np.cumsum(_sizes(text, part.column("ends"), n)))).astype(np.int32)
            first = np.frombuffer(text.buffers()[1], np.int32)[text.offset]
            texts = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(first + offsets[np.append(at, len(style))]), text.buffers()[2] or pa.py_buffer(b"")])
            keys = [k for k in part.schema.names if k not in ("n", "text", "ends", "boxes", "zones")]
            columns = [part.column(k).take(pa.array(row)) for k in keys]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(number[at] - number[starts[row]] + 1), _STYLES.take(pa.array(style[at])), texts], [*keys, "part", "style", "text"])

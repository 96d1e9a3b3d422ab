"""Chunks of text that a tokenizer may encode one by one, and the bounded table of the distinct ones.

Byte-level BPE with the usual pre-tokenizer pattern never joins a word with what stands before its leading space, and
a single newline between two non-blank characters is a token of its own. So a text without runs of white space falls
apart into chunks (newlines, and words with their leading space) whose ids simply follow one another. A text with a
run of white space at a cut is cut only between a non-blank character and a single space before another one.

Cutting and finding the distinct chunks of a slice of texts is done by Arrow's kernels; only distinct chunks become
Python strings, and only those that the table lacks are encoded.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct chunks that a worker keeps (about 200 bytes each); beyond, chunks are encoded anew in each slice.
TABLE_CHUNKS = 600_000
#: A chunk longer than this isn't kept.
LONG = 200
_SEP = "\x1e"
_SOUND = re.compile(r"(?<=\S)(?= \S)")


def cut_soundly(text: str) -> list[str]:
    """Chunks whose cuts no run of white space touches."""
    return _SOUND.split(text) if text else []


def unsafe(chunk: str) -> bool:
    """A run of white space could cross a cut at an end of this chunk."""
    if chunk == "\n":
        return False
    body = chunk[1:] if chunk[:1] == " " else chunk
    return not body or body[0].isspace() or body[-1].isspace()


class ChunkTable:
    """Ids of texts by way of their distinct chunks.

    make: the ids of each of a list of chunks, as little-endian 32-bit bytes. unsafe: chunks at whose ends a text must
    not be cut; texts that hold one are cut by `again`. lead: what stands before the first chunk of each text.
    """

    def __init__(self, make: Callable[[list[str]], list[bytes]], unsafe: Callable[[str], bool] = unsafe, again: Callable[[str], list[str]] = cut_soundly, lead: str = "", rows: int = TABLE_CHUNKS):
        self.make, self.unsafe, self.again, self.lead, self.rows = make, unsafe, again, lead, rows
        self.table: dict[str, bytes | None] = {}
        self.missed = 0

    def _values(self, distinct: list[str], checked: bool) -> list[bytes | None]:
        table = self.table
        new = [c for c in distinct if c not in table]
        if len(table) >= self.rows:
            self.missed += len(new)
            if self.missed > 8 * self.rows:  # other texts than those that filled it
                table.clear()
                self.missed = 0
        bad = {c for c in new if self.unsafe(c)} if checked else set()
        fresh = [c for c in new if c not in bad] if bad else new
        made: dict[str, bytes | None] = dict(zip(fresh, self.make(fresh), strict=True)) if fresh else {}
        made.update(dict.fromkeys(bad))
        if checked and len(table) < self.rows:
            table.update((c, v) for c, v in made.items() if len(c) <= LONG)
        if not made:
            return [table[c] for c in distinct]
        return [made[c] if c in made else table[c] for c in distinct]

    def _slow(self, text: str) -> bytes:
        chunks = self.again(text)
        distinct = list(set(chunks))
        values = dict(zip(distinct, self._whole(distinct), strict=True))
        return b"".join(map(values.__getitem__, chunks))

    def _whole(self, distinct: list[str]) -> list[bytes]:
        """Values of chunks that aren't to be judged by their ends."""
        known = {c: self.table[c] for c in distinct if self.table.get(c) is not None}
        fresh = [c for c in distinct if c not in known]
        known.update(zip(fresh, self.make(fresh), strict=True))
        return [known[c] for c in distinct]

    def _fast(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Length of each distinct chunk, ids of the distinct chunks, chunk numbers, ends of the texts in these."""
        s = pc.replace_substring(pc.replace_substring(texts, " ", _SEP + " "), "\n", f"{_SEP}\n{_SEP}")
        if self.lead:
            s = pc.binary_join_element_wise(pa.scalar(self.lead, s.type), s, pa.scalar("", s.type))
        lists = pc.split_pattern(s, _SEP)
        coded = lists.flatten().dictionary_encode()
        values = self._values(coded.dictionary.to_pylist(), True)
        ends = np.asarray(lists.offsets).astype(np.int64)
        lens = np.fromiter((-1 if v is None else len(v) >> 2 for v in values), np.int64, len(values))
        return lens, np.frombuffer(b"".join(v or b"" for v in values), "<i4"), np.asarray(coded.indices), ends - ends[0]

    def _parts(self, texts: pa.Array):
        """The fast path's parts for the texts fit for it, their positions, and the ids of the other texts."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = np.asarray(pc.match_substring(texts, _SEP))
        for _ in range(2):
            fit = np.flatnonzero(~odd)
            part = self._fast(texts.take(pa.array(fit)) if odd.any() else texts) if len(fit) else None
            if part is None or not (part[0] < 0).any():
                break
            of_text = np.repeat(np.arange(len(fit)), np.diff(part[3]))
            odd = odd.copy()
            odd[fit[np.unique(of_text[part[0][part[2]] < 0])]] = True
        rest = {int(i): self._slow(texts[int(i)].as_py()) for i in np.flatnonzero(odd)}
        return part, fit, rest

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text; null counts as empty."""
        out = np.zeros(len(texts), np.int64)
        part, fit, rest = self._parts(texts)
        if part:
            lens, _, index, ends = part
            sums = np.concatenate(([0], np.cumsum(lens[index])))
            out[fit] = sums[ends[1:]] - sums[ends[:-1]]
        for i, ids in rest.items():
            out[i] = len(ids) >> 2
        return out

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, int32; ends of the texts, from 0); null counts as empty."""
        part, fit, rest = self._parts(texts)
        flat, sums, ends = np.empty(0, "<i4"), np.zeros(1, np.int64), np.zeros(1, np.int64)
        if part:
            lens, distinct, index, ends = part
            n = lens[index]
            starts = np.concatenate(([0], np.cumsum(lens)))[:-1]
            sums = np.concatenate(([0], np.cumsum(n)))
            flat = distinct[np.repeat(starts[index] - sums[:-1], n) + np.arange(sums[-1])]
        if not rest:
            return flat, sums[ends]
        at = dict(zip(fit.tolist(), range(len(fit)), strict=True))
        pieces = [np.frombuffer(rest[i], "<i4") if i in rest else flat[sums[ends[at[i]]] : sums[ends[at[i] + 1]]] for i in range(len(texts))]
        return np.concatenate(pieces), np.cumsum([0, *map(len, pieces)])

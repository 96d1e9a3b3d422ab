"""Quality rules on repetition coverage.

Rolling hashes of several n-gram lengths over the word hashes of a text tell which n-grams occur twice or more; the
characters that such n-grams cover, and those of lines seen before, are measured against the characters of all words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, WORD_SPACE, Payload, WordHashes, as_bytes, mixed, releasing, row_type, sliced

#: Largest share of word characters inside n-grams that occur twice or more, by n. Short ones recur in any long text, so that
#: only texts made of little else are above theirs; from 4 words on the limits lie close to what the base rule lets through.
MAX_NGRAM_SHARE = {2: 0.80, 3: 0.50, 4: 0.26, 5: 0.21, 6: 0.21, 7: 0.21, 8: 0.21, 9: 0.21, 10: 0.20}
#: Largest share of word characters in lines that repeat an earlier line, and of words in 5-word windows found twice.
MAX_LINE_SHARE, MAX_WORD_SHARE, MIN_WORDS = 0.20, 0.20, 10
SYMBOLS = b"#*$%&|<>"
_BASE = 0x9E3779B97F4A7C15

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, dup_line_chars long, n_repeat_words long, dup_ngram_chars array<long>"


def _covered(hashes: np.ndarray, n: int) -> np.ndarray | None:
    """Which words lie in an n-gram that occurs twice or more (None: none does)."""
    m = len(hashes)
    ordered = np.sort(hashes)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return None
    twice = np.unique(twice)
    at = np.searchsorted(twice, hashes)
    at[at == len(twice)] = 0
    steps = np.zeros(m + n, np.int64)
    starts = np.flatnonzero(twice[at] == hashes)
    steps[starts] += 1
    steps[starts + n] -= 1
    return np.cumsum(steps[:-1]) > 0


def measures(text: bytes, hashes_of: WordHashes, lengths: tuple[int, ...]) -> tuple:
    """The measures of a text, in the order of MEASURES. Words are cut at ASCII white space; characters are code points."""
    words = text.split()
    ascii_only = text.isascii()
    sizes = np.fromiter(map(len, words) if ascii_only else (len(w) if w.isascii() else len(w.decode()) for w in words), np.int64, len(words))
    n_symbols = len(text) - len(text.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    dup_lines = dup_chars = 0
    if b"\n" in text:
        for line in text.split(b"\n"):
            if line in seen:
                dup_lines += 1
                bare = line.translate(None, WORD_SPACE)
                dup_chars += len(bare) if ascii_only else len(bare.decode())
            elif line.strip(WORD_SPACE):
                seen.add(line)
    n_repeat, covered_chars = 0, []
    hashes = hashes_of(words)
    rolling, have = hashes, 1
    for n in sorted({5, *lengths}):
        if len(words) < n:
            covered_chars += [0] * (n in lengths)
            continue
        rolling = rolling[: len(words) - n + 1].copy()
        for j in range(have, n):
            rolling *= U64(_BASE)
            rolling += hashes[j : j + len(rolling)]
        have = n
        cover = _covered(mixed(rolling), n)
        if n == 5 and cover is not None:
            n_repeat = int(cover.sum())
        if n in lengths:
            covered_chars.append(0 if cover is None else int(sizes[cover].sum()))
    return len(words), int(sizes.sum()), n_symbols, dup_lines, dup_chars, n_repeat, covered_chars


def repetition(docs: DataFrame, text_col: str = "text", max_ngram_share: dict[int, float] = MAX_NGRAM_SHARE, max_line_share: float = MAX_LINE_SHARE) -> DataFrame:
    """All columns of docs, the MEASURES of each whole text, base_failed boolean and kept boolean.

    Words are runs of other characters than ASCII white space. base_failed: fewer than 10 words, or more than a fifth of the
    words inside 5-word windows found twice or more in the text. kept: not base_failed, and neither the character share
    of repeated n-grams of any length nor that of repeated lines is above its limit. Null texts count as empty, which
    fail. Measure columns of the same names in docs (in any case) are replaced, others may have any name; rows keep their number.
    """
    lengths = tuple(sorted(max_ngram_share))
    names = [x.split()[0] for x in MEASURES.split(", ")]
    held = Payload(docs, (*names, "base_failed", "kept"))
    row = held.df.select(held.row(), held[text_col].cast("string").alias("text"))
    schema = f"{row_type(row)}, {MEASURES}"
    types = [pa.int64()] * 6 + [pa.list_(pa.int64())]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes_of = WordHashes()
        for batch in sliced(batches, "text"):
            found = [measures(t or b"", hashes_of, lengths) for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(list(c), t) for c, t in zip(zip(*found), types, strict=True))], ["row", *names])

    out = row.mapInArrow(releasing(measure), schema)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MAX_WORD_SHARE) * F.col("n_words"))
    bad = F.col("dup_line_chars") > max_line_share * F.col("word_chars")
    for i, n in enumerate(lengths):
        bad = bad | (F.col("dup_ngram_chars")[i] > max_ngram_share[n] * F.col("word_chars"))
    return out.select(*held.back(), *names, base.alias("base_failed"), (~base & ~bad).alias("kept"))

"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of one to three characters (letters in lower case, all else one blank), weighted by their share
of the text and by the logarithm of the inverse document frequency over all training rows. Weights are learnt by
follow-the-regularised-leader with elastic-net penalties, and a temperature fitted on rows kept apart calibrates scores.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Payload, row_type, sliced

BUCKETS = 1 << 15
#: Labelled rows that are fitted on, at most, for each label: the ones whose hashed doc_id comes first.
TRAIN_ROWS_PER_LABEL = 500
SCALE = 100.0
_MUL = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


@lru_cache(1)
def _letters() -> np.ndarray:
    """Of each code point: its lower case if it is a letter, else a blank."""
    out = np.full(0x110000, 32, np.uint32)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of all n-grams, ends of the texts in them, whether each text has a letter)."""
    joined = "\0".join([*texts, ""])
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    seps = np.cumsum(sizes + 1) - 1
    c = _letters()[cp]
    c[seps] = 32
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    starts = np.concatenate(([0], seps[:-1] + 1))[: len(texts)]
    keep[starts] = c[starts] != 32  # no text opens with a blank
    keep[seps] = True
    before = np.concatenate(([0], np.cumsum(keep)))
    c = c[keep]
    ends = before[seps + 1]  # each text runs to its separator, which counts as its last blank
    first = np.concatenate(([0], ends[:-1]))
    letters = np.concatenate(([0], np.cumsum(c != 32)))
    has = letters[ends] > letters[first]
    n = len(c)
    doc_end = np.repeat(ends, ends - first) if n else np.empty(0, np.int64)
    at = np.arange(n)
    h = c * np.uint32(_MUL[0])
    cols, valid = [(h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1)], [c != 32]
    for k in (1, 2):
        nxt = np.zeros(n, np.uint32)
        nxt[: n - k] = c[k:]
        h = (h ^ (nxt + np.uint32(0x7F4A7C15))) * np.uint32(_MUL[k])
        cols.append((h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1))
        valid.append(at + k < doc_end)
    buckets, ok = np.stack(cols, 1), np.stack(valid, 1)
    counts = np.concatenate(([0], np.cumsum(ok.sum(axis=1))))
    return buckets[ok].astype(np.int64), counts[np.concatenate(([0], ends))], has


@dataclass
class Model:
    """Weights (bucket x label) that already hold the inverse document frequencies, biases, and the temperature."""

    labels: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Label and calibrated probability of each text; `und` and 0 without a letter or a label."""
        labels, scores = ["und"] * len(texts), np.zeros(len(texts))
        if not texts or not self.labels:
            return labels, scores
        buckets, ends, has = ngrams(texts)
        live = np.flatnonzero(has)
        if not len(live):
            return labels, scores
        sums = np.add.reduceat(self.weights[buckets], ends[:-1][live], axis=0)  # texts without letters own no or blank n-grams
        n = np.diff(ends)[live]
        if len(live) < len(texts):  # reduceat runs to the next live text: sum those again by their own ends
            sums = np.stack([self.weights[buckets[ends[i] : ends[i + 1]]].sum(axis=0) for i in live])
        z = (sums.astype(float) / n[:, None] * SCALE + self.bias) / self.temperature
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        for i, b in zip(live, best):
            labels[i] = self.labels[b]
        scores[live] = p[np.arange(len(live)), best]
        return labels, scores


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_labels: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.05, l2: float = 0.05, epochs: int = 4, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases after proximal FTRL over rows of (bucket, value)."""
    z, s = np.zeros((BUCKETS + 1, n_labels)), np.zeros((BUCKETS + 1, n_labels))

    def weights(at) -> np.ndarray:
        a = z[at]
        return np.where(np.abs(a) <= l1, 0.0, -(a - np.sign(a) * l1) / ((beta + np.sqrt(s[at])) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)
            w = weights(at)
            logits = x @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = x[:, None] * p
            step = (np.sqrt(s[at] + g * g) - np.sqrt(s[at])) / alpha
            z[at] += g - step * w
            s[at] += g * g
    w = weights(slice(None))
    return w[:-1], w[-1]


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least cross-entropy."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        q = logits / t
        q = q - q.max(axis=1, keepdims=True)
        return float((np.log(np.exp(q).sum(axis=1)) - q[np.arange(len(y)), y]).mean())

    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    return float(grid[np.argmin([loss(t) for t in grid])])


def _features(text: str) -> tuple[np.ndarray, np.ndarray]:
    buckets, _, _ = ngrams([text])
    at, n = np.unique(buckets, return_counts=True)
    return at, n / max(1, len(buckets))


def fit(train: DataFrame, rows_per_label: int = TRAIN_ROWS_PER_LABEL) -> Model:
    """A model from (doc_id, text, lang) rows; rows with a null text or lang are passed over.

    Document frequencies count all rows. Weights are fitted on rows_per_label rows at most of each label, a fifth of which set the
    temperature only. Without usable rows the model knows no label.
    """
    train = train.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        for batch in sliced(batches, "text", 1 << 20):
            buckets, ends, _ = ngrams(batch.column("text").to_pylist())
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                df += np.bincount(buckets[a:b], minlength=BUCKETS) > 0
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS + 1)), pa.array(np.append(df, n))], ["bucket", "n"])

    df = np.zeros(BUCKETS + 1, np.int64)
    for bucket, n in train.select("text").mapInArrow(frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():  # a row for each bucket
        df[bucket] = n
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 0.1

    # a hash keeps about twice the rows that are asked for, whatever the label's share, before any are ranked
    sizes = train.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    # a row for each label, of which the sample below holds rows_per_label: fit to broadcast
    near = train.select("doc_id", "lang").join(F.broadcast(sizes), "lang").withColumn("h", F.pmod(F.xxhash64("doc_id"), F.col("n"))).where(F.col("h") < 2 * rows_per_label + 100)
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    picked = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= rows_per_label)
    sample = train.join(F.broadcast(picked.select("doc_id", "r").dropDuplicates(["doc_id"])), "doc_id")  # at most rows_per_label rows of each label

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 1 << 20):
            found = [_features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("r").cast(pa.int64()), pa.array([a.astype("<i4").tobytes() for a, _ in found], pa.binary()), pa.array([x.astype("<f4").tobytes() for _, x in found], pa.binary())], ["lang", "r", "at", "x"])

    rows = sample.select("text", "lang", "r").mapInArrow(features, "lang string, r long, at binary, x binary").orderBy("r", "lang", "at").collect()
    labels = sorted({r["lang"] for r in rows})
    if not labels:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0)
    number = {x: i for i, x in enumerate(labels)}
    y = np.array([number[r["lang"]] for r in rows])
    sparse = [((a := np.frombuffer(r["at"], "<i4").astype(np.int64)), np.frombuffer(r["x"], "<f4") * idf[a] * SCALE) for r in rows]
    held = np.array([r["r"] % 5 == 0 for r in rows])
    w, bias = ftrl([s for s, h in zip(sparse, held, strict=True) if not h], y[~held], len(labels))
    logits = np.array([x @ w[a] + bias for (a, x), h in zip(sparse, held, strict=True) if h]).reshape(-1, len(labels))
    return Model(labels, (w * idf[:, None]).astype(np.float32), bias, _temperature(logits, y[held]))


def predict(df: DataFrame, model: Model, text_col: str = "text", label_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """All columns of df, lang_pred string and score double (0 to 1), from the whole text alone.

    A null text, or one without a letter, is `und` with score 0, as is every text for a model without labels. Existing columns of
    those names (in any case) are replaced, others may have any name; rows keep their number.
    """
    held = Payload(df, (label_col, score_col))
    row = held.df.select(held.row(), held[text_col].cast("string").alias("text"))
    schema = f"{row_type(row)}, label string, score double"

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 1 << 20):
            labels, scores = model.predict([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(labels, pa.string()), pa.array(scores)], ["row", "label", "score"])

    return row.mapInArrow(label, schema).select(*held.back(), F.col("label").alias(label_col), F.col("score").alias(score_col))


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id's decimal text, modulo 3."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3

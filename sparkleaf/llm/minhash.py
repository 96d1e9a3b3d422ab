"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations of a universe of 2^20 slots make all coordinates of a signature: a shingle's slot is moved by the first,
and coordinate k is the least value that the second, shifted circularly by k, gives to the moved slots. Bands of
coordinates become bucket keys. Texts with the same shingle set are one class from the start; each bucket then pairs
its classes with its least one (tasks do so with their own members first, so a bucket leaves a task as one entry).

Pairs are sifted by short signatures (a byte of each coordinate), whose components are groups of documents that are alike.
Buckets that still hold several groups have their members' short signatures compared in tiles of bounded size. Only then do
texts move, once for each document: to its group, in which all members are compared by their full sets, in tiles of bounded
size too. So a pair that shares many buckets is confirmed once, and no link is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, WordHashes, as_bytes, blob_column, bounds, discard, mixed, parts_for, releasing, rolled, settle, sliced, unblob
from .components import components

SLOTS, SEED = 1 << 20, 20
ROWS, BANDS = 5, 40
#: Entries that a task gathers before it passes them on.
TASK_ENTRIES = 500_000
#: Rows of a block of short signatures; documents and shingles of a block of full sets; documents that meet all blocks of a group.
SIFT_ROWS, TILE_ROWS, TILE_SHINGLES, CENTRES = 4_096, 1_024, 1_000_000, 128
#: Standard deviations below the threshold at which a pair of short signatures is passed over.
SIGMAS = 5.6
_BASE = 0x9FB21C651E98DF25


@lru_cache(2)
def _permutations(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and the second as windows of `coordinates` neighbouring values, wrapped round."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    sigma, pi = rng.permutation(SLOTS).astype(np.uint32), rng.permutation(SLOTS).astype(np.uint32)
    return sigma, np.lib.stride_tricks.sliding_window_view(np.concatenate((pi, pi[: coordinates - 1])), coordinates)


def shingles(text: bytes, size: int, hashes_of: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles: A-Z in lower case, words cut at ASCII white space.

    Fewer words than size: the whole sequence as one shingle; no word: none.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, U64)
    n = min(size, len(words))
    return np.unique(mixed(rolled(hashes_of(words), n, _BASE) + U64(n)))


def signature(found: np.ndarray, coordinates: int) -> np.ndarray:
    """The coordinates of a non-empty shingle set."""
    sigma, windows = _permutations(coordinates)
    slots = sigma[(found & U64(SLOTS - 1)).astype(np.int64)]
    step = max(1, (1 << 20) // coordinates)
    out = windows[slots[:step]].min(axis=0)
    for i in range(step, len(slots), step):
        np.minimum(out, windows[slots[i : i + step]].min(axis=0), out=out)
    return out


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """64-bit bucket keys, one for each band, of a matrix of signatures."""
    n, k = signatures.shape
    parts = signatures.reshape(n, k // rows, rows).astype(U64)
    keys = np.broadcast_to(np.arange(k // rows, dtype=U64), (n, k // rows)).copy()
    for j in range(rows):
        keys = mixed(keys * U64(_BASE) + parts[:, :, j])
    return keys


def signed(docs: DataFrame, shingle_words: int, rows: int, bands: int) -> DataFrame:
    """(doc_id, n_shingles, digest, short, keys): set size, 128-bit digest of the set, a byte of each coordinate, bucket keys."""
    schema = "doc_id long, n_shingles long, digest binary, short binary, keys binary"
    k = rows * bands

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes_of = WordHashes()
        for batch in sliced(batches, "text"):
            sets = [shingles(t or b"", shingle_words, hashes_of) for t in as_bytes(batch.column("text"))]
            full = [i for i, s in enumerate(sets) if len(s)]
            signatures = np.array([signature(sets[i], k) for i in full], np.uint32).reshape(len(full), k)
            keys = [None] * len(sets)
            digests, short = list(keys), list(keys)
            for i, key, low in zip(full, band_keys(signatures, rows), signatures.astype(np.uint8), strict=True):
                keys[i], digests[i], short[i] = key.tobytes(), xxhash.xxh3_128_digest(sets[i].tobytes()), low.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, sets), pa.int64()), *(pa.array(x, pa.binary()) for x in (digests, short, keys))], ["doc_id", "n_shingles", "digest", "short", "keys"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(releasing(sign), schema)


def _dealt(keys: np.ndarray, values: list[np.ndarray], parts: int) -> pa.RecordBatch:
    """Rows (part, keys, v0, v1): blobs of the entries that belong to each part."""
    part = (keys % U64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = bounds(part)
    blobs = [blob_column(v[order], cuts) for v in values]
    blobs += [pa.nulls(len(cuts) - 1, pa.binary())] * (2 - len(blobs))
    return pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]]), blob_column(keys[order], cuts), *blobs], ["part", "keys", "v0", "v1"])


_ENTRY = "part int, keys binary, v0 binary, v1 binary"


def _gathered(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bucket keys with the value of `column` of the row that each is from, about TASK_ENTRIES at a time."""
    keys, values, n = [], [], 0
    for batch in batches:
        step = max(1, TASK_ENTRIES // 64)
        for lo in range(0, batch.num_rows, step):
            part = batch.slice(lo, step)
            found = unblob(part.column("keys"), U64)
            if len(found):
                keys.append(found)
                values.append(np.repeat(np.asarray(part.column(column)).astype(np.int64), len(found) // part.num_rows))
                n += len(found)
            if n >= TASK_ENTRIES:
                yield np.concatenate(keys), np.concatenate(values)
                keys, values, n = [], [], 0
    if n:
        yield np.concatenate(keys), np.concatenate(values)


def _stars(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with their least id, and the distinct pairs (least id, other id)."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    cuts = bounds(keys)
    least = np.repeat(ids[cuts[:-1]], np.diff(cuts))
    other = ids != least
    a, b = least[other], ids[other]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return keys[cuts[:-1]], ids[cuts[:-1]], a[new], b[new]


def bucket_pairs(reps: DataFrame, parts: int) -> DataFrame:
    """Distinct (a, b), a < b: each class with the least one of its own that shares a bucket key, over tasks and then over all."""

    def pair_rows(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        part = (mixed(a.astype(U64)) % U64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        cuts = bounds(part[order])
        return pa.RecordBatch.from_arrays([pa.array(part[order][cuts[:-1]]), pa.nulls(len(cuts) - 1, pa.binary()), blob_column(a[order], cuts), blob_column(b[order], cuts)], ["part", "keys", "v0", "v1"])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids in _gathered(batches, "doc_id"):
            keys, least, a, b = _stars(keys, ids)
            yield _dealt(keys, [least], parts)
            if len(a):
                yield pair_rows(a, b)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids = [np.empty(0, U64)], [np.empty(0, np.int64)]
        for batch in batches:
            pairs = batch.filter(batch.column("keys").is_null())
            if pairs.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(unblob(pairs.column("v0"), np.int64)), pa.array(unblob(pairs.column("v1"), np.int64))], ["a", "b"])
            rest = batch.filter(batch.column("keys").is_valid())
            keys.append(unblob(rest.column("keys"), U64))
            ids.append(unblob(rest.column("v0"), np.int64))
        _, _, a, b = _stars(np.concatenate(keys), np.concatenate(ids))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    dealt = reps.select("doc_id", "keys").mapInArrow(releasing(local), _ENTRY)
    return dealt.repartitionById(parts, F.col("part")).mapInArrow(releasing(merged), "a long, b long").distinct()


def open_buckets(members: DataFrame, parts: int) -> DataFrame:
    """Keys of the buckets of (doc_id, component, keys) that hold classes of several components."""

    def pairs(keys: np.ndarray, comps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((comps, keys))
        keys, comps = keys[order], comps[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (comps[1:] != comps[:-1])
        return keys[new], comps[new]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, comps in _gathered(batches, "component"):
            keys, comps = pairs(keys, comps)
            yield _dealt(keys, [comps], parts)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(unblob(b.column("keys"), U64), unblob(b.column("v0"), np.int64)) for b in batches]
        if held:
            keys, _ = pairs(*(np.concatenate(x) for x in zip(*held, strict=True)))
            again = keys[1:][keys[1:] == keys[:-1]]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(again).view(np.int64))], ["key"])

    dealt = members.select("component", "keys").mapInArrow(releasing(local), _ENTRY)
    return dealt.repartitionById(parts, F.col("part")).mapInArrow(releasing(merged), "key long")


def alike(a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """Whether rows of short signatures agree in `least` coordinates or more."""
    return (a == b).sum(axis=-1) >= least


def sift_floor(coordinates: int, percent: int) -> int:
    """Equal coordinates that a pair of the threshold's similarity reaches but for SIGMAS standard deviations."""
    p = percent / 100
    return max(0, math.floor(coordinates * p - SIGMAS * math.sqrt(coordinates * p * (1 - p))))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)


def sifted(pairs: DataFrame, about: DataFrame, least: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and short signatures let them be similar; about: (id, n_shingles, short)."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, m = (np.asarray(batch.column(c)).astype(np.int64) for c in ("n_a", "n_b"))
                keep = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & alike(_matrix(batch.column("short_a")), _matrix(batch.column("short_b")), least)
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    left = about.select(F.col("id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("short").alias("short_a"))
    right = about.select(F.col("id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("short").alias("short_b"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(releasing(check), "a long, b long").distinct()


def cross_tiles(members: DataFrame, rows: int, weight: int) -> DataFrame:
    """Rows (set, low, high, left, right, id) that bring together every two members of a set in different components.

    members: (set, id, component, weight). The largest component's members need only meet the others. So the others are dealt
    into `low` blocks, all members into `high` blocks, and each tile (set, low, high) gets its two blocks, as left and right
    rows: `rows` rows and `weight` of summed weights a block on average. A set of one block is one tile, each row in it once.
    Sets of one component are left out.
    """
    of = members.groupBy("set", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))
    of = of.groupBy("set").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.max(F.struct("n", "w", "component")).alias("main"), F.count(F.lit(1)).alias("c")).where("c > 1")

    def blocks(n: Column, w: Column) -> Column:
        return F.greatest(F.ceil(n / rows), F.ceil(w / weight)).cast("int")

    of = of.select("set", F.col("main.component").alias("main"), blocks(F.col("n") - F.col("main.n"), F.col("w") - F.col("main.w")).alias("lows"), blocks(F.col("n"), F.col("w")).alias("highs"))
    dealt = members.join(of, "set").withColumn("other", F.col("component") != F.col("main"))
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    one = F.array(F.struct(F.lit(0).alias("low"), F.lit(0).alias("high"), F.col("other").alias("left"), F.lit(True).alias("right")))
    as_right = F.transform(F.sequence(F.lit(0), F.col("lows") - 1), lambda i: F.struct(i.alias("low"), block("highs").alias("high"), F.lit(False).alias("left"), F.lit(True).alias("right")))
    as_left = F.transform(F.sequence(F.lit(0), F.col("highs") - 1), lambda i: F.struct(block("lows").alias("low"), i.alias("high"), F.lit(True).alias("left"), F.lit(False).alias("right")))
    places = F.when(F.col("highs") == 1, one).when(F.col("other"), F.concat(as_right, as_left)).otherwise(as_right)
    return dealt.select("set", "id", "component", F.explode(places).alias("at")).select("set", "at.*", "id", "component")


def _joined(comps: np.ndarray, i: int, at: np.ndarray) -> np.ndarray:
    """One of the rows `at` for each of their components; the components then count as that of row i."""
    found, first = np.unique(comps[at], return_index=True)
    comps[np.isin(comps, found)] = comps[i]
    return at[first]


def _edges(found: list[tuple[int, np.ndarray]], ids: np.ndarray) -> pa.Table:
    a = [np.full(len(at), ids[i]) for i, at in found]
    return pa.table({"a": np.concatenate([np.empty(0, np.int64), *a]), "b": np.concatenate([np.empty(0, np.int64), *(ids[at] for _, at in found)])})


def alike_in_buckets(reps: DataFrame, groups: DataFrame, open_keys: DataFrame, least: int, percent: int) -> DataFrame:
    """(a, b): as few pairs as join the components of open buckets whose members' sizes and short signatures are alike."""

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = unblob(batch.column("keys"), np.int64)
            if len(keys):
                each = np.repeat(np.arange(batch.num_rows), len(keys) // batch.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(np.asarray(batch.column(c))[each]) for c in ("id", "component"))], ["set", "id", "component"])

    def compare(rows: pa.Table) -> pa.Table:
        ids, comps, n = (rows[c].to_numpy().astype(np.int64) for c in ("id", "component", "n_shingles"))
        short, right, found = _matrix(rows["short"]), np.flatnonzero(rows["right"].to_numpy()), []
        for i in np.flatnonzero(rows["left"].to_numpy()):
            at = right[(comps[right] != comps[i]) & (100 * np.minimum(n[right], n[i]) >= percent * np.maximum(n[right], n[i]))]
            at = at[alike(short[at], short[i], least)] if len(at) else at
            if len(at):
                found.append((i, _joined(comps, i, at)))
        return _edges(found, ids)

    about = reps.select(F.col("doc_id").alias("id"), "n_shingles", "short", "keys").join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    members = about.select("id", "component", "keys").mapInArrow(releasing(exploded), "set long, id long, component long")
    members = settle(members.join(open_keys.withColumnRenamed("key", "set"), "set", "left_semi").distinct().withColumn("weight", F.lit(0)), "members")
    tiles = cross_tiles(members, SIFT_ROWS, 1).join(about.select("id", "n_shingles", "short"), "id")
    out = settle(tiles.groupBy("set", "low", "high").applyInArrow(compare, "a long, b long").distinct(), "alike")
    discard(members)
    return out


def confirmed(tiles: DataFrame, texts: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """(a, b): as few links as join the components of each tile whose members' full shingle sets are similar.

    Similar: 100 * intersection >= percent * union. tiles: as from cross_tiles; texts: (id, text).
    """

    def confirm(rows: pa.Table) -> pa.Table:
        hashes_of = WordHashes()
        sets = [shingles(t or b"", shingle_words, hashes_of) for t in as_bytes(rows["text"].combine_chunks())]
        ids, comps = (rows[c].to_numpy().astype(np.int64) for c in ("id", "component"))
        n = np.fromiter(map(len, sets), np.int64, len(sets))
        right = np.flatnonzero(rows["right"].to_numpy() & (n > 0))
        left = np.flatnonzero(rows["left"].to_numpy() & (n > 0))
        if not len(left) or not len(right):
            return _edges([], ids)
        vocabulary, number = np.unique(np.concatenate(sets), return_inverse=True)
        number, ends = number.astype(np.int32), np.cumsum(n)
        del sets
        held = np.zeros(len(vocabulary), np.int8)
        all_right = np.concatenate([number[ends[j] - n[j] : ends[j]] for j in right])
        starts, found = np.cumsum(n[right]) - n[right], []
        for i in left:
            at = np.flatnonzero((comps[right] != comps[i]) & (100 * np.minimum(n[right], n[i]) >= percent * np.maximum(n[right], n[i])))
            if not len(at):
                continue
            own = number[ends[i] - n[i] : ends[i]]
            held[own] = 1
            if 2 * len(at) > len(right):
                both = np.add.reduceat(held[all_right], starts, dtype=np.int64)[at]
            else:
                both = np.fromiter((held[all_right[starts[j] : starts[j] + n[right[j]]]].sum(dtype=np.int64) for j in at), np.int64, len(at))
            held[own] = 0
            at = right[at[100 * both >= percent * (n[right[at]] + n[i] - both)]]
            if len(at):
                found.append((i, _joined(comps, i, at)))
        return _edges(found, ids)

    return tiles.join(texts, "id").groupBy("set", "low", "high").applyInArrow(confirm, "a long, b long").distinct()


def links_in_groups(groups: DataFrame, sizes: DataFrame, texts: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """(id, component): components under confirmed links inside groups of documents that are alike.

    groups: (id, component), sizes: (id, weight), texts: (id, text). Each document goes to one tile of its group, in which all are
    compared, with some of the group's documents sent to every tile. Groups of several tiles then have their remaining components compared
    in cross tiles, so that no link is lost.
    """
    members = groups.withColumnRenamed("component", "set").join(sizes, "id")
    of = members.groupBy("set").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))
    of = of.withColumn("blocks", F.greatest(F.ceil(F.col("n") / TILE_ROWS), F.ceil(F.col("w") / TILE_SHINGLES)).cast("int"))
    members = settle(members.join(of, "set"), "group-members")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    centre = F.pmod(F.xxhash64("id", F.lit(7)), F.col("n")) < CENTRES
    places = F.when((F.col("blocks") > 1) & centre, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))
    tiles = members.select("set", F.lit(0).alias("low"), F.explode(places).alias("high"), F.lit(True).alias("left"), F.lit(True).alias("right"), "id", F.col("id").alias("component"))
    links = settle(confirmed(tiles, texts, shingle_words, percent), "links")
    found = components(links)
    large = members.where("blocks > 1")
    if not large.isEmpty():
        large = settle(large.join(found, "id", "left").select("set", "id", F.coalesce("component", "id").alias("component"), "weight"), "large")
        more = settle(confirmed(cross_tiles(large, TILE_ROWS, TILE_SHINGLES), texts, shingle_words, percent), "more-links")
        if not more.isEmpty():
            found = components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more))
        discard(large, more)
    discard(members, links)
    return found


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): the component of each document under links of similar shingle sets.

    Words: runs of other characters than ASCII white space, A-Z in lower case. A set: the distinct shingles of shingle_words
    words; with fewer words, the whole sequence as one; empty without words or text, and then linked with nothing. Linked:
    100 * intersection >= percent * union, on full sets. component_id: the smallest doc_id reachable. kept: the document is
    it. A link of similarity 0.8 fails to share a bucket, or to be alike in 128 of 200 coordinates, with a chance of about 1e-7 each
    (5 rows, 40 bands). A null doc_id links with nothing: its component is null and it is kept. Rows of one doc_id that have
    words count as linked. Other columns aren't read.
    """
    spark, coordinates = docs.sparkSession, rows * bands
    least = sift_floor(coordinates, percent)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = settle(signed(base, shingle_words, rows, bands), "signatures")
    live = table.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    classes = settle(live.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    mine = live.join(classes.select(F.col("rep").alias("doc_id"), "digest"), ["doc_id", "digest"], "left_semi")
    reps = settle(mine.groupBy("doc_id", "digest").agg(*[F.first(c).alias(c) for c in ("n_shingles", "short", "keys")]), "reps")
    about = reps.select(F.col("doc_id").alias("id"), "n_shingles", "short")
    parts = parts_for(spark, reps.count() * bands)
    pairs = settle(bucket_pairs(reps, parts), "pairs")
    stars = settle(sifted(pairs, about, least, percent), "stars")
    groups = components(stars)
    with_group = reps.join(groups, reps["doc_id"] == groups["id"], "left").select("doc_id", "keys", F.coalesce("component", "doc_id").alias("component"))
    keys = settle(open_buckets(with_group, parts), "open")
    more = alike_in_buckets(reps, groups, keys, least, percent)
    several = live.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("doc_id")
    several = settle(live.join(several, "doc_id", "left_semi").join(classes, "digest").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct(), "several")
    if not more.isEmpty():
        groups = components(groups.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more))
    sizes = reps.groupBy(F.col("doc_id").alias("id")).agg(F.sum("n_shingles").alias("weight"))
    texts = settle(base.withColumnRenamed("doc_id", "id").join(groups.select("id"), "id", "left_semi"), "texts")
    found = links_in_groups(groups, sizes, texts, shingle_words, percent)
    if not several.isEmpty():
        found = components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(several))
    discard(pairs, stars, keys, more, several, reps, texts)
    found = found.select(F.col("id").alias("rep"), "component")
    out = table.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left").join(found, "rep", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "rep", "doc_id")).cast("long")
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

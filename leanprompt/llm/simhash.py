"""SimHash near-duplicates by tiled exact comparison (operator 2).

Fingerprints are compared exactly: distinct ones are dealt into tiles of bounded size by bands of their population
count, each pair of tiles within reach is one task, and there blocks whose population counts (whole and by 16-bit
parts) differ by more than the radius are skipped; the others are compared with exclusive-or and bit counts. A pair of
tiles gives the edges of a spanning forest of its links, not all pairs, and components are contracted from those. Equal
fingerprints are one vertex, so that groups of copies cost nothing.

Empty texts, and texts without words, have fingerprint zero and are linked like any other. Rows with a null doc_id get
a fingerprint but no component (null). Repeated rows give repeated results; an empty table an empty one.

To drop near-duplicates (Jaccard similarity of the sets of five-word shingles at least 0.8), population counts skip next to
nothing: at that similarity the radius is a seventh of the bits. There tiles are formed of documents that share a bucket
of a min-hash (BANDS keys of ROWS minima each), so that their number grows with the documents; a pair at the similarity
shares no bucket with probability (1 - s ** ROWS) ** BANDS, 7e-4 at 0.8 and 1e-5 at 0.85. Within a tile nothing is lost:
close fingerprints are verified first and join most classes, and all other pairs of different classes that can be similar
(by a prefix filter, which is exact) are verified by the exact Jaccard similarity of their sets.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batch, documents, keep, trim
from .components import components

TILE = 131_072  # fingerprints a tile: two are 4 MB, and larger tiles are copied to fewer pairs and prune better
SET_TILE, SET_BYTES = 2_048, 12 << 20  # the same where each fingerprint comes with its set of shingles, and bytes of those
BANDS, ROWS = 24, 6  # of the min-hash
SEED = 5
BLOCK = 256  # fingerprints a block within a tile
MANY = 1 << 16  # shingles held at once
BITS = 27  # of the bitmap that spares rows a shuffle: 16 MB


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of size words of the lower-cased text, the whole sequence if shorter, none if empty."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    h = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([h(line, 42)], np.uint64)
    n = len(words) - size + 1
    return np.fromiter((h(line[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[size - 1 :].tolist())), np.uint64, n)


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further 64-bit hash from a first one (the splitmix64 finaliser)."""
    z = h + np.uint64((0x9E3779B97F4A7C15 * k) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def bits_of(h: np.ndarray, words: int = 1) -> bytes:
    """Big-endian; a bit is 1 if set in more than half the hashes. Beyond 64 bits, further hashes of each."""
    if not len(h):
        return bytes(8 * words)
    sums = np.zeros(64 * words, np.int64)
    for a in range(0, len(h), MANY):
        part = h[a : a + MANY]
        for k in range(words):
            bits = (mixed(part, k) if k else part).astype(">u8").view(np.uint8).reshape(-1, 8)
            sums[64 * k : 64 * (k + 1)] += np.unpackbits(bits, axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * sums > len(h)).tobytes()


def fingerprint(text: bytes, size: int, words: int = 1) -> bytes:
    """Of the text's shingles, each as often as it occurs."""
    return bits_of(shingle_hashes(text, size), words)


def fingerprints(docs: DataFrame, size: int, words: int) -> DataFrame:
    """doc_id, fp (binary) and its population count."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            fps = [fingerprint(t.encode(), size, words) if t else bytes(8 * words) for t in batch.column(1).to_pylist()]
            return {"doc_id": batch.column(0), "fp": fps, "pop": [int.from_bytes(f).bit_count() for f in fps]}

        return step

    return by_batch(docs.select("doc_id", "text"), "doc_id long, fp binary, pop int", make)


class Forest:
    """Union-find over positions; vectorised where most new links are within one class already."""

    def __init__(self, n: int):
        self.of = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.of[i], self.of[j]
            new = np.flatnonzero(a != b)
            if not len(new):
                return
            i, j, a, b = i[new], j[new], a[new], b[new]
            # each class hooks to one smaller class at a time: at least one link a round is used up
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            _, first = np.unique(hi, return_index=True)
            self.edges += zip(i[first].tolist(), j[first].tolist())
            to = np.arange(len(self.of))
            to[hi[first]] = lo[first]
            while True:
                up = to[to]
                if (up == to).all():
                    break
                to = up
            self.of = to[self.of]


def blocks(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the fingerprints by population counts, and by block the least and the most in each 16-bit part."""
    parts = np.bitwise_count(fps.view(np.uint16).reshape(len(fps), -1)).astype(np.int16)
    keys = parts[:, :8]
    order = np.lexsort([*(keys[:, k] for k in range(keys.shape[1])), keys[:, : keys.shape[1] // 2].sum(1), keys.sum(1)])
    at = np.arange(0, len(fps), BLOCK)
    parts = parts[order]
    return order, np.minimum.reduceat(parts, at), np.maximum.reduceat(parts, at)


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int, same: bool):
    """Yields arrays (i, j) of all links between the rows of a and of b (n x words, uint64); each once where same."""
    if not len(a) or not len(b):
        return
    oa, low_a, high_a = blocks(a)
    ob, low_b, high_b = (oa, low_a, high_a) if same else blocks(b)
    a, b = np.ascontiguousarray(a[oa].T), np.ascontiguousarray(b[ob].T)
    for x in range(len(low_a)):
        apart = np.maximum(0, np.maximum(low_b - high_a[x], low_a[x] - high_b)).sum(1)
        near = np.flatnonzero(apart <= radius)
        if same:
            near = near[near >= x]
        left = a[:, x * BLOCK : (x + 1) * BLOCK]
        for y in near:
            right = b[:, y * BLOCK : (y + 1) * BLOCK]
            d = np.bitwise_count(left[0][:, None] ^ right[0])
            if a.shape[0] > 3:
                d = d.astype(np.uint16)
            for w in range(1, a.shape[0]):
                d += np.bitwise_count(left[w][:, None] ^ right[w])
            i, j = np.nonzero(d <= radius)
            if same and x == y:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield oa[i + x * BLOCK], ob[j + y * BLOCK]


def links(points: DataFrame, bits: int, radius: int, tile: int = TILE) -> DataFrame:
    """Edges (u, v) of spanning forests of the links among points(id long, fp binary, pop int) of distinct fp.

    A band holds max(radius, 1) population counts, so that links reach no further than the next band. What the driver
    gets is the size of each band, bits / radius numbers. A band's fingerprints are dealt by hash into tiles of about
    `tile`, however many there are of one population count.
    """
    width = max(radius, 1)
    sizes = {r["band"]: r["count"] for r in points.groupBy(F.floor(F.col("pop") / width).alias("band")).count().collect()}
    if not sizes:
        return points.select(F.col("id").alias("u"), F.col("id").alias("v")).limit(0)
    tiles = {b: math.ceil(n / tile) for b, n in sizes.items()}
    first, total = {}, 0
    for b in sorted(tiles):
        first[b], total = total, total + tiles[b]
    top = max(tiles) + 2
    begin = F.array(*[F.lit(first.get(b, 0)) for b in range(top)])
    count = F.array(*[F.lit(tiles.get(b, 0)) for b in range(top)])
    band = F.floor(F.col("pop") / width).cast("int")
    own = F.element_at(begin, band + 1) + F.pmod(F.xxhash64("fp"), F.element_at(count, band + 1)).cast("int")
    reach = [F.when(F.element_at(count, k + 1) > 0, F.sequence(F.element_at(begin, k + 1), F.element_at(begin, k + 1) + F.element_at(count, k + 1) - 1)).otherwise(F.array().cast("array<int>")) for k in (F.greatest(band - 1, F.lit(0)), band, band + 1)]
    others = F.array_distinct(F.concat(*reach))
    dealt = points.select("id", "fp", own.alias("own"), F.explode(others).alias("other"))
    dealt = dealt.select("id", "fp", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") > F.col("other")).alias("right"))

    def forest(t: pa.Table) -> pa.Table:
        ids = t.column("id").to_numpy()
        fps = np.frombuffer(b"".join(t.column("fp").to_pylist()), np.uint64).reshape(len(ids), -1)
        right = t.column("right").to_numpy()
        same = t.column("a")[0].as_py() == t.column("b")[0].as_py()
        pa_, pb = np.flatnonzero(~right), np.flatnonzero(right)
        pb = pa_ if same else pb
        f = Forest(len(ids))
        for i, j in close_pairs(fps[pa_], fps[pb], radius, same):
            f.add(pa_[i], pb[j])
        u, v = np.array(f.edges, np.int64).reshape(-1, 2).T
        return pa.table({"u": ids[u], "v": ids[v]})

    return dealt.groupBy("a", "b").applyInArrow(forest, "u long, v long")


def near_duplicates(docs: DataFrame, size: int = 4, words: int = 1, radius: int = 4, tile: int = TILE) -> DataFrame:
    """doc_id, fp (binary) and component_id, the smallest doc_id reachable over fingerprints within the radius."""
    prints = keep(fingerprints(docs, size, words))
    points = keep(prints.where("doc_id is not null").groupBy("fp", "pop").agg(F.min("doc_id").alias("id")))
    roots = components(links(points, 64 * words, radius, tile)).select(F.col("u").alias("id"), "root")
    named = points.join(roots, "id", "left").select("fp", F.coalesce("root", "id").alias("component_id"))
    out = prints.join(named, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays without repeats; two empty sets are equal."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    same = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return same / (len(a) + len(b) - same)


def min_hash_keys(h: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key for each band of the min-hash of distinct shingle hashes; equal sets have equal keys, an empty set none."""
    if not len(h):
        return np.empty(0, np.int64)
    r = np.random.default_rng(SEED)
    factor = r.integers(1, 1 << 62, bands * rows).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    shift = r.integers(0, 1 << 62, bands * rows).astype(np.uint64)
    least = np.full(bands * rows, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for a in range(0, len(h), 512):  # blocks that stay in the cache
        np.minimum(least, (h[a : a + 512, None] * factor + shift).min(axis=0), out=least)
    least = least.reshape(bands, rows)
    keys = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        keys = mixed(keys ^ least[:, k], k + 1)
    return keys.view(np.int64)


def set_prints(docs: DataFrame, size: int, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, digest of the set of shingle hashes, its size, its fingerprint and min-hash keys."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            out: dict = {"doc_id": batch.column(0), "digest": [], "n": [], "fp": [], "keys": []}
            for t in batch.column(1).to_pylist():
                h = np.unique(shingle_hashes((t or "").encode(), size))
                for k, v in (("digest", xxhash.xxh3_128_digest(h.tobytes())), ("n", len(h)), ("fp", bits_of(h, words)), ("keys", min_hash_keys(h, bands, rows))):
                    out[k].append(v)
            return out

        return step

    return by_batch(docs.select("doc_id", "text"), "doc_id long, digest binary, n int, fp binary, keys array<long>", make, rows=2_500)


def shingle_sets(rows: DataFrame, size: int) -> DataFrame:
    """id, fp and the sorted distinct shingle hashes (8 bytes each) of rows(id, digest, fp, text) whose set has that digest."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            sets = [np.unique(shingle_hashes((t or "").encode(), size)).tobytes() for t in batch.column(3).to_pylist()]
            fits = [k for k, (x, d) in enumerate(zip(sets, batch.column(1).to_pylist())) if xxhash.xxh3_128_digest(x) == d]
            return {"id": batch.column(0).take(pa.array(fits, pa.int64())), "fp": batch.column(2).take(pa.array(fits, pa.int64())), "set": [sets[k] for k in fits]}

        return step

    return by_batch(rows.select("id", "digest", "fp", "text"), "id long, fp binary, set binary", make, rows=1_000)


def marks(ids: DataFrame, salt: int):
    """A test of long columns: true for all that are in the one column of ids, and for few others.

    The bitmap has a fixed size, at most 2 ** (BITS - 6) words reach the driver, and many more ids than BITS holds only let
    more rows pass. Tests of different salt err on different values.
    """
    place = lambda x: F.shiftrightunsigned(F.xxhash64(F.col(x).cast("long"), F.lit(salt)), 64 - BITS)
    x = ids.select(place(ids.columns[0]).alias("x"))
    words = x.groupBy(F.expr("cast(x div 64 as int)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(x % 64 as int)))").alias("b"))
    got = keep(words).toArrow()
    bits = np.zeros(1 << (BITS - 6), np.int64)
    bits[got.column("w").to_numpy()] = got.column("b").to_numpy()
    shared = ids.sparkSession.sparkContext.broadcast(bits.view(np.uint64))

    @F.pandas_udf("boolean")
    def has(s: pd.Series) -> pd.Series:
        at = s.to_numpy(np.int64)
        return pd.Series((shared.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool))

    return lambda column: has(place(column))


def among(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """df without most rows whose column (long) is not in the one column of ids; it keeps all that are, and nulls may go.

    For use before a join, so that what finds no partner is not shuffled.
    """
    return df.where(marks(ids, 0)(column))


def without(df: DataFrame, column: str, gone: DataFrame, stay: DataFrame) -> DataFrame:
    """df without exactly the rows whose column (long, no nulls) is in the one column of gone; all others are in that of stay.

    Wide rows stay where they are: what a bitmap of gone does not mark stays, and of what it marks only values in doubt
    can stay, those of stay that it marks by mistake. Rows that a bitmap of these marks too are joined with them.
    """
    maybe = marks(gone, 0)
    doubt = keep(stay.select(F.col(stay.columns[0]).alias(column)).where(maybe(column)).distinct())
    out = df.where(~maybe(column))
    if doubt.isEmpty():
        return out
    return out.unionByName(df.where(maybe(column)).where(marks(doubt, 1)(column)).join(doubt, column, "left_semi"))


def prefix_pairs(sets: list[np.ndarray], of: np.ndarray, similarity: float):
    """Yields arrays (i, j) of pairs of different classes that hold all those with the similarity, some of them repeatedly.

    Sets of size n with Jaccard similarity s or more share one of their n - ceil(s n) + 1 first members in any common
    order; here the order puts what few of these sets have first, so that what they all have makes no pairs.
    """
    lengths = np.fromiter(map(len, sets), np.int64, len(sets))
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), lengths)
    _, member, df = np.unique(flat, return_inverse=True, return_counts=True)
    member = member.reshape(-1)
    order = np.lexsort((member, df[member], owner))
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    first = order[place < (lengths - np.ceil(similarity * lengths - 1e-9).astype(np.int64) + 1)[owner]]
    first = first[df[member[first]] > 1]
    first = first[np.argsort(member[first], kind="stable")]
    if not len(first):
        return
    cuts = np.flatnonzero(np.diff(member[first])) + 1
    wait, size = [], 0
    for posting in np.split(owner[first], cuts):
        if len(posting) == 1 or (of[posting] == of[posting[0]]).all():
            continue
        for k in range(len(posting) - 1):
            i, j = posting[k], posting[k + 1 :]
            j = j[(of[j] != of[i]) & (np.minimum(lengths[i], lengths[j]) >= similarity * np.maximum(lengths[i], lengths[j]) - 1e-9)]
            wait.append(np.minimum(i, j) * len(sets) + np.maximum(i, j))
            size += len(j)
            if size > 1 << 18:
                yield np.divmod(np.unique(np.concatenate(wait)), len(sets))
                wait, size = [], 0
    if size:
        yield np.divmod(np.unique(np.concatenate(wait)), len(sets))


class Classes:
    """Union-find over positions with the edges that joined two classes; of holds a representative of each position's class
    as of the last refresh()."""

    def __init__(self, classes: np.ndarray):
        _, first, of = np.unique(classes, return_index=True, return_inverse=True)
        self.up = first[of.reshape(-1)].tolist()
        self.edges: list[tuple[int, int]] = []
        self.tried: set[int] = set()
        self.refresh()

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def refresh(self) -> None:
        self.of = np.fromiter(map(self.find, range(len(self.up))), np.int64, len(self.up))

    def one(self) -> bool:
        return bool((self.of == self.of[0]).all())

    def verify(self, pairs, sets: list[np.ndarray], similarity: float) -> None:
        """Joins the classes of those pairs whose sets have the similarity; each pair is tried once."""
        for i, j in pairs:
            apart = self.of[i] != self.of[j]
            before = len(self.edges)
            for x, y in zip(i[apart].tolist(), j[apart].tolist()):
                a, b = self.find(x), self.find(y)
                if a != b and (code := min(x, y) * len(sets) + max(x, y)) not in self.tried:
                    if jaccard(sets[x], sets[y]) >= similarity:
                        self.up[max(a, b)] = min(a, b)
                        self.edges.append((x, y))
                    else:
                        self.tried.add(code)
            if len(self.edges) > before:
                self.refresh()


def similar_links(t: pa.Table, radius: int, similarity: float) -> pa.Table:
    """Edges (u, v) of a spanning forest over the classes `class` of the rows t(id, class, fp, set), all pairs considered."""
    ids, at = np.unique(t.column("id").to_numpy(), return_index=True)
    t = t.take(at).combine_chunks()
    f = Classes(t.column("class").to_numpy())
    if not f.one():
        fps = np.frombuffer(b"".join(t.column("fp").to_pylist()), np.uint64).reshape(len(ids), -1)
        column = t.column("set")
        sets = [np.frombuffer(column[k].as_buffer(), np.uint64) for k in range(len(ids))]
        f.verify(close_pairs(fps, fps, radius, True), sets, similarity)
        if not f.one():
            f.verify(prefix_pairs(sets, f.of, similarity), sets, similarity)
    u, v = np.array(f.edges, np.int64).reshape(-1, 2).T
    return pa.table({"u": ids[u], "v": ids[v]})


def verified_links(members: DataFrame, sets: DataFrame, radius: int, similarity: float, tile: int, pairs: bool) -> DataFrame:
    """Edges (u, v) of spanning forests of the links within the groups of members(id, group, class, n), sets(id, fp, set).

    Small groups share tasks. A group of more than tile rows, or more than SET_BYTES of sets, is dealt into tiles: with
    pairs each two of them are one task, without each tile is one, and holds the group's first member too.
    """
    room = F.greatest(F.ceil(F.count("*") / tile), F.ceil(F.sum(F.col("n").cast("long")) * 8 / SET_BYTES)).cast("int")
    shared = max(1, members.agg(room.alias("k")).first()["k"] or 0)
    groups = members.groupBy("group").agg(room.alias("tiles"))
    whole = F.col("tiles") <= 1
    own = F.pmod(F.xxhash64("id", F.lit(1)), F.col("tiles")).cast("int")
    all_tiles = F.sequence(F.lit(0), F.col("tiles") - 1)
    others = F.filter(all_tiles, lambda k: k != own) if pairs else F.when(F.col("id") == F.col("group"), all_tiles).otherwise(F.array(own))
    dealt = members.join(groups, "group").select("id", "class", whole.alias("whole"), F.when(whole, F.pmod(F.xxhash64("group"), F.lit(shared))).otherwise(F.col("group")).alias("g"), own.alias("own"), F.explode(F.when(whole, F.array(F.lit(0))).otherwise(others)).alias("other"))
    first, second = (F.least("own", "other"), F.greatest("own", "other")) if pairs else (F.col("other"), F.col("other"))
    dealt = dealt.select("id", "class", "whole", "g", F.when(F.col("whole"), 0).otherwise(first).alias("a"), F.when(F.col("whole"), 0).otherwise(second).alias("b")).distinct()

    def forest(t: pa.Table) -> pa.Table:
        try:
            return similar_links(t, radius, similarity)
        finally:
            trim()

    return keep(dealt).join(sets, "id").groupBy("whole", "g", "a", "b").applyInArrow(forest, "u long, v long")


def radius_of(similarity: float, bits: int) -> int:
    """The Hamming radius for a Jaccard similarity: sets of equal size have cosine 2s / (1 + s), and fingerprints differ in
    the angle's share of the bits. Half a standard deviation is added, so that most pairs at the similarity are within."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * share + 0.5 * math.sqrt(bits * share * (1 - share)))


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8, size: int = 5, words: int = 4, tile: int = SET_TILE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs without all but the smallest doc_id of each group of near-duplicates: documents linked by a Jaccard similarity
    of their sets of shingles of size words. Of rows that share a doc_id one stays; rows without doc_id stay. Columns are
    kept. Texts without words are equal to each other and to nothing else.

    Equal sets are one vertex. A vertex first meets the others whose least bucket-mate is the same (its leader), so that
    its set travels once; the links found contract the buckets, and buckets that then hold several classes not yet
    compared are compared whole. Of the texts, only those of linked documents are shuffled, and of the
    keys a second time only those of several vertices (see among()); the result is taken from docs by bitmaps, not by a
    shuffle of all texts (see without()).
    """
    radius = radius_of(similarity, 64 * words)
    prints = keep(set_prints(docs.where("doc_id is not null"), size, words, bands, rows))
    # a vertex is a set, by a number of its own: rows that share a doc_id can have several
    first = F.min_by(F.struct("n", "fp", "keys"), "doc_id")
    points = keep(prints.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), first.alias("p")).select(F.monotonically_increasing_id().alias("id"), "doc_id", "digest", "p.*"))
    dealt = points.select("id", F.explode("keys").alias("key"))
    heads = dealt.groupBy("key").agg(F.min("id").alias("head"), F.count("*").alias("many")).where("many > 1").select("key", "head")
    heads = keep(heads)
    crowded = keep(among(dealt, "key", heads.select("key")).join(heads, "key").select("id", "key", "head"))
    leaders = crowded.groupBy("id").agg(F.min("head").alias("group"))
    linked = keep(points.join(leaders, "id").select("id", "doc_id", "digest", "fp", "n", "group"))
    # the leader belongs to its own group too, whatever leader it has itself
    own = linked.join(linked.select(F.col("group").alias("id")).distinct(), "id", "left_semi").select("id", F.col("id").alias("group"), "n")
    led = keep(linked.select("id", "group", "n").unionByName(own).distinct())
    sets = keep(shingle_sets(among(docs.select("doc_id", "text"), "doc_id", linked.select("doc_id")).join(linked.select("doc_id", "id", "digest", "fp"), "doc_id"), size))
    if sets.count() > linked.count():  # repeated rows
        sets = keep(sets.groupBy("id").agg(F.first("fp").alias("fp"), F.first("set").alias("set")))
    near = keep(verified_links(led.withColumn("class", F.col("id")), sets, radius, similarity, tile, pairs=False))
    classes = keep(components(near).select(F.col("u").alias("id"), F.col("root").alias("class")))
    # buckets of several classes, but for those whose members all met in one tile of their leader's group
    met = led.groupBy("group").agg((F.count("*") <= tile).alias("one"), F.sum(F.col("n").cast("long")).alias("bytes")).where(F.col("one") & (F.col("bytes") * 8 <= SET_BYTES)).select(F.col("group").alias("head"), F.lit(True).alias("met"))
    named = crowded.join(linked.select("id", "n", F.col("group").alias("leader")), "id").join(classes, "id", "left").withColumn("class", F.coalesce("class", "id"))
    strange = F.max(((F.col("id") != F.col("head")) & (F.col("leader") != F.col("head"))).cast("int")).alias("strange")
    mixed_ = named.groupBy("key", "head").agg(F.min("class").alias("low"), F.max("class").alias("high"), strange).where("low < high")
    mixed_ = mixed_.join(met, "head", "left").where("strange > 0 or met is null").select("key", "low")
    # buckets with the same least class are one group, in which a set travels once
    rest = keep(named.join(mixed_, "key").select("id", F.col("low").alias("group"), "class", "n").distinct())
    edges = near
    if not rest.isEmpty():
        again = among(sets, "id", rest.select("id"))
        edges = near.unionByName(keep(verified_links(rest, again, radius, similarity, tile, pairs=True)))
    groups = components(edges).select(F.col("u").alias("id"), F.col("root").alias("group"))
    named = points.join(groups, "id", "left").select("digest", "doc_id", F.coalesce("group", "id").alias("group"))
    named = named.join(named.groupBy("group").agg(F.min("doc_id").alias("least")), "group").select("digest", "least")
    fate = keep(prints.join(named, "digest").groupBy("doc_id").agg(F.count_if(F.col("doc_id") == F.col("least")).alias("n")))
    out = without(docs.where("doc_id is not null"), "doc_id", fate.where("n = 0").select("doc_id"), fate.where("n > 0").select("doc_id"))
    repeated = fate.where("n > 1").select("doc_id")
    if not repeated.isEmpty():
        maybe = marks(repeated, 2)
        out = out.where(~maybe("doc_id")).unionByName(out.where(maybe("doc_id")).dropDuplicates(["doc_id"]))
    return out.unionByName(docs.where("doc_id is null")).select(docs.columns)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


QUERIES = {"op2_simhash": op2_simhash}
ORACLES: dict[str, str] = {}

"""Benchmark decontamination by CGK embedding and bit-sampling LSH (operator 4).

Edits are insertions, deletions and substitutions of words (runs of letters and digits, lower-cased). A document holds
an item if some stretch of it is within floor(EDITS * n) edits of all the item's n words.

The CGK random walk copies a word sequence to a longer one, and repeats or advances by a random bit that depends on
the step and the word; two sequences at small edit distance walk into step again, so that their images differ in few
places. Bit-sampling LSH takes PLACES places of the image, over REPEATS walks. Items are embedded piece by piece: PIECE
words at every STEP-th word and at the end. However the edits lie, pieces hold EDITS * PIECE of them on average, so that
some piece has at most one edit whatever the item's length, and a piece without edits always meets its copy.

A stretch within the edits of an item has most of its word pairs (each edit touches at most two), and so has every window
of its words; windows are of a geometric series of sizes. Words of a document in no window rich enough in the items'
pairs are skipped, which loses none, and at every other word a piece is walked. A run of such words holds the whole of
any stretch that it holds a part of; runs that hit are joined with the items on the LSH key, and verified exactly by a
bit-parallel edit distance of the whole item. Pairs and keys are tested against bitmaps of fixed size, so nothing that is
broadcast grows with the benchmark; a false hit only costs a join row.

Items with fewer than MIN_WORDS words are too short for pieces and are found exactly: at most one edit is allowed them,
which leaves one of their halves whole (the whole item where none is allowed), so that the hashes of those are their keys
and the words about each hit are verified likewise.

Null and empty texts hold nothing, and items without words are in no document. Repeated rows of documents give one result for each doc_id and item; a null doc_id or item_id gives none. Empty tables give an empty
result; columns besides ids and texts are not read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batch, documents, keep, table

EDITS = 0.2
MIN_WORDS = 8
PIECE, STEP = 8, 4  # words that are embedded together, and words from one piece of an item to the next
PLACES, REPEATS, SEED = 4, 16, 20
BITS = 24  # of the bitmaps: 2 MB each
SIZES = [8]
while SIZES[-1] < 100_000:
    SIZES.append(max(SIZES[-1] + 1, int(SIZES[-1] * 1.15)))

WORD = re.compile(r"[^\W_]+")
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(128))
_U = np.uint64


def words(text: str | None) -> list[bytes]:
    """The words of a text in order, as bytes; the quick way for ASCII gives the same."""
    if not text:
        return []
    return text.encode().translate(_PLAIN + bytes(128)).split() if text.isascii() else [w.encode() for w in WORD.findall(text.lower())]


def symbols(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, ws), np.uint64, len(ws))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def pairs(s: np.ndarray) -> np.ndarray:
    """A hash of BITS bits of each two words in a row."""
    return (mix(s[:-1] * _U(0x9E3779B97F4A7C15) + s[1:]) >> _U(64 - BITS)).astype(np.int64)


def size_of(n: int) -> int:
    """The greatest of SIZES that is at most n."""
    return SIZES[int(np.searchsorted(SIZES, n, side="right")) - 1]


def pairs_needed(size: int) -> int:
    """Word pairs of an item that a window of size words within the edits of such an item's beginning has at least."""
    k = int(np.searchsorted(SIZES, size))
    longest = (SIZES[k + 1] if k + 1 < len(SIZES) else size + 1) - 1
    return max(1, size - 1 - 2 * int(EDITS * longest))


def walk_keys(s: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """LSH keys (pieces x REPEATS) of the pieces of s at starts."""
    out = np.empty((len(starts), REPEATS), np.uint64)
    for rep in range(REPEATS):
        r = np.random.default_rng((SEED, PIECE, rep))
        sampled = set(np.sort(r.choice(2 * PIECE, PLACES, replace=False)).tolist())
        salts = r.integers(1, 1 << 62, 2 * PIECE).astype(np.uint64)
        at, key = np.zeros(len(starts), np.int64), np.full(len(starts), PIECE * 64 + rep, np.uint64)
        for t in range(max(sampled) + 1):
            word = np.where(at < PIECE, s[np.minimum(starts + at, len(s) - 1)], _U(0))
            if t in sampled:
                key = mix(key * _U(0x9E3779B97F4A7C15) + word)
            at += (mix(word ^ salts[t]) >> _U(63)).astype(np.int64)
        out[:, rep] = key
    return out


def pieces(n: int) -> np.ndarray:
    """Where the pieces of an item of n words start."""
    return np.unique(np.append(np.arange(0, n - PIECE + 1, STEP), n - PIECE))


def halves(n: int) -> list[tuple[int, int]]:
    """First and past-the-last words of the parts of a short item of n words, one of which every copy of it holds."""
    return [(0, n // 2), (n // 2, n)] if int(EDITS * n) else [(0, n)]


def run_keys(s: np.ndarray, n: int) -> np.ndarray:
    """Keys of all runs of n words, one for each start."""
    key = np.full(max(len(s) - n + 1, 0), n, np.uint64)
    for k in range(n):
        key = mix(key * _U(0x9E3779B97F4A7C15) + s[k : k + len(key)])
    return key


def distance(item: list[bytes], text: list[bytes]) -> tuple[int, int]:
    """The least edit distance of the whole item to any stretch of text, and where the first such stretch ends (Myers' bit vectors)."""
    n = len(item)
    masks: dict[bytes, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full, last = (1 << n) - 1, 1 << (n - 1)
    pv, mv, score, best = full, 0, n, (n, 0)
    for j, w in enumerate(text):
        eq = masks.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += bool(ph & last) - bool(mh & last)
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score < best[0]:
            best = (score, j + 1)
    return best


def item_keys(benchmark: DataFrame) -> DataFrame:
    """item_id, its words, the size of its windows, LSH keys and word-pair hashes of each item; of short ones no size and
    no pairs, but the keys and lengths of their parts."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            out: dict = {"item_id": [], "words": [], "size": [], "keys": [], "pairs": [], "parts": []}
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ws = words(t)
                if not ws:
                    continue
                s = symbols(ws)
                if len(ws) >= MIN_WORDS:
                    size, keys, pair, parts = size_of(len(ws)), walk_keys(s, pieces(len(ws))), pairs(s), []
                else:
                    cuts = halves(len(ws))
                    size, keys, pair, parts = None, np.concatenate([run_keys(s[a:b], b - a) for a, b in cuts]), [], [b - a for a, b in cuts]
                for k, v in (("item_id", i), ("words", b" ".join(ws)), ("size", size), ("keys", np.unique(keys).view(np.int64)), ("pairs", pair), ("parts", parts)):
                    out[k].append(v)
            return out

        return step

    return by_batch(benchmark.where("item_id is not null").select("item_id", "text"), "item_id long, words binary, size int, keys array<long>, pairs array<long>, parts array<int>", make)


def bitmap(values: DataFrame) -> np.ndarray:
    """A bitmap of 2 ** BITS bits of the column x (0 <= x < 2 ** BITS): at most 2 ** (BITS - 6) words reach the driver."""
    bits = np.zeros(1 << (BITS - 6), np.uint64)
    words = values.groupBy(F.expr("cast(x div 64 as int)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(x % 64 as int)))").alias("b"))
    for w, b in words.collect():
        bits[w] = np.array(b, np.int64).view(np.uint64)
    return bits


def has(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (bits[x >> 6] >> (x & 63).astype(np.uint64) & _U(1)).astype(bool)


def key_bits(keys: np.ndarray) -> np.ndarray:
    return (keys.view(np.uint64) >> _U(64 - BITS)).astype(np.int64)


def regions(docs: DataFrame, sizes: list[int], parts: list[int], pair_map: np.ndarray, key_map: np.ndarray) -> DataFrame:
    """Stretches of documents with pieces whose keys may be an item's: doc_id, start (in words), words and the keys."""
    shared = docs.sparkSession.sparkContext.broadcast((pair_map, key_map))
    needed = {n: pairs_needed(n) for n in sizes}
    least = min(needed.values(), default=0)
    pad = np.zeros(PIECE, np.uint64)

    def runs(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last words of the runs covered by windows rich enough in the items' word pairs."""
        total = np.concatenate(([0], np.cumsum(has(shared.value[0], pairs(s)))))
        step = np.zeros(len(s) + 1, np.int64)
        if sizes and total[-1] >= least:
            for n in sizes:
                m = min(n, len(s))
                starts = np.flatnonzero(total[m - 1 :] - total[: len(total) - m + 1] >= needed[n])
                step[starts] += 1
                step[starts + m] -= 1
        edges = np.diff((np.cumsum(step) > 0).astype(np.int8), prepend=0)
        return np.flatnonzero(edges > 0), np.flatnonzero(edges < 0)

    def short_runs(s: np.ndarray):
        """(first, past-the-last word, keys) of the stretches about hits of the parts of short items."""
        at, keys = [], []
        step = np.zeros(len(s) + 1, np.int64)
        for n in parts:
            key = run_keys(s, n)
            hit = np.flatnonzero(has(shared.value[1], key_bits(key)))
            np.add.at(step, np.maximum(hit - MIN_WORDS, 0), 1)
            np.add.at(step, np.minimum(hit + n + MIN_WORDS, len(s)), -1)
            at.append(hit)
            keys.append(key[hit])
        at, keys = np.concatenate(at), np.concatenate(keys)
        edges = np.diff((np.cumsum(step) > 0).astype(np.int8), prepend=0)
        for a, b in zip(np.flatnonzero(edges > 0).tolist(), np.flatnonzero(edges < 0).tolist()):
            yield a, b, np.unique(keys[(at >= a) & (at < b)]).view(np.int64)

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: dict = {"doc_id": [], "start": [], "words": [], "keys": []}
            line, found, base = [], [], 0  # symbols of the runs, one after the other; (row, start, end) and place of each
            for row, t in enumerate(texts):
                ws = words(t)
                if not ws:
                    continue
                s = symbols(ws)
                for a, b, keys in short_runs(s) if parts else ():
                    for name, v in (("doc_id", ids[row]), ("start", a), ("words", b" ".join(ws[a:b])), ("keys", keys)):
                        out[name].append(v)
                for a, b in zip(*(x.tolist() for x in runs(s))):
                    line += [s[a : b + PIECE], pad]
                    found.append((row, a, b, base))
                    base += len(line[-2]) + PIECE
            if not found:
                return out
            symbols_ = np.concatenate(line)
            lengths = np.array([b - a for _, a, b, _ in found])
            of = np.repeat(np.arange(len(found)), lengths)
            first = np.repeat(np.array([p for *_, p in found]) - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
            places = first + np.arange(len(of))
            hits: dict[int, list] = {}
            for a in range(0, len(of), 1 << 16):
                keys = walk_keys(symbols_, places[a : a + (1 << 16)])
                hit = has(shared.value[1], key_bits(keys.reshape(-1))).reshape(keys.shape)
                for k in np.flatnonzero(hit.any(1)):
                    hits.setdefault(int(of[a + k]), []).append(keys[k][hit[k]])
            for k, keys in hits.items():
                row, start, end, _ = found[k]
                for name, v in (("doc_id", ids[row]), ("start", start), ("words", b" ".join(words(texts[row])[start:end])), ("keys", np.unique(np.concatenate(keys)).view(np.int64))):
                    out[name].append(v)
            return out

        return step

    return by_batch(docs.where("doc_id is not null").select("doc_id", "text"), "doc_id long, start int, words binary, keys array<long>", make)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, edits, n_words (of the item), start and end (in words of the document, the stretch ends at end):
    for each document and item it holds, the occurrence with the fewest edits, the first on ties."""
    items = keep(item_keys(benchmark))
    sizes = sorted(r["size"] for r in items.where("size is not null").select("size").distinct().collect())  # geometric: few, however many items
    parts = sorted(r["n"] for r in items.select(F.explode("parts").alias("n")).distinct().collect())  # under MIN_WORDS
    keys = items.select("item_id", F.explode("keys").alias("key"))
    pair_map = bitmap(items.select(F.explode("pairs").alias("x")))
    key_map = bitmap(keys.select(F.shiftrightunsigned("key", 64 - BITS).alias("x")))
    found = keep(regions(docs, sizes, parts, pair_map, key_map))
    hits = found.select("doc_id", "start", F.xxhash64("words").alias("hash"), F.explode("keys").alias("key"))
    candidates = hits.join(keys, "key").select("doc_id", "start", "hash", "item_id").distinct()
    stretches = found.select("doc_id", "start", F.xxhash64("words").alias("hash"), "words").distinct()
    rows = candidates.join(stretches, ["doc_id", "start", "hash"]).join(items.groupBy("item_id", F.col("words").alias("item")).agg(F.lit(1)).select("item_id", "item"), "item_id")

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            doc, item_id, start, text, item = (batch.column(k).to_pylist() for k in range(5))
            out: dict = {"doc_id": [], "item_id": [], "edits": [], "n_words": [], "end": []}
            for d, i, a, t, w in zip(doc, item_id, start, text, item):
                w = w.split()
                edits, end = distance(w, t.split())
                if edits <= int(EDITS * len(w)):
                    for k, v in (("doc_id", d), ("item_id", i), ("edits", edits), ("n_words", len(w)), ("end", a + end)):
                        out[k].append(v)
            return out

        return step

    matches = by_batch(rows.select("doc_id", "item_id", "start", "words", "item"), "doc_id long, item_id long, edits int, n_words int, end int", make)
    return matches.groupBy("doc_id", "item_id").agg(F.min(F.struct("edits", "end", "n_words")).alias("m")).select("doc_id", "item_id", "m.edits", "m.n_words", "m.end")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


QUERIES = {"op4_decontaminate": op4_decontaminate}
ORACLES: dict[str, str] = {}

"""Nearest neighbours by a permutation index (operator 7).

A vector is represented by the ordered list of its nearest pivots. The vectors of a block are posted in the inverted
files of their pivots; a query walks the files of its own pivots, ranks the block's vectors by the footrule distance of
the two lists (a pivot missing from one stands behind its end) and reranks the nearest by the exact measure.

For largest inner product, vectors get one more component, sqrt(M^2 - |v|^2) with M the largest norm, by which all have
the same length and nearness by angle agrees with inner product; queries get 0 there.

Vectors are dealt by hash into blocks of about BLOCK rows. A task reads a block, indexes it once, and streams the queries
past it in batches; it gives at most k rows a query. Of each block SHARE of its entries are reranked for a query (k + 1 at
least, as a query can get no more rows than it has candidates). Equal vectors of a block are one entry of the index, so
that a crowd of copies does not use up the candidates; exactly its smallest ids are listed.

Pivots are PIVOTS of SAMPLE rows, the first by the hash of vec_id (a documented bound), each the one farthest from those
before it, so that no crowd takes them all; every row is indexed. Rows with a null id,
and vectors that are null, empty, zero, or hold null or non-finite components, take no part; of vectors of several
lengths only those of the commonest length (the smaller on ties) do. A vec_id that comes several times counts once, with its smallest
vector. An empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, table

PIVOTS, PREFIX, SAMPLE = 512, 64, 4_096
SHARE = 0.12  # of a block's entries that are reranked
BLOCK = 8_192


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array of double) of the rows that take part."""
    v = F.col("embedding")
    fine = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    clean = vectors.select("vec_id", v.cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & v.isNotNull()).where(fine)
    return clean.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def unit(rows: np.ndarray, extra: np.ndarray) -> np.ndarray:
    full = np.concatenate([rows, extra[:, None]], axis=1)
    return full / np.linalg.norm(full, axis=1, keepdims=True)


def spread(rows: np.ndarray, count: int) -> np.ndarray:
    """count of the unit rows, each the farthest by angle from those before it; fewer if there are fewer distinct ones."""
    chosen, near = [0], rows @ rows[0]
    while len(chosen) < min(count, len(rows)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, rows @ rows[chosen[-1]])
    return rows[chosen]


class Index:
    """Inverted files of a block."""

    def __init__(self, vectors: np.ndarray, pivots: np.ndarray, top: float, prefix: int):
        self.vectors, self.pivots, self.prefix = vectors, pivots, min(prefix, len(pivots))
        norms = (vectors * vectors).sum(1)
        order = self.lists(unit(vectors, np.sqrt(np.maximum(0, top * top - norms))))
        flat = order.ravel()
        by = np.argsort(flat, kind="stable")
        self.entry, self.place = by // self.prefix, (by % self.prefix).astype(np.int64)
        self.begin = np.searchsorted(flat[by], np.arange(len(pivots) + 1))

    def lists(self, rows: np.ndarray) -> np.ndarray:
        """The prefix nearest pivots of each row, nearest first, ties to the smaller pivot."""
        return np.argsort(-(rows @ self.pivots.T), axis=1, kind="stable")[:, : self.prefix]

    def candidates(self, places: np.ndarray, want: int) -> np.ndarray:
        """Entries by the footrule distance of their lists to the query's, with all ties of the last one."""
        k, n = self.prefix, len(self.vectors)
        if want >= n:
            return np.arange(n)
        # the footrule over both lists' pivots, less what an entry sharing none has: each shared pivot saves
        # (k - a) + (k - b) - |a - b| = 2 (k - max(a, b))
        sizes = self.begin[places + 1] - self.begin[places]
        at = np.repeat(self.begin[places] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        saved = np.bincount(self.entry[at], k - np.maximum(np.repeat(np.arange(len(places)), sizes), self.place[at]), n)
        return np.flatnonzero(saved >= np.partition(saved, n - want)[n - want])


class Block:
    """The index of one block of vectors, equal ones as one entry, and the search in it."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, pivots: np.ndarray, top: float, prefix: int):
        order = np.argsort(ids, kind="stable")
        self.distinct, of = np.unique(rows[order], axis=0, return_inverse=True)
        of = of.reshape(-1)
        by = np.argsort(of, kind="stable")  # within an entry by id
        self.begin = np.searchsorted(of[by], np.arange(len(self.distinct) + 1))
        self.members = ids[order][by]
        self.index = Index(self.distinct, pivots, top, prefix)

    def search(self, ids: np.ndarray, rows: np.ndarray, k: int, share: float) -> list[tuple[int, int, float]]:
        out: list[tuple[int, int, float]] = []
        want = max(k + 1, math.ceil(share * len(self.distinct)))
        for q, row, place in zip(ids, rows, self.index.lists(unit(rows, np.zeros(len(rows))))):
            entries = self.index.candidates(place, want)
            scores = (self.distinct[entries] * row).sum(1)
            # entries by score until they hold k others than the query, and all that tie with the last
            found: list[tuple[float, int]] = []
            last = None
            for e in np.argsort(-scores, kind="stable"):
                if last is not None and scores[e] < last:
                    break
                a, b = self.begin[entries[e]], self.begin[entries[e] + 1]
                found += [(-scores[e], i) for i in self.members[a : min(b, a + k + 1)] if i != q]
                if last is None and len(found) >= k:
                    last = scores[e]
            out += [(q, i, -s) for s, i in sorted(found)[:k]]
        return out


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, pivots: int = PIVOTS, prefix: int = PREFIX, sample: int = SAMPLE, share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found for each row of queries(query_id, embedding)."""
    spark = vectors.sparkSession
    facts = vectors.agg(F.count("*").alias("n"), F.sqrt(F.max(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))).alias("top")).first()
    # written before it is collected, so that the driver gets `sample` rows and not as many from each partition
    picked = keep(vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample)).collect()
    n, top = facts["n"], facts["top"] or 0.0
    anchors = np.unique(np.array([r["embedding"] for r in picked]), axis=0) if picked else np.empty((0, 0))
    if len(anchors):
        anchors = spread(unit(anchors, np.sqrt(np.maximum(0, top * top - (anchors * anchors).sum(1)))), pivots)
    shared = spark.sparkContext.broadcast(anchors)
    blocks = max(1, math.ceil(n / block))
    left = vectors.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("v"), F.lit(False).alias("query"), F.col("vec_id").alias("id"), "embedding")
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("v"), F.lit(True).alias("query"), F.col("query_id").alias("id"), "embedding")
    dealt = left.unionByName(right).repartition(blocks, "v").sortWithinPartitions("v", "query")

    def run(batches):
        at, ids, rows, here = None, [], [], None
        for batch in batches:
            vs, is_query, id_ = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            if not len(vs):
                continue
            x = batch.column(3).flatten().to_numpy().reshape(len(vs), -1)
            cuts = np.flatnonzero((np.diff(vs) != 0) | (np.diff(is_query.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(vs)]):
                if vs[a] != at:
                    at, ids, rows, here = vs[a], [], [], None
                if not is_query[a]:
                    ids.append(id_[a:b])
                    rows.append(x[a:b])
                elif ids or here:
                    if here is None:
                        here = Block(np.concatenate(ids), np.concatenate(rows), shared.value, top, prefix)
                        ids, rows = [], []
                    found = here.search(id_[a:b], x[a:b], k, share)
                    q, i, s = zip(*found) if found else ((), (), ())
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(embeddings: DataFrame, k: int = 20, every: int = 20, **how) -> DataFrame:
    """Searches for the rows whose vec_id is divisible by `every` among all others."""
    clean = keep(usable(embeddings))
    sizes = clean.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if sizes:
        clean = clean.where(F.size("embedding") == sizes[0]["d"])
    queries = clean.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return search(clean, queries, k, **how)


def op7_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


QUERIES = {"op7_permutation_index": op7_permutation_index}
ORACLES: dict[str, str] = {}

"""Byte-level BPE: overlapping chunk encoding and decoding (operator 10).

A text is cut into chunks that overlap. Each chunk is pre-tokenised by itself, in parallel; neighbours are stitched at
the first position of the overlap where both see a pre-token begin, since the pattern looks only ahead, so that from a
common beginning on both agree. The stitched pre-tokens are encoded by the ranks; decoding concatenates the ids' bytes.

Each long text is one group by a key of its own, also where texts or doc_ids repeat, so that no task gets more than one
text at a time however many copies there are.

Null texts count as empty: no ids, and the digests of the empty string. Repeated rows give repeated results; null
doc_ids stay null; an empty table gives an empty result; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batch, documents

CHUNK, OVERLAP, UNSURE = 32_768, 512, 3
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def pretokens(pattern: regex.Pattern, text: str, last: bool = True) -> list[int]:
    """Ends of the pre-tokens of text. Of a chunk with more to follow, those near its end, which what follows could
    change, are left out: a match that reaches the end, or a contraction of up to UNSURE characters cut short."""
    ends = [m.end() for m in pattern.finditer(text)]
    if not last:
        while ends and ends[-1] > len(text) - UNSURE:
            ends.pop()
    return ends


def stitch(pattern: regex.Pattern, text: str, chunks: list[tuple[int, list[int]]]) -> list[int]:
    """Ends of all pre-tokens of text from (start, absolute ends) of its chunks in order."""
    done: list[int] = []
    for k, (start, ends) in enumerate(chunks):
        if not k:
            done = list(ends)
            continue
        begins = {start, *ends}
        at = np.searchsorted(done, start)  # the first pre-token of the chunks before that ends in this one
        at = next((i for i in range(at, len(done)) if done[i] in begins), None)
        if at is None:  # no common beginning in the overlap: go on token by token until there is one
            pos = done[-1] if done else 0
            while pos not in begins or pos < start:
                m = pattern.match(text, pos)
                if not m:
                    break
                done.append(pos := m.end())
        else:
            del done[at + 1 :]
            pos = done[-1]
        done += ends[np.searchsorted(ends, pos, side="right") :]
    return done


class Codec:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        self.core = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.cache: dict[str, list[int]] = {}

    def piece(self, piece: str) -> list[int]:
        ids = self.core._encode_single_piece(piece)
        if len(self.cache) >= 1 << 17:  # a bound on memory, not on what is encoded
            self.cache.clear()
        if len(piece) <= 64:
            self.cache[piece] = ids
        return ids

    def encode(self, pieces) -> list[int]:
        known, out = self.cache.get, []
        for p in pieces:
            out += known(p) or self.piece(p)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def digests(self, pieces) -> tuple[int, str, str]:
        ids = self.encode(pieces)
        return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def cut(text: str, ends: list[int]) -> list[str]:
    return [text[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def encode_documents(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of docs.

    A text of at most one chunk is encoded where it is read. The chunks of longer ones are dealt out over the tasks,
    pre-tokenised there, and come together by document (not by source or length) for stitching.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def short():
        c = codec(path, pattern)

        def step(batch: pa.RecordBatch) -> dict:
            found = [c.digests(c.pattern.findall(t)) for t in batch.column(1).to_pylist()]
            return {"doc_id": batch.column(0), "n_tokens": [x[0] for x in found], "ids_sha256": [x[1] for x in found], "decoded_sha256": [x[2] for x in found]}

        return step

    def deal():
        def step(batch: pa.RecordBatch) -> dict:
            out: dict = {"doc_id": [], "key": [], "k": [], "part": [], "last": []}
            for i, key, t in zip(*(batch.column(c).to_pylist() for c in range(3))):
                for k in range(-(-len(t) // chunk)):
                    for name, v in (("doc_id", i), ("key", key), ("k", k), ("part", t[k * chunk : (k + 1) * chunk + overlap]), ("last", (k + 1) * chunk >= len(t))):
                        out[name].append(v)
            return out

        return step

    def split():
        c = codec(path, pattern)

        def step(batch: pa.RecordBatch) -> dict:
            parts, lasts = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            ends = [np.asarray(pretokens(c.pattern, p, last), "<i4").tobytes() for p, last in zip(parts, lasts)]
            return {"doc_id": batch.column(0), "key": batch.column(1), "k": batch.column(2), "part": batch.column(3), "ends": ends}

        return step

    def join(whole: pa.Table) -> pa.Table:
        c = codec(path, pattern)
        k = whole.column("k").to_numpy()
        order = np.argsort(k).tolist()
        parts, ends = whole.column("part").to_pylist(), whole.column("ends").to_pylist()
        text = "".join(parts[i][:chunk] for i in order)
        chunks = [(int(k[i]) * chunk, (np.frombuffer(ends[i], "<i4").astype(np.int64) + int(k[i]) * chunk).tolist()) for i in order]
        n, ids, decoded = c.digests(cut(text, stitch(c.pattern, text, chunks)))
        return pa.table({"doc_id": pa.array([whole.column("doc_id")[0].as_py()], pa.int64()), "n_tokens": pa.array([n], pa.int64()), "ids_sha256": [ids], "decoded_sha256": [decoded]})

    size = F.length("text")
    whole = by_batch(docs.where(size <= chunk), SCHEMA, short)
    # cut in one pass over each text; substring() would scan it from its start for every chunk
    keyed = docs.where(size > chunk).select("doc_id", F.monotonically_increasing_id().alias("key"), "text")
    parts = by_batch(keyed, "doc_id long, key long, k int, part string, last boolean", deal, rows=16).repartition("key", "k")
    long = by_batch(parts, "doc_id long, key long, k int, part string, ends binary", split, rows=64).groupBy("key").applyInArrow(join, SCHEMA)
    return whole.unionByName(long)


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


QUERIES = {"op10_bpe_codec": op10_bpe_codec}
ORACLES: dict[str, str] = {}

"""Log-bilinear language model trained by noise-contrastive estimation in numpy (operator 5).

Symbols of the model are the TOP commonest training words (the end of a text among them), each by itself, and CLASSES
classes of all other words, by the word's first characters. A symbol's score is the inner product of its vector with
the sum of the vectors of the two symbols before it (one table for each place), plus a bias: log-bilinear. Training is
noise-contrastive estimation against the symbols' frequencies: each task goes once over all the training text it reads
and the tasks' parameters are averaged, weighted by tokens, row by row in one grouped aggregation. Scoring normalises
by matrix products of the distinct contexts of a batch with all symbols' vectors. A word of a class gets the class's
probability times its smoothed share of the class.

Counts of all training words come from one grouped aggregation. The TOP_EXACT commonest (a fixed number) are broadcast;
the counts of the others are joined to the documents' remaining words.

Null and empty texts consist of the end alone. A null doc_id stays null and is never held out. Repeated rows count and
are scored each time. An empty table gives an empty result; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batch, by_task, documents, fold, keep

FOLDS, HELD = 10, 0
TOP, CLASSES, WIDTH = 512, 256, 16
TOP_EXACT = 65_536
ADD = 0.1
BATCH, NOISE, RATE, SEED = 4_096, 48, 0.07, 11
END = b""
SYMBOLS = TOP + CLASSES
START = SYMBOLS  # the context before a text
LN10 = math.log(10)


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words, then the end."""
    return [*(text or "").encode().lower().split(), END]


def class_of(word: bytes) -> int:
    """Words that begin alike share a class; the first characters tell the language and the kind of word."""
    return TOP + zlib.crc32(word[:3]) % CLASSES


def count_words(docs: DataFrame, room: int = 1 << 20) -> DataFrame:
    """(word, c) over all rows of docs(text); each task sends what it has counted whenever it holds room words."""
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64())])

    def run(batches):
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], schema=schema)
            seen.clear()
            return out

        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen.update(tokens(t))
                if len(seen) > room:
                    yield flush()
        if seen:
            yield flush()

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Words:
    """Symbols of words: the TOP commonest first, by their counts; classes of the rest with their counts and sizes."""

    def __init__(self, exact: list[tuple[bytes, int]], n: int, v: int, classes: dict[int, tuple[int, int]]):
        self.count = dict(exact)
        self.symbol = {w: i for i, (w, _) in enumerate(exact[:TOP])}
        self.n, self.v = n, v
        self.at = {w: i for i, (w, _) in enumerate(exact)}
        self.symbol_at = np.array([i if i < TOP else class_of(w) for i, (w, _) in enumerate(exact)] + [0], np.int64)
        self.class_n, self.class_v = np.zeros(CLASSES), np.zeros(CLASSES)
        for k, (cn, cv) in classes.items():
            self.class_n[k - TOP], self.class_v[k - TOP] = cn, cv
        freq = np.full(SYMBOLS, ADD)
        freq[: len(exact[:TOP])] += [c for _, c in exact[:TOP]]
        freq[TOP:] += self.class_n
        self.freq = freq / freq.sum()

    def places(self, ws: list[bytes]) -> np.ndarray:
        """Places of words among the broadcast ones, -1 for others."""
        return np.array(list(map(self.at.get, ws, repeat(-1))), np.int64)

    def symbols(self, ws: list[bytes], places: np.ndarray | None = None) -> np.ndarray:
        at = self.places(ws) if places is None else places
        out = self.symbol_at[at]
        for i in np.flatnonzero(at < 0).tolist():
            out[i] = class_of(ws[i])
        return out


class Parameters:
    """Vectors of the symbols one and two before (a table each), of the symbols predicted, and biases."""

    def __init__(self, freq: np.ndarray):
        r = np.random.default_rng(SEED)
        self.one, self.two = ((r.standard_normal((SYMBOLS + 1, WIDTH)) * 0.1).astype(np.float32) for _ in range(2))
        self.out = (r.standard_normal((SYMBOLS, WIDTH)) * 0.1).astype(np.float32)
        self.bias = np.log(freq).astype(np.float32)

    def rows(self) -> np.ndarray:
        return np.concatenate([self.one, self.two, np.concatenate([self.out, np.zeros((0, WIDTH), np.float32)]), np.resize(np.pad(self.bias, (0, -SYMBOLS % WIDTH)), (-(-SYMBOLS // WIDTH), WIDTH))])

    def take(self, rows: np.ndarray) -> Parameters:
        n = SYMBOLS + 1
        self.one, self.two, self.out = (x.astype(np.float32) for x in (rows[:n], rows[n : 2 * n], rows[2 * n : 3 * n - 1]))
        self.bias = rows[3 * n - 1 :].reshape(-1)[:SYMBOLS].astype(np.float32)
        return self

    def learn(self, one: np.ndarray, two: np.ndarray, word: np.ndarray, log_kp: np.ndarray, noise: np.ndarray, sums: list[np.ndarray]) -> None:
        """One NCE step with Adagrad: noise are symbols drawn from their frequencies, log_kp = log(len(noise) * frequency)."""
        h = self.one[one] + self.two[two]
        target, other = self.out[word], self.out[noise]
        g = chance(np.einsum("ij,ij->i", h, target) + (self.bias[word] - log_kp[word])) - np.float32(1)
        z = h @ other.T
        z += self.bias[noise] - log_kp[noise]
        gn = chance(z)
        dh = g[:, None] * target + gn @ other
        grads = [
            (self.one, scatter(one, dh, len(self.one))),
            (self.two, scatter(two, dh, len(self.two))),
            (self.out, scatter(np.concatenate([word, noise]), np.concatenate([g[:, None] * h, gn.T @ h]), SYMBOLS)),
            (self.bias, np.bincount(word, g, SYMBOLS).astype(np.float32) + np.bincount(noise, gn.sum(0), SYMBOLS).astype(np.float32)),
        ]
        for (p, d), s in zip(grads, sums):
            s += d * d
            p -= RATE * d / np.sqrt(s + 1.0)


def chance(x: np.ndarray) -> np.ndarray:
    """The logistic function of x (float32), in place."""
    np.maximum(np.negative(x, out=x), np.float32(-80), out=x)
    np.exp(np.minimum(x, np.float32(80), out=x), out=x)
    x += np.float32(1)
    return np.reciprocal(x, out=x)


def scatter(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount((at[:, None] * WIDTH + np.arange(WIDTH)).ravel(), rows.ravel(), n * WIDTH).reshape(n, WIDTH).astype(np.float32)


def contexts(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(one before, two before, symbol) of the tokens of several texts, one after the other."""
    word = np.concatenate(ids)
    one, two = np.roll(word, 1), np.roll(word, 2)
    begin = np.cumsum([0, *map(len, ids[:-1])])
    one[begin] = two[begin] = START
    second = begin[np.fromiter(map(len, ids), int, len(ids)) > 1] + 1
    two[second] = START
    return one, two, word


def train(docs: DataFrame, words: Words) -> Parameters:
    """Local NCE training in each task over docs(text), parameters averaged by tokens, row by row."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def make():
        w = shared.value
        p, r = Parameters(w.freq), np.random.default_rng(SEED)
        log_kp = np.log(w.freq * NOISE).astype(np.float32)
        sums = [np.zeros_like(x) for x in (p.one, p.two, p.out, p.bias)]
        wait: list[np.ndarray] = []
        state = [0, 0]
        cum = np.cumsum(w.freq)

        def learn(all_: bool) -> None:
            if not wait:
                return
            one, two, word = contexts(wait)
            order = r.permutation(len(word))
            for a in range(0, len(order), BATCH):
                k = order[a : a + BATCH]
                p.learn(one[k], two[k], word[k], log_kp, np.minimum(np.searchsorted(cum, r.random(NOISE)), SYMBOLS - 1), sums)
            state[1] += len(word)
            wait.clear()
            state[0] = 0

        def step(batch: pa.RecordBatch) -> None:
            for t in batch.column(0).to_pylist():
                wait.append(w.symbols(tokens(t)))
                state[0] += len(wait[-1])
                if state[0] > 1 << 19:
                    learn(True)

        def finish() -> dict:
            learn(True)
            rows = p.rows() * state[1]
            return {"k": np.arange(len(rows)), "n": np.full(len(rows), state[1]), "v": list(rows.astype(np.float64))}

        return step, finish

    rows = by_task(docs.select("text"), "k int, n long, v array<double>", make)
    mean = rows.groupBy("k").agg(F.sum("n").alias("n"), *[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(WIDTH)])
    p = Parameters(words.freq)
    got = sorted(mean.collect())  # a fixed number of rows, whatever the input
    return p.take(np.array([r[2:] for r in got]) / np.array([max(1, r[1]) for r in got])[:, None]) if got else p


class Scorer:
    def __init__(self, words: Words, p: Parameters):
        self.words, self.p, self.log_z = words, p, {}

    def log_probabilities(self, one: np.ndarray, two: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Normalised natural log-probabilities of the symbols in their contexts; each distinct context is normalised once."""
        p = self.p
        pair, of = np.unique(one * (SYMBOLS + 1) + two, return_inverse=True)
        z = np.empty(len(pair), np.float32)
        for a in range(0, len(pair), BATCH):
            k = pair[a : a + BATCH]
            s = (p.one[k // (SYMBOLS + 1)] + p.two[k % (SYMBOLS + 1)]) @ p.out.T
            s += p.bias
            top = s.max(1)
            s -= top[:, None]
            z[a : a + BATCH] = np.log(np.exp(s, out=s).sum(1)) + top
        score = np.empty(len(word), np.float64)
        for a in range(0, len(word), 1 << 18):
            b = slice(a, a + (1 << 18))
            score[b] = ((p.one[one[b]] + p.two[two[b]]) * p.out[word[b]]).sum(1) + p.bias[word[b]]
        return score - z[of]


def score_documents(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text", (fold("doc_id", FOLDS) == HELD).alias("held_out"))
    counts = keep(count_words(docs.where(~F.col("held_out"))))
    # written before it is collected, so that the driver gets TOP_EXACT rows and not as many from each partition
    exact = [(bytes(r["word"]), r["c"]) for r in keep(counts.orderBy(F.desc("c"), "word").limit(TOP_EXACT)).collect()]
    exact.sort(key=lambda x: (-x[1], x[0]))
    facts = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = facts["n"], facts["v"]
    # what the TOP words leave, by class: crc32 of the first three bytes, in SQL as in class_of
    last = exact[:TOP][-1] if exact else (b"", 0)
    beyond = (F.col("c") < last[1]) | ((F.col("c") == last[1]) & (F.col("word") > F.lit(bytearray(last[0]))))
    of_class = (F.lit(TOP) + F.crc32(F.expr("substring(word, 1, 3)")) % CLASSES).cast("int")
    classes = {r["k"]: (r["n"], r["v"]) for r in counts.where(beyond).groupBy(of_class.alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    words = Words(exact, n, v, classes)
    model = train(docs.where(~F.col("held_out")), words)
    shared = docs.sparkSession.sparkContext.broadcast((words, model))

    def make():
        w, p = shared.value
        scorer = Scorer(w, p)
        c = np.array([*w.count.values(), 0], np.float64)  # the last for words that are not broadcast
        base = np.log10((c + ADD) / (w.n + ADD * (w.v + 1)))
        k = np.maximum(w.symbol_at - TOP, 0)
        share = np.where(w.symbol_at < TOP, 0.0, np.log10((c + ADD) / (w.class_n[k] + ADD * (w.class_v[k] + 1))))
        base[-1] = share[-1] = 0.0

        def step(batch: pa.RecordBatch) -> dict:
            key, held, ids = batch.column(2).to_pylist(), batch.column(1), batch.column(0)
            n = len(key)
            total, n_tokens, n_known = np.zeros((2, n)), np.zeros(n, np.int64), np.zeros(n, np.int64)
            rare_of: list[dict[bytes, int]] = []
            arrays: list[np.ndarray] = []
            first = size = 0

            def flush(end: int) -> None:
                lp = scorer.log_probabilities(*contexts(arrays))
                total[1, first:end] += np.add.reduceat(lp, np.cumsum([0, *map(len, arrays[:-1])])) / LN10

            for d, t in enumerate(batch.column(3).to_pylist()):
                ws = tokens(t)
                at = w.places(ws)
                total[0, d], total[1, d] = base[at].sum(), share[at].sum()
                other = np.flatnonzero(at < 0).tolist()
                n_tokens[d], n_known[d] = len(ws), len(ws) - len(other)
                rare_of.append(Counter([ws[i] for i in other]))
                arrays.append(w.symbols(ws, at))
                size += len(ws)
                if size > 1 << 21:
                    flush(d + 1)
                    arrays, first, size = [], d + 1, 0
            if arrays:
                flush(n)
            each = np.fromiter((len(r) + 1 for r in rare_of), np.int64, n)
            begin = np.cumsum(each) - each
            rows = int(each.sum())
            own = np.ones(rows, bool)
            own[begin] = False
            words_, tf = [], np.zeros(rows, np.int64)
            for d, r in enumerate(rare_of):
                words_.append(b"\xff" + key[d].to_bytes(8))  # no word has the byte 255
                words_ += r
                tf[begin[d] + 1 : begin[d] + each[d]] = list(r.values())
            of = np.repeat(np.arange(n), each)
            wide = lambda x: pa.array(x[of], mask=own)
            take = pa.array(np.where(own, -1, of), mask=own)
            return {"key": np.array(key, np.int64)[of], "word": pa.array(words_, pa.binary()), "tf": tf, "doc_id": ids.take(take), "held_out": held.take(take), "n_tokens": wide(n_tokens), "n_known": wide(n_known), "base": wide(total[0]), "score": wide(total[1])}

        return step

    # one row a document, and one for each further distinct word whose count is to be joined; what belongs to a text meets again by its key
    keyed = docs.select("doc_id", "held_out", F.monotonically_increasing_id().alias("key"), "text")
    rows = by_batch(keyed, "key long, word binary, tf long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double", make, rows=2_500)
    c = F.coalesce("c", F.lit(0))
    k = of_class - TOP
    class_n, class_v = (F.element_at(F.array(*[F.lit(float(x)) for x in xs]), k + 1) for xs in (words.class_n, words.class_v))
    own = F.col("tf") > 0
    joined = rows.join(counts, "word", "left").select(
        "key", "doc_id", "held_out", "n_tokens",
        F.when(own, F.when(c > 0, F.col("tf")).otherwise(0)).otherwise(F.col("n_known")).alias("n_known"),
        F.when(own, F.col("tf") * F.log10((c + ADD) / F.lit(n + ADD * (v + 1)))).otherwise(F.col("base")).alias("base"),
        F.when(own, F.col("tf") * F.log10((c + ADD) / (class_n + ADD * (class_v + 1)))).otherwise(F.col("score")).alias("score"),
    )
    out = joined.groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op5_lbl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))


QUERIES = {"op5_lbl": op5_lbl}
ORACLES: dict[str, str] = {}

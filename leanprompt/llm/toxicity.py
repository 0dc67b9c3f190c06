"""Toxicity: noisy-channel deobfuscation, then a score of the restored text (operator 1).

The channel writes letters as look-alike digits and signs, spreads words over single characters with separators between,
and repeats letters. What it could have made are ambiguous stretches: look-alikes in or beside letters (runs of up to
RUN; longer runs are numbers or rules), a letter three times or more (and, in a word with either, a
letter twice), and four or more single characters spread out (three, if by signs and not spaces). They are lattices: each
character stands for itself, for the letters it looks like, or (separators, repetitions) for nothing. A Viterbi pass under
a character trigram model, whose counts are taken over all texts, picks the likeliest reading. Two plain letters in a row
leave one state, so a word of any length is decoded stretch by stretch, exactly and in time in proportion to its length.

The restored text is scored by a logistic model over the presence of words and word beginnings. It is fitted on at most
PER_CLASS labelled documents of each class (the first by the hash of doc_id outside the held-out fold; at most
MAX_CHARS of text), which are documented bounds; the classes' true shares come from all labels.

Null and empty texts have no features and get the score of the constant alone; held_out is false for a null doc_id.
Labels that are null or neither 0 nor 1 are ignored; without labels of both classes the score is the smoothed share of
label 1. Repeated rows give repeated results; an empty table an empty one; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batch, by_task, documents, fold, labelled_sample, sigmoid, table
from .quality import logistic

PER_CLASS, MAX_CHARS = 4_000, 48 << 20
FOLDS, HELD, CUT = 4, 2, 0.3
SYMBOLS = 28  # word boundary, a to z, any other letter
LOOKS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e"}
COST = {"look": math.log(0.05), "gone": math.log(0.3), "kept": math.log(0.5), "odd": math.log(1e-4)}
PREFIXES = (4, 5, 6)
MAX_FEATURES = 512
SURE = 30  # sampled documents of label 1 that a feature needs to speak by itself

RUN = 4
_LEET = "01345789@$!|+€"
_LAST = "013457@$"  # may end a word; the other signs there are punctuation
_ONE = rf"(?:[^\W\d_]|[{_LEET}])"
#: Single characters spread out; a word with its look-alikes; what is ambiguous in one.
SPREAD = re.compile(rf"(?<![^\W_]){_ONE}(?:(?:[ ._*-]{{1,3}}{_ONE}(?![^\W_])){{3,}}|(?:[._*-]{{1,3}}{_ONE}(?![^\W_])){{2}})")
TOKEN = re.compile(rf"{_ONE}+")
UNSURE = re.compile(rf"[{_LEET}]+|([^\W\d_])\1+", re.I)
WORD = re.compile(r"[^\W\d_]+")


def _class(c: str) -> int:
    """1 letter, 2 look-alike, 4 separator, 8 white space, 16 look-alike that may end a word, 32 letter or digit."""
    return c.isalpha() + 2 * (c in _LEET) + 4 * (c in " ._*-") + 8 * c.isspace() + 16 * (c in _LAST) + 32 * c.isalnum()


_CLASS = np.array([_class(chr(c)) for c in range(256)], np.uint8)

_CODES = bytes(b - 96 if 97 <= b <= 122 else b - 64 if 65 <= b <= 90 else 27 if b >= 128 else 0 for b in range(256))


def symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(gram, n) over all texts; SYMBOLS ** 3 rows at most from a task, and in all."""

    def make():
        total = np.zeros(SYMBOLS**3, np.int64)

        def step(batch: pa.RecordBatch) -> None:
            for t in batch.column(0).to_pylist():
                if t:
                    raw = t.encode()
                    for a in range(0, len(raw), 1 << 22):
                        c = np.frombuffer(b"\0" + raw[max(0, a - 2) : a + (1 << 22)].translate(_CODES) + b"\0", np.uint8).astype(np.int32)
                        total[:] += np.bincount((c[:-2] * SYMBOLS + c[1:-1]) * SYMBOLS + c[2:], minlength=SYMBOLS**3)

        def finish() -> dict:
            at = np.flatnonzero(total)
            return {"gram": at, "n": total[at]}

        return step, finish

    return by_task(docs.select("text"), "gram int, n long", make).groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b), interpolated with bigrams and unigrams, as a cube of SYMBOLS a side."""
    n = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float64)
    uni = (n.sum((0, 1)) + 1) / (n.sum() + SYMBOLS)
    two = n.sum(0)
    bi = (two + 20 * uni) / (two.sum(-1, keepdims=True) + 20)
    tri = (n + 20 * bi[None]) / (n.sum(-1, keepdims=True) + 20)
    return np.log(tri)


def readings(span: str, spread: bool = False) -> list[list[tuple[str, float]]]:
    """The lattice of a span: for each character or run its readings ('' for none) with the channel's log-probability."""
    out = []
    for c, run in groupby(span.lower(), lambda x: " " if spread and x in " ._*-" else x):
        k = len(list(run))
        if spread and c == " ":
            arcs = [("", COST["gone"]), (" ", COST["odd"])]
        elif c.isalpha():
            arcs = [(c, 0.0)] if k == 1 else [(c, COST["look"]), (c * 2, 0.0)] if k == 2 else [(c, COST["kept"]), (c * 2, COST["kept"]), (c * k, COST["odd"])]
        elif c in LOOKS:
            arcs = [(x * m, COST["look"]) for x in LOOKS[c] for m in {1, min(k, 2)}] + [(c * k, COST["odd"])]
        else:
            arcs = [(c * k, 0.0)]
        out.append(arcs)
    return out


def decode(span: str, lm: np.ndarray, before: str = "", after: str = "", spread: bool = False) -> str:
    """The likeliest reading of a span between plain letters by Viterbi over (two last symbols)."""
    first = (0, 0, *map(symbol, before.lower()))[-2:]
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {first: (0.0, None)}
    for arcs in readings(span, spread):
        nxt: dict = {}
        for (a, b), (score, back) in states.items():
            for text, cost in arcs:
                x, y, s = a, b, score + cost
                for c in text:
                    z = symbol(c)
                    s += lm[x, y, z]
                    x, y = y, z
                if (x, y) not in nxt or s > nxt[x, y][0]:
                    nxt[x, y] = (s, (text, back))
        states = nxt
    best, found = -math.inf, None
    rest = [*map(symbol, after.lower())] if len(after) > 1 else [*map(symbol, after.lower()), 0]
    for (x, y), (s, back) in states.items():
        for z in rest:
            s += lm[x, y, z]
            x, y = y, z
        if s > best:
            best, found = s, back
    parts = []
    while found:
        parts.append(found[0])
        found = found[1]
    return "".join(reversed(parts))


class Restorer:
    def __init__(self, lm: np.ndarray):
        self.lm = lm
        self.known: dict[tuple, str] = {}

    def reading(self, span: str, before: str = "", after: str = "", spread: bool = False) -> str:
        key = (span, before, after, spread)
        if key not in self.known:
            if len(self.known) > 1 << 17:  # a bound on memory, not on what is decoded
                self.known.clear()
            self.known[key] = decode(span, self.lm, before, after, spread)
        return self.known[key]

    def spread(self, m: re.Match) -> str:
        return self.reading(m[0], spread=True) if sum(c.isalpha() for c in m[0]) * 2 >= len(m[0].translate(_NO_SEPARATORS)) else m[0]

    def token(self, m: re.Match) -> str:
        """The word with its ambiguous stretches decoded; stretches with fewer than two plain letters between are one."""
        t = m[0]
        found = []
        for u in UNSURE.finditer(t):
            a, b = u.span()
            if u[1] or not (b - a > RUN or (a == 0 and b == len(t)) or (b == len(t) and not all(c in _LAST for c in u[0]))):
                found.append((a, b, not u[1] or b - a > 2))
        if not any(sure for _, _, sure in found):
            return t
        places: list[list[int]] = []
        for a, b, _ in found:
            if places and a - places[-1][1] < 2:
                places[-1][1] = b
            else:
                places.append([a, b])
        out, done = [], 0
        for a, b in places:
            out += [t[done:a], self.reading(t[a:b], t[max(0, a - 2) : a], t[b : b + 2])]
            done = b
        return "".join([*out, t[done:]])

    def text(self, text: str) -> str:
        """The text with ambiguous stretches decoded; vector tests find the few regions between white space that can hold any."""
        out, done = [], 0
        for a, b in suspects(text):
            out += [text[done:a], TOKEN.sub(self.token, SPREAD.sub(self.spread, text[a:b]))]
            done = b
        return "".join([*out, text[done:]]) if done else text


_NO_SEPARATORS = dict.fromkeys(map(ord, " ._*-"))


def suspects(text: str) -> list[tuple[int, int]]:
    """Regions, bounded by white space, with a look-alike beside a letter, a letter three times, or single characters spread out."""
    if len(text) < 3:
        return []
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    k = _CLASS[np.minimum(c, 255)]
    wide_ = np.flatnonzero(c > 255)
    if len(wide_):
        values, of = np.unique(c[wide_], return_inverse=True)
        k[wide_] = np.array([_class(chr(v)) for v in values], np.uint8)[of.reshape(-1)]
    letter, leet = (k & 1).astype(bool), (k & 2).astype(bool)
    marks = np.zeros(len(c), bool)
    marks[:-1] |= leet[:-1] & letter[1:]
    marks[1:] |= (k[1:] & 16).astype(bool) & letter[:-1]
    low = c | np.where(letter & (c < 128), 32, 0).astype(np.uint32)
    same = (low[1:] == low[:-1]) & letter[1:]
    marks[2:] |= same[1:] & same[:-1]
    wide = np.zeros(len(c), bool)
    alnum = np.pad((k & 32).astype(bool), 1)
    one = np.flatnonzero((letter | leet) & ~alnum[:-2] & ~alnum[2:])
    if len(one) > 2:
        gaps = np.diff(one)
        between = np.cumsum((k & 4) > 0)
        near = np.concatenate(([False], (gaps > 1) & (gaps <= 4) & (between[one[1:] - 1] - between[one[:-1]] == gaps - 1), [False]))
        begins, ends = np.flatnonzero(~near[:-1] & near[1:]), np.flatnonzero(near[:-1] & ~near[1:])
        for a, b in zip(begins, ends):
            if b - a >= 2:
                wide[one[a] : one[b] + 1] = True
    if not marks.any() and not wide.any():
        return []
    gap = (k & 8).astype(bool) & ~wide
    ends = np.append(np.flatnonzero(gap), len(c))
    pieces = np.unique(np.searchsorted(ends, np.flatnonzero(marks | wide)))
    starts = np.concatenate(([0], ends[:-1] + 1))
    return list(zip(starts[pieces].tolist(), ends[pieces].tolist()))


def words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


class Model:
    """Logistic weights of whole words and word beginnings, and what one sure feature says by itself.

    Fitted together, features that mostly come several to a document share the weight; a document with one of them
    gets at least the share of label 1 among those that have it.
    """

    def __init__(self, lm: np.ndarray, bias: float, weights: dict[str, float], alone: dict[str, float]):
        self.lm, self.bias, self.weights, self.alone = lm, bias, weights, alone
        self.of: dict[str, tuple] = {}

    def features(self, restored: str) -> set[str]:
        """Features present: 'word ' for a word, 'begin' for a beginning."""
        of, out = self.of, set()
        for w in words(restored):
            if (fs := of.get(w)) is None:
                if len(of) > 1 << 19:  # a bound on memory, not on what is scored
                    of.clear()
                fs = of[w] = tuple(f for f in (w + " ", *(w[:k] for k in PREFIXES if len(w) >= k)) if f in self.weights)
            if fs:
                out.update(fs)
        return out

    def score(self, restored: str) -> float:
        found = sorted(self.features(restored))
        return max([float(sigmoid(self.bias + sum(self.weights[f] for f in found))), *(self.alone[f] for f in found if f in self.alone)])


def fit(lm: np.ndarray, restored: list[str], labels: np.ndarray, prior: float) -> Model:
    """Keeps the features whose presence raises the odds of label 1 most surely, then fits their weights together."""
    seen: list[Counter] = [Counter(), Counter()]
    for text, y in zip(restored, labels.astype(int)):
        ws = words(text)
        seen[y].update({w + " " for w in ws} | {w[:k] for w in ws for k in PREFIXES if len(w) >= k})
    size = [float((labels == y).sum()) for y in (0, 1)]
    share = prior if 0 < prior < 1 else 0.5
    if not min(size):
        return Model(lm, math.log(share / (1 - share)), {}, {})
    gain = {}
    for f, t in seen[1].items():
        odds = math.log((t + 0.5) / (size[1] + 1)) - math.log((seen[0][f] + 0.5) / (size[0] + 1))
        if t >= max(3, size[1] * 0.002) and odds > 1.5:
            gain[f] = odds * math.sqrt(t)
    chosen = sorted(gain, key=lambda f: (-gain[f], f))[:MAX_FEATURES]
    model = Model(lm, 0.0, dict.fromkeys(chosen, 1.0), {})
    at = {f: k + 1 for k, f in enumerate(chosen)}
    x = np.zeros((len(labels), len(chosen) + 1))
    x[:, 0] = 1
    for row, text in enumerate(restored):
        for f in model.features(text):
            x[row, at[f]] = 1
    w = logistic(x, labels, ridge=0.01)
    bias = float(w[0]) + math.log(share / (1 - share)) - math.log(size[1] / size[0])
    alone = {}
    for f in chosen:
        if (t := seen[1][f]) >= SURE:
            yes, no = share * t / size[1], (1 - share) * (seen[0][f] + 1) / size[0]
            alone[f] = yes / (yes + no)
    return Model(lm, bias, {f: float(w[k]) for f, k in at.items()}, alone)


def restored_texts(docs: DataFrame, lm: np.ndarray) -> DataFrame:
    """docs with its text restored; other columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(lm)

    @F.pandas_udf("string")
    def restore(s):
        r = Restorer(shared.value)
        return s.map(lambda t: r.text(t or ""))

    return docs.withColumn("text", restore("text"))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> Model:
    counts = np.zeros(SYMBOLS**3, np.int64)
    for r in trigram_counts(docs).collect():  # at most SYMBOLS ** 3 rows
        counts[r["gram"]] = r["n"]
    lm = language_model(counts)
    sample, (n0, n1) = labelled_sample(spark, docs, labels, "toxic", FOLDS, HELD, per_class)
    total, texts, ys = 0, [], []
    for r in restored_texts(sample, lm).orderBy(F.xxhash64("doc_id"), "doc_id").toLocalIterator():
        total += len(r["text"])
        if total > max_chars:
            break
        texts.append(r["text"])
        ys.append(r["y"])
    return fit(lm, texts, np.array(ys, np.float64), (n1 + 0.5) / (n0 + n1 + 1))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of each row. The model (a cube of 28 a side and 512 weights) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        r = Restorer(m.lm)

        def step(batch: pa.RecordBatch) -> dict:
            s = [m.score(r.text(t or "")) for t in batch.column(2).to_pylist()]
            return {"doc_id": batch.column(0), "held_out": batch.column(1), "score": s, "predicted": [int(x >= CUT) for x in s]}

        return step

    return by_batch(docs.select("doc_id", (fold("doc_id", FOLDS) == HELD).alias("held_out"), "text"), "doc_id long, held_out boolean, score double, predicted int", make)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score_documents(docs, train(spark, docs, table(spark, sf_dir, "labels")))


QUERIES = {"op1_toxicity": op1_toxicity}
ORACLES: dict[str, str] = {}

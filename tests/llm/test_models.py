"""Toxicity, quality, language id and the language model: contracts, held-out accuracy, odd rows."""

import itertools
import math
import time
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from leanprompt.llm import langid, lbl, quality, toxicity

from .helpers import fold, no_documents, odd_documents, words

DIR = "/root/testdata/sf0.01"


def read(name):
    return pd.read_parquet(f"{DIR}/{name}.parquet")


def auc(score, y):
    r = pd.Series(score).rank().to_numpy()
    n1, n0 = y.sum(), (1 - y).sum()
    return (r[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


@pytest.mark.parametrize("make,label,modulus,held,cut", [(toxicity.op1_toxicity, "toxic", 4, 2, 0.3), (quality.op9_quality, "quality", 3, 1, 0.5)])
def test_classifier(spark, make, label, modulus, held, cut):
    got = make(spark, DIR).toPandas()
    assert len(got) == len(read("documents"))
    assert (got.held_out == [fold(i, modulus) == held for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= cut)).all()
    both = got.merge(read("labels").dropna(subset=[label]), on="doc_id")
    both = both[both.held_out]
    y = both[label].to_numpy()
    assert auc(both.score.to_numpy(), y) > 0.9
    assert (both.predicted.to_numpy() == y).mean() > max(y.mean(), 1 - y.mean()) + 0.02


@pytest.mark.parametrize("op,label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifier_odd_rows(spark, op, label):
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, 0), (5, 1), (None, 1), (3, None)], f"doc_id long, {label} int")
    docs = odd_documents(spark)
    got = op.score_documents(docs, op.train(spark, docs.select("doc_id", "text"), labels)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and not (r.doc_id is None and r.held_out) for r in got)
    none = op.train(spark, docs.select("doc_id", "text"), labels.limit(0))
    assert {r.score for r in op.score_documents(docs, none).collect()} == {0.5}
    assert op.score_documents(no_documents(spark), none).count() == 0


def model_of(texts):
    counts = np.zeros(toxicity.SYMBOLS**3, np.int64)
    for text in texts:
        c = [0, *map(toxicity.symbol, text.lower()), 0]
        for x in zip(c, c[1:], c[2:]):
            counts[(x[0] * toxicity.SYMBOLS + x[1]) * toxicity.SYMBOLS + x[2]] += 1
    return toxicity.language_model(counts)


@pytest.fixture(scope="module")
def lm():
    return model_of(t or "" for t in read("documents").text)


def test_deobfuscation(lm):
    """The model has read the corpus, which does not hold these words as such."""
    r = toxicity.Restorer(lm)
    forms = ["5tup1d", "stuup1d", "s t u p i d", "s.t.u.p.i.d", "s--t--u--p--i--d", "s. t. u. p. i. d", "s  t  u  p  i  d", "stuuuupid", "5tuuuup1d", "$tup!d"]
    for form in forms:
        assert r.text(f"so {form} now") == "so stupid now", form
    assert r.text("1d10000ts") != "1d10000ts"
    for plain in ("plain words stay", "in 1984 and 2024", "a book, a letter", "wow!!!", "cost 100 + 5 = 105", "it is 5 o'clock", "naïve café"):
        assert r.text(plain) == plain, plain


def test_viterbi_finds_the_best_of_all_readings(lm):
    def score(parts, before, after):
        syms = [0, 0, *map(toxicity.symbol, before)][-2:]
        total = 0.0
        for text, cost in [*parts, (after, 0.0)]:
            total += cost
            for c in text:
                total += lm[syms[-2], syms[-1], toxicity.symbol(c)]
                syms.append(toxicity.symbol(c))
        return total if len(after) > 1 else total + lm[syms[-2], syms[-1], 0]

    for span, before, after, spread in [("5tup1d", "", "", False), ("1dd10ttt", "", "s", False), ("00", "st", "ls", False), ("s-t.u p", "", "", True), ("@$$", "", "ho", False)]:
        best = max(itertools.product(*toxicity.readings(span, spread)), key=lambda x: score(x, before, after))
        got = toxicity.decode(span, lm, before, after, spread)
        assert got == "".join(x for x, _ in best)


def test_stretches_are_decoded_as_the_whole_word(lm):
    r = toxicity.Restorer(lm)
    for word in ("h4rdl1ning", "un8el1evable", "w0nderfuuuul", "1nterest1ng"):
        assert r.text(word) == toxicity.decode(word, lm)


def test_long_words_take_linear_time(lm):
    r = toxicity.Restorer(lm)
    began = time.time()
    for word in ("ab" * 500_000 + "1", "漢字" * 500_000 + "1", "a1" * 300_000, "z" * 1_000_000, "a " * 100_000):
        r.text(word)
    assert time.time() - began < 60


def test_restoring_raises_recall_on_obfuscated_words(spark):
    docs, labels = read("documents").dropna(subset=["text"]), read("labels").dropna(subset=["toxic"])
    model = toxicity.train(spark, spark.createDataFrame(docs[["doc_id", "text"]]), spark.createDataFrame(labels[["doc_id", "toxic"]]))
    restorer = toxicity.Restorer(model.lm)
    sure = {f.strip() for f in model.weights}
    both = docs.merge(labels, on="doc_id")
    bad = [t for i, t, y in zip(both.doc_id, both.text, both.toxic) if y == 1 and fold(i, 4) == 2]
    swap = str.maketrans({"o": "0", "i": "1", "e": "3", "a": "4", "s": "5"})
    hide = lambda t: " ".join(w.translate(swap) if any(w.lower().startswith(f) for f in sure) and w.isalpha() else w for w in t.split())
    hidden = [hide(t) for t in bad]
    plain = sum(model.score(t) >= toxicity.CUT for t in hidden)
    restored = sum(model.score(restorer.text(t)) >= toxicity.CUT for t in hidden)
    assert restored > plain and restored >= 0.8 * sum(model.score(t) >= toxicity.CUT for t in bad)


def test_language_model(spark):
    t = read("documents")
    got = lbl.op5_lbl(spark, DIR).toPandas().sort_values("doc_id").reset_index(drop=True)
    train = Counter()
    for i, x in zip(t.doc_id, t.text):
        if fold(i, 10):
            train.update([*words(x), ""])
    n, v = sum(train.values()), len(train)
    of = dict(zip(t.doc_id, t.text))
    for r in got.itertuples():
        ws = [*words(of[r.doc_id]), ""]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(w in train for w in ws), n, fold(r.doc_id, 10) == 0)
        want = sum(math.log10((train.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert abs(r.base_score - want) < 1e-6 * max(1, abs(want))
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_language_model_is_normalised():
    w = lbl.Words([(b"a", 5), (b"", 3), (b"b", 1)], 9, 3, {lbl.class_of(b"zz"): (4, 2)})
    scorer = lbl.Scorer(w, lbl.Parameters(w.freq))
    every = np.arange(lbl.SYMBOLS)
    lp = scorer.log_probabilities(np.full(lbl.SYMBOLS, 1), np.full(lbl.SYMBOLS, lbl.START), every)
    assert abs(np.exp(lp).sum() - 1) < 1e-3


def test_language_model_odd_rows(spark):
    docs = odd_documents(spark)
    got = lbl.score_documents(docs).collect()
    assert len(got) == docs.count() and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2)} == {1}
    assert lbl.score_documents(no_documents(spark)).count() == 0


def test_language_id(spark):
    got = langid.op3_langid(spark, DIR).toPandas()
    pages, docs = read("pages"), read("documents")[["doc_id", "lang"]].rename(columns={"lang": "true"})
    assert sorted(got.page_id) == sorted(pages.page_id)
    assert got.posterior.between(0, 1 + 1e-9).all()
    both = got.dropna(subset=["doc_id"]).merge(docs, on="doc_id")
    assert len(both) > 20 and (both.lang == both.true).mean() > 0.9


def test_language_id_odd_rows(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog with the hat", "en"), (2, "der Hund und die Katze mit dem Hut", "de"), (3, None, "en"), (4, "x", None)], "doc_id long, text string, lang string")
    rows = [(1, None, None), (2, "", ""), (None, "http://a.de/1", "<html lang=de>der Hund und die Katze"), (3, "no url", "the dog and the cat"), (3, "no url", "the dog and the cat"), (4, "http://b.de/2", "x " * 200_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")
    got = langid.identify(pages, docs).collect()
    assert len(got) == len(rows) and all(r.lang in ("en", "de") for r in got)
    assert {r.lang for r in got if r.page_id == 3} == {"en"} and {r.lang for r in got if r.page_id is None} == {"de"}
    assert langid.identify(pages.limit(0), docs).count() == 0
    assert langid.identify(pages, docs.limit(0)).count() == 0


def test_network_against_loops():
    net = quality.Network(3)
    r = np.random.default_rng(4)
    for n in (0, 1, 5, 6, 7, 508, 509, 511, 1021, 1500):
        text = "".join(chr(c) for c in r.integers(32, 300, n))
        raw = text.encode()
        while len(raw) < quality.TAPS or (len(raw) - quality.TAPS) % quality.STRIDE:
            raw += b"\0"
        windows = [sum(net.w[k, raw[a + k]].astype(np.float64) for k in range(quality.TAPS)) for a in range(0, len(raw) - quality.TAPS + 1, quality.STRIDE)]
        each = (quality.CHUNK - quality.TAPS) // quality.STRIDE + 1
        logits = [float(np.maximum(np.max(windows[a : a + each], axis=0) + net.b, 0) @ net.v + net.c[0]) for a in range(0, len(windows), each)]
        got = net.features(text)
        assert np.allclose(got, [1, np.mean(logits), min(logits), max(logits)], atol=1e-4)
    ends = {net.chunk_logits(quality.padded("some odd length of text" + c))[0] for c in "abcdefgh"}
    assert len(ends) > 1  # the last byte is read


def test_language_id_against_plain_sums(spark):
    docs = [(1, "the cat and the dog with the hat and the mouse", "en"), (2, "der Hund und die Katze mit dem Hut und der Maus", "de")]
    rows = [(1, "http://a.x.de/1", "<html lang=de>der Hund"), (2, "http://a.x.de/2", "<html lang=en>die Katze mit"), (3, "http://b.x.de/3", "the cat"), (4, "http://c.y.org/4", "<html lang=en>the dog with"), (5, "http://c.y.org/5", ""), (6, None, "<html lang=de>der Hund und")]
    got = {x.page_id: x for x in langid.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    langs = ["de", "en"]
    size = 1 << langid.BUCKETS_LOG2
    n = np.array([np.bincount(langid.grams(next(t for _, t, y in docs if y == x)), minlength=size) for x in langs], float)
    logp = np.log((n + langid.ADD) / (n.sum(1, keepdims=True) + langid.ADD * size))

    def facts(row):
        _, url, html = row
        text = html.split(">")[-1] if ">" in html else html
        text = " " + text if ">" in html else text
        g = langid.grams(text)
        z = None
        if len(g):
            m = logp[:, g].mean(1)
            z = (m - m.max()) * langid.TEMPER * min(len(g), langid.MOST)
        host = url.split("/")[2] if url else None
        return {"z": z, "said": "de" if "lang=de" in html else "en" if "lang=en" in html else None, "host": host, "domain": host and ".".join(host.split(".")[-2:]), "suffix": host and host.split(".")[-1]}

    all_ = [facts(x) for x in rows]
    verdict = [None if f["z"] is None else int(f["z"].argmax()) for f in all_]
    world = np.array([sum(v == k for v in verdict) + 1 for k in (0, 1)], float)
    world /= world.sum()

    def smooth(k, column, parent):
        if all_[k][column] is None:
            return parent
        c = np.zeros(2)
        for j, f in enumerate(all_):
            if j != k and f[column] == all_[k][column] and verdict[j] is not None:
                c[verdict[j]] += 1
        return (c + langid.SMOOTH * parent) / (c.sum() + langid.SMOOTH)

    for k, (row, f) in enumerate(zip(rows, all_)):
        post = np.log(smooth(k, "host", smooth(k, "domain", world)))
        for column in ("said", "suffix"):
            post = post + np.log(smooth(k, column, world) / world)
        post = post + (0 if f["z"] is None else f["z"])
        x = got[row[0]]
        assert x.lang == langs[int(post.argmax())] and abs(x.posterior - 1 / np.exp(post - post.max()).sum()) < 1e-9, row


def test_words_are_counted_however_often_a_task_sends_them(spark):
    texts = ["a b a c d e f", "a x y z", "", None, "B b"]
    want = Counter(w.encode() for t in texts for w in [*words(t), ""])
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    assert {bytes(r.word): r.c for r in lbl.count_words(docs, room=2).collect()} == want

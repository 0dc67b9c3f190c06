"""Batched kernels against the plain ones, and the counts that come of them."""

import random
import re

from leanprompt.operators import text as T
from leanprompt.text import automaton, protect, scoring
from leanprompt.text import compress as C
from leanprompt.text import words as W

PARTS = ["`a`", "if (x) {", "}", "A) one", "B) two", "http://x.y/z", '"q"', "\n", " ", "word", "a_b", "e.g. ", "'''", "SELECT a FROM b;", "\t", "1.2.3", "$x", "--flag", ":)", "\x0b", "0", "ſ", "K", "    ", "x = 1", "é", "10 ms", "main.py", "<b>", "f(x)", "deadbeef1", "a@b.co", "hello ", "u ", "?? ", "please ", "write ", "every "]


def texts(n):
    r = random.Random(3)
    return [None, "", " ", *("".join(r.choice(PARTS) for _ in range(r.randrange(1, 14))) for _ in range(n))]


def test_batches_mask_and_score_like_single_texts():
    words, some = W.Dictionary(["word", "hello", "please", "write", "every"]), texts(3_000)
    assert [len(p) for p in automaton.slices(["a"] * 300)] == [automaton.SLICE_TEXTS, 300 - automaton.SLICE_TEXTS]
    masks = [m for part in automaton.slices(some) for m in protect.mask_all(part)]
    assert [(m.masked, m.spans, m.names) for m in masks] == [(m.masked, m.spans, m.names) for m in map(protect.mask, some)]
    assert [x for part in automaton.slices(some) for x in scoring.efficiencies(part, words)] == [scoring.efficiency(t, words) for t in some]


def test_no_pattern_runs_where_the_automaton_rules_it_out():
    loose = automaton.loosened(re.compile(r"(?<!x)\bab[^\s(?]*(?=c)\Z", re.A | re.I))
    assert loose == r"(?i)\bab[^\s(?]*\z" and automaton.loosened(re.compile(r"(a)\1")) is None
    may = automaton.probes(["xAB", "b"])
    assert [m(re.compile(r"(?<!x)ab", re.I)) for m in may] == [True, False]


def test_census_counts_rows_apart_from_spans(spark):
    rows = spark.createDataFrame([("`a` and `b`",), ("`a` and `b`",), ("`c`",), (None,)], "text string")
    assert [tuple(r) for r in T.span_census(rows).collect()] == [("inline-code", 5, 3)]


def test_results_kept_in_compression_change_nothing_and_work_is_spread(spark):
    words = W.Dictionary(["word", "please", "explain", "list", "the"])
    prompt = "Please explain the word word in order to list the simple, easy word. In order to list 3 words."
    first = C.compress(prompt, words)
    C.compress("please list the list", words)
    assert C.compress(prompt, words) == first and C.content(prompt) is C.content(prompt)
    done = T.compressed(spark.createDataFrame([(k, f"explain word {k}") for k in range(64)], "id long, text string"), ["word", "explain"])
    values = [n for n in done._jdf.queryExecution().optimizedPlan().toString().split("\n") if "RepartitionByExpression" in n]
    assert values and done.count() == 64

"""The permutation index against all pairs: recall, exact scores, order."""

import math

import numpy as np
import pandas as pd

from leanprompt.llm import ann

from .helpers import DIR, table


def plain(ids, x, k=20, every=20):
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = (x * x[q]).sum(1)
        order = [i for i in np.lexsort((ids, -s)) if i != q][:k]
        out[int(ids[q])] = [(int(ids[i]), s[i]) for i in order]
    return out


def recall(got, want):
    found = total = 0
    for q, pairs in want.items():
        found += len({i for _, i, _ in got.get(q, [])} & {i for i, _ in pairs})
        total += len(pairs)
    return found / total


def collected(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


def test_whole_table(spark):
    t = table("embeddings")
    ids, x = t.vec_id.to_numpy(), np.array([np.asarray(v, np.float64) for v in t.embedding])
    got, want = collected(ann.op7_permutation_index(spark, DIR)), plain(ids, x)
    assert got.keys() == want.keys()
    assert recall(got, want) >= 0.9
    at = {int(i): k for k, i in enumerate(ids)}
    for q, rows in got.items():
        assert [r for r, _, _ in rows] == list(range(1, len(want[q]) + 1))
        assert all(abs(s - x[at[q]] @ x[at[i]]) < 1e-12 for _, i, s in rows)
        assert rows == sorted(rows, key=lambda r: (-r[2], r[1]))


def test_recall_when_few_are_reranked(spark):
    r = np.random.default_rng(3)
    centres = r.standard_normal((40, 16))
    x = (centres[r.integers(0, 40, 4000)] + 0.35 * r.standard_normal((4000, 16))).astype(np.float32).astype(np.float64)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collected(ann.nearest(df, block=1024))
    assert recall(got, plain(np.arange(4000), x)) >= 0.9


def test_recall_on_real_vectors_by_default(spark):
    t = pd.read_parquet("/root/testdata/sf0.1/embeddings.parquet")
    ids, x = t.vec_id.to_numpy(), np.array([np.asarray(v, np.float64) for v in t.embedding])
    want = plain(ids, x)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    for how in ({}, {"block": 600}):
        assert recall(collected(ann.nearest(df, **how)), want) >= 0.9
    index = ann.Block(ids, x, ann.spread(ann.unit(x, np.zeros(len(x))), ann.PIVOTS), 1.0, ann.PREFIX).index
    place = index.lists(ann.unit(x[:1], np.zeros(1)))[0]
    assert len(index.candidates(place, math.ceil(ann.SHARE * len(x)))) < 0.2 * len(x)


def test_footrule_ranks_as_its_definition(spark):
    r = np.random.default_rng(2)
    x = r.standard_normal((80, 8))
    top = float(np.sqrt((x * x).sum(1).max()))
    index = ann.Index(x, ann.spread(ann.unit(x, np.zeros(80)), 20), top, 7)
    lists = index.lists(ann.unit(x, np.sqrt(np.maximum(0, top * top - (x * x).sum(1)))))
    query = index.lists(ann.unit(x[3:4], np.zeros(1)))[0].tolist()
    far = lambda a: sum(abs((query.index(p) if p in query else 7) - (a.index(p) if p in a else 7)) for p in {*query, *a})
    rule = np.array([far(a) for a in lists.tolist()])
    for want in (5, 20, 50):
        assert sorted(index.candidates(np.array(query), want)) == sorted(np.flatnonzero(rule <= np.sort(rule)[want - 1]))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (40, None), (60, [0.0, 0.0]), (80, [nan, 1.0]), (100, [None, 1.0]), (120, [inf, 1.0]), (None, [1.0, 1.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0]), (140, [])]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, score string, query string")
    got = collected(ann.nearest(df))
    assert got == {0: [(1, 2, 2.0), (2, 1, 1.0), (3, 20, 1.0)], 20: [(1, 2, 2.0), (2, 0, 1.0), (3, 1, 1.0)]}
    assert ann.nearest(df.limit(0)).count() == 0
    assert ann.nearest(df.where("vec_id in (0, 40)")).count() == 0


def test_a_crowd_of_copies(spark):
    rows = [(i, [1.0, 2.0]) for i in range(300)] + [(1000 + i, [1.0, 1.5 + i / 100]) for i in range(40)]
    x = np.array([v for _, v in rows])
    got = collected(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=64))
    assert recall(got, plain(np.array([i for i, _ in rows]), x)) == 1

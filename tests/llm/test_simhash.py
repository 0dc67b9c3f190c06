"""SimHash against a plain version that compares every two fingerprints."""

import itertools
import random

import numpy as np
import xxhash

from leanprompt.llm import simhash

from .helpers import DIR, no_documents, odd_documents, table, words


def plain_fingerprint(text, size=4):
    ws = words(text)
    runs = [ws[i : i + size] for i in range(len(ws) - size + 1)] if len(ws) > size else [ws] if ws else []
    hs = [xxhash.xxh64_intdigest(" ".join(r).encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain(rows, radius=4):
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    of = {i: i for i, _ in prints}
    changed = True
    near = [(a, b) for (a, x), (b, y) in itertools.combinations([p for p in prints if p[0] is not None], 2) if (x ^ y).bit_count() <= radius]
    while changed:
        changed = False
        for a, b in near:
            if of[a] != of[b]:
                of[a] = of[b] = min(of[a], of[b])
                changed = True
    return sorted(((i, f"{f:016x}", None if i is None else of[i]) for i, f in prints), key=str)


def test_whole_table(spark):
    got = sorted(map(tuple, simhash.op2_simhash(spark, DIR).collect()), key=str)
    t = table("documents")
    assert got == plain(list(zip(t.doc_id, t.text)))


def test_small_tiles_lose_no_link(spark):
    t = table("documents")
    docs = spark.createDataFrame([(int(i), x) for i, x in zip(t.doc_id, t.text)], "doc_id long, text string")
    got = sorted(((r[0], bytes(r[1]).hex(), r[2]) for r in simhash.near_duplicates(docs, tile=8).collect()), key=str)
    assert got == plain(list(zip(t.doc_id, t.text)))


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = sorted(((r[0], bytes(r[1]).hex(), r[2]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == plain([(r.doc_id, r.text) for r in docs.collect()])
    assert simhash.near_duplicates(no_documents(spark)).count() == 0


def test_one_of_each_group_stays(spark):
    base = " ".join(f"w{i}" for i in range(300))
    near = base.replace("w150", "x")
    rows = [(7, base), (8, base), (9, near), (10, " ".join(f"z{i}" for i in range(300))), (10, "repeated id"), (None, base)]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [10, 7, None]
    assert simhash.drop_near_duplicates(no_documents(spark)).count() == 0


def test_shared_filler_is_no_near_duplicate(spark):
    rows = [(i, "filler " * 2_000 + " ".join(f"d{i}w{k}" for k in range(300))) for i in range(6)]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(6))


def plain_groups(rows, similarity=0.8, size=5):
    """The smallest doc_id of each group linked by exact Jaccard similarity."""
    sets = {}
    for i, t in rows:
        ws = words(t)
        sets[i] = {tuple(ws[k : k + size]) for k in range(len(ws) - size + 1)} if len(ws) > size else {tuple(ws)}
    of = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(sets, 2):
            if of[a] != of[b] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                of[a] = of[b] = min(of[a], of[b])
                changed = True
    return sorted(set(of.values()))


def test_links_are_verified_exactly(spark):
    rows = []
    for g in range(12):
        base = [f"g{g}w{k}" for k in range(300)]
        for v, edits in enumerate((0, 1, 2, 3, 4, 5, 6, 7, 8)):
            ws = list(base)
            for e in range(edits):
                ws[20 + 30 * e] = f"x{v}e{e}"
            rows.append((100 * g + v, " ".join(ws)))
    want = plain_groups(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for tile in (2_048, 3):
        assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs, tile=tile).collect()) == want


def test_recall_against_all_pairs_at_every_similarity(spark):
    """Copies of random texts of many lengths with ever more words replaced: links at 0.8 and above must be found."""
    r = random.Random(8)
    rows = []
    for g in range(60):
        base = [f"g{g}w{k}" for k in range(r.choice([12, 40, 150, 400]))]
        for v in range(5):
            ws = list(base)
            for k in r.sample(range(len(ws)), min(len(ws), r.randrange(0, 1 + len(ws) // 30))):
                ws[k] = f"x{v}k{k}"
            rows.append((100 * g + v, " ".join(ws)))
    want = set(plain_groups(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for tile in (2_048, 4):
        got = {x.doc_id for x in simhash.drop_near_duplicates(docs, tile=tile).collect()}
        assert want <= got and len(got - want) <= 0.01 * (len(rows) - len(want)), tile


def test_a_passage_that_many_share_links_nothing(spark):
    passage = " ".join(f"p{k}" for k in range(120))
    rows = [(i, passage + " " + " ".join(f"d{i}w{k}" for k in range(60 + i % 7))) for i in range(150)] + [(1000 + i, "clause " + passage + f" end {i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(x.doc_id for x in simhash.drop_near_duplicates(docs, tile=16).collect()) == plain_groups(rows)


def test_prefix_filter_loses_no_pair():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60, r.integers(1, 40)).astype(np.uint64)) for _ in range(120)]
    got = {(min(x, y), max(x, y)) for i, j in simhash.prefix_pairs(sets, np.arange(120), 0.8) for x, y in zip(i.tolist(), j.tolist())}
    want = {(i, j) for i, j in itertools.combinations(range(120), 2) if simhash.jaccard(sets[i], sets[j]) >= 0.8}
    assert want <= got


def test_among_keeps_every_partner(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(5_000)] + [(None, "null")], "doc_id long, text string")
    ids = rows.where("doc_id % 10 = 3").select("doc_id").unionByName(rows.where("doc_id is null").select("doc_id"))
    got = [r.doc_id for r in simhash.among(rows, "doc_id", ids).collect()]
    assert {i for i in range(5_000) if i % 10 == 3} <= set(got) and len(got) < 600
    assert not simhash.among(rows, "doc_id", ids.limit(0)).collect()
    assert not simhash.among(rows.limit(0), "doc_id", ids).collect()


def test_without_is_exact_however_full_the_bitmaps(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(3_000)] + [(7, "again"), (8, "again")], "doc_id long, text string")
    gone, stay = (spark.createDataFrame([(i,) for i in range(3_000) if (i % 10 == 8) == x], "other long") for x in (True, False))
    want = sorted([(i, f"t{i}") for i in range(3_000) if i % 10 != 8] + [(7, "again")])
    for bits in (27, 12, 8):
        monkeypatch.setattr(simhash, "BITS", bits)
        assert sorted(map(tuple, simhash.without(rows, "doc_id", gone, stay).collect())) == want
        assert not simhash.without(rows, "doc_id", gone.unionByName(stay), stay.limit(0)).collect()
        assert simhash.without(rows, "doc_id", gone.limit(0), stay.unionByName(gone)).count() == 3_002


def test_the_result_shuffles_no_texts(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(7, base), (8, base), (9, base.replace("w150", "x"))] + [(i, " ".join(f"d{i}w{k}" for k in range(100))) for i in range(10, 40)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the ids are many
    try:
        kept = simhash.drop_near_duplicates(docs)
        assert "Exchange" not in kept._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.doc_id for r in kept.collect()) == [7, *range(10, 40)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)

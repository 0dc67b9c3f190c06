"""Decontamination against every stretch, tool calls against SQL, and the pipeline against its parts."""

import json
import random

import duckdb
import public_tokenizers

import corpus_pipeline
from leanprompt.llm import bpe, chat, decontaminate, pii

from .helpers import DIR, no_documents, odd_documents, table


def test_whole_table_against_all_pairs(spark):
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.op4_decontaminate(spark, DIR).collect()}
    items = [(i, decontaminate.words(t)) for i, t in zip(table("benchmark").item_id, table("benchmark").text)]
    want = {}
    for d, t in zip(table("documents").doc_id, table("documents").text):
        ws = decontaminate.words(t)
        for i, item in items:
            if item and len(set(ws) & set(item)) >= 0.5 * len(set(item)):
                edits, _ = decontaminate.distance(item, ws)
                if edits <= int(decontaminate.EDITS * len(item)):
                    want[int(d), int(i)] = edits
    assert got.keys() <= want.keys()
    assert all(got[k] == want[k] for k in got)
    assert len(got) >= 0.95 * len(want)


def test_distance():
    def plain(item, text):
        row = list(range(len(item) + 1))
        best = row[-1]
        for w in text:
            new = [0]
            for k, v in enumerate(item):
                new.append(min(row[k] + (v != w), row[k + 1] + 1, new[-1] + 1))
            row = new
            best = min(best, row[-1])
        return best

    r = random.Random(2)
    for _ in range(500):
        item, text = ([r.choice([b"a", b"b", b"c"]) for _ in range(r.randrange(1, n))] for n in (12, 40))
        assert decontaminate.distance(item, text)[0] == plain(item, text)


def test_edited_items_are_found(spark):
    r = random.Random(4)
    vocabulary = [f"w{k}" for k in range(3_000)]
    items = [[r.choice(vocabulary) for _ in range(r.randrange(20, 90))] for _ in range(60)]
    docs = []
    for d, item in enumerate(items):
        ws = list(item)
        for _ in range(len(item) // 20):
            k = r.randrange(len(ws))
            ws[k : k + 1] = r.choice([[], ["new"], [ws[k], "new"]])
        docs.append((d, " ".join([*(r.choice(vocabulary) for _ in range(150)), *ws, *(r.choice(vocabulary) for _ in range(150))])))
    clean = [(1000 + d, " ".join(r.choice(vocabulary) for _ in range(300))) for d in range(60)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(spark.createDataFrame(docs + clean, "doc_id long, text string"), bench).collect()}
    assert got <= {(k, k) for k in range(60)} and len(got) >= 57


def test_edits_among_the_first_words(spark):
    r = random.Random(5)
    vocabulary = [f"w{k}" for k in range(3_000)]
    items = [[r.choice(vocabulary) for _ in range(n)] for n in (15, 20, 25, 40) for _ in range(10)]
    changes = [lambda w: [w[0], *w[2:]], lambda w: w[1:], lambda w: ["new", "newer", *w[2:]], lambda w: w[3:], lambda w: ["new", *w[1:2], "newer", *w[3:]]]
    docs = []
    for k, item in enumerate(items):
        for j, change in enumerate(changes):
            around = [[r.choice(vocabulary) for _ in range(n)] for n in (r.choice([0, 50]), r.choice([0, 50]))]
            docs.append((len(changes) * k + j, " ".join([*around[0], *change(item), *around[1]])))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {(d, d // len(changes)) for d, _ in docs}


def test_recall_at_all_allowed_edits_does_not_fall_with_length(spark):
    r = random.Random(7)
    vocabulary = [f"w{k}" for k in range(5_000)]
    items, docs = [], []
    for n in (8, 10, 15, 20, 40, 80):
        for _ in range(50):
            item = [r.choice(vocabulary) for _ in range(n)]
            ws = list(item)
            for k in sorted(r.sample(range(n), int(decontaminate.EDITS * n)), reverse=True):
                ws[k : k + 1] = r.choice([[], ["new"], [ws[k], "new"]])
            docs.append((len(items), " ".join([*(r.choice(vocabulary) for _ in range(60)), *ws, *(r.choice(vocabulary) for _ in range(60))])))
            items.append((len(items), " ".join(item), n))
    bench = spark.createDataFrame(items, "item_id long, text string, n int")
    got = {x.item_id for x in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect() if x.doc_id == x.item_id}
    for n in (8, 10, 15, 20, 40, 80):
        of_size = [i for i, _, k in items if k == n]
        assert len(got.intersection(of_size)) >= 0.98 * len(of_size), n


def test_short_items_against_all_pairs(spark):
    r = random.Random(7)
    vocabulary = [f"w{k}" for k in range(40)]
    items = [[r.choice(vocabulary) for _ in range(1 + k % 7)] for k in range(70)]
    docs = [[r.choice(vocabulary) for _ in range(r.randrange(0, 60))] for _ in range(300)]
    for d, item in enumerate(items[3:]):  # copies, some with one edit, also at the ends of a text
        ws, k = list(item), r.randrange(len(item))
        ws[k : k + 1] = r.choice([ws[k : k + 1], [], ["new"], ["new", ws[k]]])
        docs[d] = [*docs[d][: r.choice([0, 20])], *ws, *docs[d][: r.choice([0, 20])]]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(99, "- !"), (98, "")], "item_id long, text string")
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(docs)], "doc_id long, text string")
    got = {(x.doc_id, x.item_id): (x.edits, x.end) for x in decontaminate.contaminated(frame, bench).collect()}
    want = {}
    for d, ws in enumerate(docs):
        for i, item in enumerate(items):
            found = decontaminate.distance([w.encode() for w in item], [w.encode() for w in ws])
            if found[0] <= int(decontaminate.EDITS * len(item)):
                want[d, i] = found
    assert got == want and any(e for e, _ in want.values())


def test_contamination_odd_rows(spark):
    docs = odd_documents(spark)
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over a lazy dog the quick brown fox"), (1, "the quick brown fox jumps over a lazy dog the quick brown fox"), (2, None), (3, ""), (None, "plain words of a plain text and some more")], "item_id long, text string")
    assert [tuple(r)[:3] for r in decontaminate.contaminated(docs, bench).collect()] == [(3, 1, 0)]
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(no_documents(spark), bench).count() == 0


def test_tool_calls_match_sql(spark):
    c = duckdb.connect()
    c.sql(f"create view conversations as select * from '{DIR}/conversations.parquet'")
    want = c.sql(chat.ORACLE)
    got = chat.op6_tool_calls(spark, DIR).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_tool_calls_odd_rows(spark):
    args = '{"turn":0,"text":"x"}'
    calls = spark.createDataFrame([(1, "a", "reply", args), (1, "b", "reply", '{"text":null,"turn":1}'), (1, "c", "reply", args), (1, "d", "nosuch", args), (1, "e", "reply", '{"text":5,"turn":"x"}'), (1, "f", "reply", "no json"), (1, "g", "reply", None), (1, "h", "reply", "[1]")], "scope long, id string, tool string, arguments string")
    results = spark.createDataFrame([(1, "a", "out"), (1, "zz", "orphan")], "scope long, id string, output string")
    depends = spark.createDataFrame([(1, "b", "a"), (1, "c", "d"), (1, "d", "c")], "scope long, id string, parent string")
    got = {r.id: r for r in chat.link(calls, results, depends).collect()}
    assert [(got[k].level, got[k].status) for k in "abcd"] == [(0, "linked"), (1, "invalid"), (None, "cycle"), (None, "cycle")]
    assert got["a"].json == '{"arguments":{"text":"x","turn":0},"id":"a","name":"reply","result":"out"}'
    assert {k: got[k].violations for k in "bdefgh"} == {"b": "text: missing", "d": "unknown tool", "e": "text: not string,turn: not integer", "f": "arguments: not an object", "g": "arguments: not an object", "h": "arguments: not an object"}
    assert (got["zz"].status, got["zz"].tool, got["zz"].level) == ("orphan", None, None)
    assert chat.link(calls.limit(0), results.limit(0), depends.limit(0)).count() == 0


def test_tool_calls_of_odd_conversations(spark, tmp_path):
    every = "".join(map(chr, range(1, 300))) + "\u2028\U0001f600"
    long = "long text " * 200_000
    rows = [(1, 0, "system", "s"), (1, 3, "user", every), (1, 4, "assistant", every), (1, 5, "assistant", "late"), (1, 5_000, "user", long), (1, 5_001, "assistant", ""), (1, 5_001, "assistant", ""), (2, 0, "user", None), (2, 1, "assistant", None), (2, 9, "assistant", "orphan"), (None, 1, "user", "x"), (3, None, "user", "x"), (4, 0, None, "x"), (5, 0, "user", "b"), (5, 0, "user", "a")]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "conv_id long, turn long, role string, text string, id string, level string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    c = duckdb.connect()
    c.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = c.sql(chat.ORACLE)
    got = chat.op6_tool_calls(spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)
    at = {(r.conv_id, r.turn): r for r in got}
    assert json.loads(at[1, 3].json)["arguments"]["text"] == every == json.loads(at[1, 3].json)["result"]
    assert (at[1, 5_000].level, at[5, 0].json.count('"a"')) == (2, 1)
    assert [r.status for r in got if r.turn is None] == ["orphan", "orphan"]


def test_every_earlier_turn_is_found_across_runs(spark):
    r = random.Random(3)
    turns = {(s, r.randrange(-5_000, 20_000)) for s in (1, 2) for _ in range(60)}
    got = {(x.scope, x.turn): x.before for x in chat.nearest_earlier(spark.createDataFrame(sorted(turns), "scope long, turn long")).collect()}
    want = {(s, t): max((u for v, u in turns if v == s and u < t), default=None) for s, t in turns}
    assert got == {k: v for k, v in want.items() if v is not None}


def test_pipeline(spark):
    docs = corpus_pipeline.table(spark, DIR, "documents")
    kept, counts = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.keep(stage(spark, kept, DIR))
        assert kept.columns == docs.columns
        counts.append(kept.count())
    assert docs.count() >= counts[0] >= counts[1] >= counts[2] == counts[3] > 0
    assert all("@" not in (r.text or "") or not [s for s in pii.find(r.text) if s[0] == "email"] for r in kept.collect())
    want = {tuple(r) for r in bpe.encode_documents(kept, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()}
    assert {tuple(r) for r in corpus_pipeline.run(spark, DIR).collect()} == want

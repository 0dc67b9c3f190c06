"""Stores, interchange, streaming capture and ingest on literal rows."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from leanprompt.operators import classifier, ingest
from leanprompt.sources import store as S
from leanprompt.streaming import capture

T0 = datetime(2024, 1, 1)


def test_history_store(spark, tmp_path):
    h = S.history(spark, str(tmp_path / "h"))
    assert h.read().count() == 0
    turn = lambda k: spark.createDataFrame([(f"p{k}", T0 + timedelta(days=k // 2), "x")], "prompt string, timestamp timestamp, clash string")
    for k in range(5):
        S.save_turn(h, turn(k), cap=4)
    assert [r.prompt for r in h.read().orderBy("seq").collect()] == ["p1", "p2", "p3", "p4"]
    S.delete_turn(h, T0 + timedelta(days=1))
    assert [r.prompt for r in h.read().orderBy("seq").collect()] == ["p1", "p4"]
    h.clear()
    assert h.read().count() == 0 and h.read().columns[0] == "seq"


def test_event_log(spark, tmp_path):
    log = S.Store(spark, str(tmp_path / "log"), S.LOG)
    rows = [(k, "kind", None if k % 2 else "warn", "m" * (400 if k == 7 else 3), {f"k{i}": "v" for i in range(15)} if k == 7 else None, "https") for k in range(8)]
    S.append_log(log, spark.createDataFrame(rows, S.LOG), cap=5)
    got = {r.t: r for r in log.read().collect()}
    assert sorted(got) == [3, 4, 5, 6, 7] and len(got[7].m) == 301 and len(got[7].d) == 12 and got[7].lvl == "info"
    lines = {r.t: r.line for r in S.log_lines(log.read()).collect()}
    assert lines[4] == "1970-01-01T00:00:00.004Z  WARN   kind  mmm" and '"k0":"v"' in lines[7]
    assert [r.t for r in S.filter_log(log.read(), problems=True).collect()] == [6, 4] and S.filter_log(log.read(), "K3").count() == 1
    S.export_log(log.read(), str(tmp_path / "a"))
    S.export_log(log.read(), str(tmp_path / "b"), lines=True)
    assert spark.read.text(str(tmp_path / "b")).count() == spark.read.json(str(tmp_path / "a")).count() == 5


def test_csv_settings_dictionary_reports(spark, tmp_path):
    rows = spark.createDataFrame([("=1+1", -5, None), ('say "hi"', 2, "@x"), ("plain", None, "\tt")], "a string, b int, c string")
    header, lines = S.csv_lines(rows, [("a", "A"), ("b", "B"), ("c", 'C"')])
    assert header == '"A","B","C"""'
    assert [r.line for r in lines.collect()] == ["\"'=1+1\",\"-5\",\"\"", '"say ""hi""","2","\'@x"', '"plain","","\'\tt"']
    p = str(tmp_path / "s")
    S.set_setting(spark, p, "theme", "dark")
    S.set_setting(spark, p, "theme", "light")
    assert S.settings(spark, p, {"theme": "auto", "isEnabled": True}) == {"theme": "light", "isEnabled": True}
    d = S.Store(spark, str(tmp_path / "d"), "word string")
    S.change_dictionary(d, add=["  Foo  Bar ", "foo bar", "", "x" * 80])
    S.change_dictionary(d, add=["baz"], remove=["FOO bar"])
    assert sorted(r.word for r in d.read().collect()) == ["baz", "x" * 64]
    r = S.Store(spark, str(tmp_path / "r"), S.REPORT)
    S.add_report(r, spark.createDataFrame([(f"f{k}", T0 + timedelta(days=k)) for k in range(6)], "finding string, timestamp timestamp"), cap=4)
    assert sorted(x.finding for x in r.read().collect()) == ["f2", "f3", "f4", "f5"]


def test_corpus_sources(spark, tmp_path):
    (tmp_path / "train.json").write_text(json.dumps([{"prompt": " a prompt ", "optimized_prompt": "", "good_res": "x"}, {"prompt": " "}, {"prompt": "b", "optimized_prompt": "c"}]))
    got = S.pairs(spark, {"train": str(tmp_path / "train.json")}).orderBy("seq").collect()
    assert [(r.prompt, r.optimized_prompt, r.split) for r in got] == [("a prompt", None, "train"), ("b", "c", "train")]
    schema = "conversation array<struct<role: string, content: string>>, openai_moderation array<struct<categories: map<string, boolean>>>, language string, redacted boolean"
    talk = lambda *x: list(x)
    raw = [(talk(("system", "s"), ("User", " hi ")), [({"a": True},), ({"a": False},)], "en", True), (talk(("user", "bad")), [({"a": True},)], "en", False), (talk(("user", "short")), [], "en", None), (talk(("assistant", "x")), None, None, None), (None, None, None, None), (talk(("user", "none")), None, None, None)]
    assert sorted(r.prompt for r in S.conversations(spark.createDataFrame(raw, schema)).collect()) == ["hi", "none", "short"]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "batch_1.jsonl").write_text('{"text": "t1", "label": "FILLER"}\nnot json\n{"text": "t2", "label": "FILLER", "batch": "own"}\n')
    good, bad = S.manual_batches(spark, str(tmp_path / "m"))
    assert sorted((r.text, r.batch) for r in good.collect()) == [("t1", "batch_1"), ("t2", "own")] and [r.value for r in bad.collect()] == ["not json"]
    replies = spark.createDataFrame([('Here: ```[{"text": " a "}, {"text": "b", "label": "important"}, {"text": ""}]``` done', "FILLER"), ("no array", "FILLER"), ("[broken", "FILLER"), (None, "FILLER")], "raw string, label string")
    assert sorted(tuple(r) for r in S.salvage(replies).collect()) == [("a", "FILLER", ""), ("b", "IMPORTANT", "")]
    (tmp_path / "p.csv").write_text('text,label,source\n"a, b",FILLER,\n,FILLER,x\nc,,x\nd,FILLER,gen\n')
    assert sorted(tuple(r) for r in S.phrases(spark, str(tmp_path / "p.csv")).collect()) == [("a, b", "FILLER", "seed"), ("d", "FILLER", "gen")]


def test_corpus_sink_resumes(spark, tmp_path):
    p = str(tmp_path / "corpus")
    df = spark.createDataFrame([("a", "s1", "x", None), ("b", "s2", "y", "z"), ("b", "s2", "y", "z")], "id string, source string, task_category string, optimized_prompt string")
    assert S.write_shards(df.where("id = 'a'"), p) == 1 and S.write_shards(df, p) == 1 and S.write_shards(df, p) == 0
    corpus = S.read_corpus(spark, p, ["id", "source", "task_category", "optimized_prompt", "nosuch"])
    assert corpus.count() == 2 and {(r.source, r.task_category): (r.n, r.rewritten) for r in S.corpus_stats(corpus).collect()}[None, None] == (2, 1)
    S.export_sample(corpus, str(tmp_path / "out"), limit=1)
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_ingest_cases(spark):
    texts = ["How are you ?", "how are you", "Implement a C# function", "Implement a C++ function", "short", None, "​​​​​​​​​", "x" * 8_001, "x" * 8_000, "mail bob@example.org, not `bob@example.org`, card 4111 1111 1111 1111, ssn 123-45-6789, Bearer abcdefghijklmnopqrstuvwx, sk-abcdefghijklmnop12", "version 1.2.3 at 1920 x 1080 for $12.50 id 12345678901"]
    rows = spark.createDataFrame(list(enumerate(texts)), "seq long, prompt string").withColumn("optimized_prompt", F.lit(None).cast("string"))
    assert [r.reason for r in ingest.screen(rows).orderBy("seq").collect()] == [None, "duplicate", None, None, "too_short", "empty", "empty_after_sanitise", "too_long", None, None, None]
    got = {r.seq: r for r in ingest.ingest(rows).collect()}
    assert got[9].prompt == "mail [EMAIL], not `bob@example.org`, card [CARD], ssn [SSN], Bearer [TOKEN], [API_KEY]" and got[9].redactions == 5
    assert got[10].prompt == texts[10] and got[10].redactions == 0 and [got[k].task_category for k in (0, 2)] == ["factual", "code"]
    corpus = rows.withColumns({"optimized_prompt": F.when(F.col("seq") == 0, "how are you?").when(F.col("seq") == 2, "other"), "shard": F.lit("s")})
    clean, stats = ingest.reclean(corpus)
    assert {r.seq: r.optimized_is_copy for r in clean.collect() if r.seq in (0, 2, 3)} == {0: True, 2: False, 3: None}
    assert stats.select("rows_in", "rows_out", "duplicate", "empty", "copies").first() == (11, 8, 1, 2, 1)
    assert ingest.ingest(rows.limit(0)).count() == 0


def test_phrases_and_near_duplicates(spark):
    rows = [(1, "explain recursion simply to me", "FILLER"), (2, "explain recursion simply to me!", "FILLER"), (3, "explain recursion simply for me", "FILLER"), (4, "debug it, find the bug and fix the bug", "REPETITIVE"), (5, "say nothing new here", "REPETITIVE"), (6, "bad", "FILLER"), (7, "x" * 321, "FILLER"), (8, "some old phrase", "FILLER"), (9, "label missing here", None), (10, "import os in code", "FILLER")]
    p = spark.createDataFrame(rows, "seq long, text string, label string").withColumns({"context": F.lit(""), "batch": F.lit("b")})
    got = {r.seq: (r.reason, r.flags) for r in ingest.validate_phrases(p, spark.createDataFrame([("Some old phrase.",)], "text string"), 0.6).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: None, 2: "exact-duplicate", 3: "near-duplicate", 4: None, 5: None, 6: "too-short", 7: "too-long", 8: "duplicate-of-original-dataset", 9: "bad-schema", 10: None}
    assert {k: v[1] for k, v in got.items() if v[1]} == {5: "repetitive-with-nothing-to-repeat", 10: "removable-label-on-code-or-url"}
    texts = spark.createDataFrame([(1, "the same words"), (2, "the same words"), (3, "nothing alike")], "id long, text string")
    assert [(r.id, r.of) for r in ingest.near_duplicates(texts).collect()] == [(2, 1)]
    assert [r.id for r in ingest.leakage(texts, texts.where("id = 1")).collect()] == [3]
    t = spark.createDataFrame([("FILLER", "so {topic}"), ("FILLER", "um {topic}")], "label string, template string")
    assert ingest.augment(p, t, spark.createDataFrame([("a",), ("b",)], "topic string"), 3).count() == 3


def test_stream_equals_batch_and_drops_late_rows(spark, tmp_path):
    ms = lambda k: T0 + timedelta(milliseconds=k)
    schema = "conv_id long, turn long, ts timestamp, prompt string, response string, streaming boolean"
    rows = [(1, 1, ms(0), "ask", "par", True), (1, 1, ms(500), "ask", "partial", True), (1, 1, ms(1_000), "ask", "partial reply", False), (1, 2, ms(5_000), "next", "Something went wrong", False), (1, 3, ms(9_000), "ask", "partial reply", False), (2, 1, ms(9_000), "see http://a.b", "yes", False), (2, 2, ms(9_500), "x", "still", True)]
    events = spark.createDataFrame(rows, schema)
    batch = capture.capture(events).select("conv_id", "prompt", "response", "totalTokens").collect()
    assert sorted(map(tuple, batch)) == [(1, "ask", "partial reply", 4), (2, "see http://a.b", "yes", 2005)]
    src = str(tmp_path / "in")
    events.coalesce(1).write.parquet(src)
    late = [(9, 9, ms(0), "late", "late reply", False), (8, 8, ms(7_200_000), "end", "end", False)]
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = capture.capture(stream).writeStream.format("memory").queryName("captured").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="0 seconds").start()
    q.processAllAvailable()
    spark.createDataFrame(late[1:], schema).coalesce(1).write.mode("append").parquet(src)
    q.processAllAvailable()
    spark.createDataFrame(late[:1], schema).coalesce(1).write.mode("append").parquet(src)
    q.processAllAvailable()
    q.stop()
    got = spark.table("captured").select("conv_id", "prompt", "response", "totalTokens").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch))
    inputs = spark.createDataFrame([(1, ms(0), "hel"), (1, ms(50), "hello"), (1, ms(400), "hello you"), (1, ms(900), "hi")], "conv_id long, ts timestamp, text string")
    assert sorted(r.text for r in capture.debounced_input(inputs).collect()) == ["hello", "hello you"]
    assert [r.changes for r in capture.throttled(inputs).orderBy("start").collect()] == [2, 1, 1]
    edits = spark.createDataFrame([(1, ms(k), f"e{k}", k == 3) for k in range(11)], "conv_id long, ts timestamp, text string, sent boolean")
    assert capture.undo_stack(edits).first().stack == ["e6", "e7", "e8", "e9", "e10"]
    arrivals = spark.createDataFrame([(ms(0), ms(0)), (ms(1), ms(3_600_000)), (ms(2), ms(0)), (ms(7_200_000), ms(7_200_000))], "arrival timestamp, ts timestamp")
    assert {r.late: r.n for r in capture.late_rows(arrivals).collect()} == {False: 3, True: 1}


def test_classifier_algebra_and_training(spark, tmp_path):
    import math

    vocabulary = spark.createDataFrame([("write", 0, 1.5), ("please", 1, 2.0), ("write it", 2, 3.0)], "term string, idx int, idf double")
    weights = {"IMPORTANT": {0: 1.0, 2: 0.5}, "FILLER": {1: 2.0}}
    flat = [(k, -1, 0.1 if k == "FILLER" else 0.0) for k in weights] + [(k, j, w) for k, ws in weights.items() for j, w in ws.items()]
    model = classifier.Model(vocabulary, spark.createDataFrame(flat, "label string, idx int, w double"), classifier.Settings(2, True))
    rows = spark.createDataFrame([(1, "Write it, write it please"), (2, "please"), (3, "please please"), (4, None), (5, "")], "id long, text string")
    got = {r.id: r for r in classifier.classify(rows, model).collect()}
    assert set(got) == {1, 3}
    raw = [(1 + math.log(2)) * 1.5, 2.0, (1 + math.log(2)) * 3.0]
    v = [x / math.sqrt(sum(y * y for y in raw)) for x in raw]
    z = {"IMPORTANT": v[0] + 0.5 * v[2], "FILLER": 2 * v[1] + 0.1}
    keep = math.exp(z["IMPORTANT"]) / sum(map(math.exp, z.values()))
    assert abs(got[1].keep - keep) < 1e-12 and got[3].label == "FILLER" and got[1].label == max(z, key=z.get)
    data = [(k, f"please kindly thanks so much number {k}" if k % 2 else f"write exactly {k} words in python", "FILLER" if k % 2 else "IMPORTANT") for k in range(60)]
    df = spark.createDataFrame(data, "id long, text string, label string")
    fitted = classifier.train(df)
    fitted.save(str(tmp_path / "m"))
    again = classifier.Model.load(spark, str(tmp_path / "m"))
    assert classifier.keep_drop_accuracy(df, again) == 1.0 == classifier.keep_drop_accuracy(df, fitted)
    pairs = spark.createDataFrame([("IMPORTANT", "IMPORTANT"), ("IMPORTANT", "FILLER"), ("FILLER", "FILLER"), ("REDUNDANT", "FILLER")], "label string, predicted string")
    m = {r.name: r for r in classifier.metrics(pairs).collect()}
    assert (m["IMPORTANT"].precision, m["IMPORTANT"].recall, m["FILLER"].recall, m["accuracy"].recall, m["keep-drop"].recall) == (1.0, 0.5, 1.0, 0.5, 0.75)
    parts = classifier.folds(df, 4).groupBy("label", "fold").count().collect()
    assert {r["count"] for r in parts} <= {7, 8}


@pytest.mark.parametrize("images,pills,want", [(2, ["a 4 KB", "b"], 340 + 1024 + 2000), (None, None, 0)])
def test_attachments(spark, images, pills, want):
    from leanprompt.operators.native import attachment_tokens, token_stats

    df = spark.createDataFrame([("see http://a.b", images, pills)], "p string, i int, d array<string>")
    assert df.select(attachment_tokens(F.col("p"), F.col("i"), F.col("d"))).first()[0] == want + 2000
    s = df.select(token_stats(F.lit("a b"), F.lit("a longer text than before")).alias("s")).first().s
    assert s.saved < 0 and s.percent < 0

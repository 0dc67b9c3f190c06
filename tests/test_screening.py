"""Screening, categories and waste rules on odd rows, and what their plans move."""

import random

from pyspark.sql import functions as F

from leanprompt.operators import ingest
from leanprompt.plans import direct


def documents(spark, tmp_path, texts):
    spark.createDataFrame([(k, t, "x", f"s{k % 2}") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_gate_is_the_reason_and_key_of_the_columns(spark):
    r = random.Random(1)
    parts = ["word ", "Word", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", " ", "​", "ﬁ", "é", "é", "Ạ", " ?", " ! .", "!", "/", "....", "\x00", " ", "12345678"]
    texts = [None, "", "x" * 8_001, "​" * 9, *("".join(r.choice(parts) for _ in range(r.randrange(1, 12))) for _ in range(2_000))]
    rows = spark.createDataFrame([(t,) for t in texts], "prompt string").withColumn("clean", ingest.sanitised(F.col("prompt")))
    reason = ingest.reject_reason(F.col("prompt"), F.col("clean"))
    want = rows.select("prompt", reason.alias("reason"), F.when(reason.isNull(), F.md5(ingest.dedupe_key(F.col("clean")))).alias("key")).collect()
    assert [(w.reason, w.key) for w in want] == [ingest.gate(w.prompt) for w in want]


def test_screen_joins_digests_not_texts(spark, tmp_path):
    got = direct.corpus_screen(spark, documents(spark, tmp_path, ["a text of words", "A text of words!", "other words here", None]))
    node = got._jdf.queryExecution().optimizedPlan()
    while "Join" not in node.nodeName():
        node = node.children().apply(0)
    assert "prompt" not in node.output().mkString(",") and "text" not in node.output().mkString(",")
    assert [r.reason for r in got.orderBy("doc_id").collect()] == ["kept", "duplicate", "kept", "empty"]


def test_reasons_are_counted_in_one_pass(spark, tmp_path):
    got = direct.reject_reasons(spark, documents(spark, tmp_path, ["a text of words", "A text of words!", "other words here", None, "a text  of words", "a"]))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    assert sorted(map(tuple, got.collect())) == [("s0", "duplicate", 1), ("s0", "kept", 2), ("s1", "duplicate", 1), ("s1", "empty", 1), ("s1", "too_short", 1)]


def test_words_end_at_accented_letters(spark):
    got = spark.createDataFrame([("isñ de",), ("is de",), ("isn de",), ("\x0bis de",), (None,)], "p string").select(ingest.category(F.col("p"))).collect()
    assert [r[0] for r in got] == ["factual", "factual", "other", "other", "other"]


def test_waste_points_take_space_as_their_sql_does(spark, tmp_path):
    got = direct.waste_points(spark, documents(spark, tmp_path, ["I need to go", "I\x0bneed to go", "héllo hello!!", "w/x u, asdfſqwer"])).orderBy("doc_id").collect()
    assert [(r.preambles, r.greetings, r.punctuation, r.slang, r.keyboard) for r in got] == [(10, 0, 0, 0, 0), (0, 0, 0, 0, 0), (0, 5, 10, 0, 0), (0, 0, 0, 8, 12)]


def test_similar_pairs_are_found_in_tiles(spark, monkeypatch):
    r = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta"]
    texts = [" ".join(r.choice(words) for _ in range(6)) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    v = {}
    for x in ingest.gram_vectors(rows).collect():
        v.setdefault(x.id, {})[x.gram] = x.w
    dot = lambda a, b: sum(w * v[b].get(g, 0.0) for g, w in v[a].items())
    want = {(a, b) for a in v for b in v if a < b and dot(a, b) >= 0.8}
    for block, common in ((4_096, 4_096), (7, 5)):
        monkeypatch.setattr(ingest, "BLOCK", block)
        monkeypatch.setattr(ingest, "COMMON_GRAMS", common)
        assert want and {(x.a, x.b) for x in ingest.similar_pairs(rows, 0.8).collect()} == want
    plan = ingest.similar_pairs(rows, 0.8)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan
    rows = rows.select(F.struct("id", "text").alias("id"), "text")
    assert ingest.similar_pairs(rows, 0.8).count() == len(want) and ingest.similar_pairs(rows.limit(0), 0.8).count() == 0

"""Sums whose last digit depends on the order of adding, and words counted within texts."""

import datetime

import duckdb

from leanprompt import plans
from leanprompt.plans import direct


def test_weekly_tokens_are_added_in_the_order_of_events(spark, tmp_path):
    when = datetime.datetime(2024, 1, 29, 12)
    values = [0.1, 0.2, 0.3, 0.4, *[0.7, 0.1, 0.2] * 30]
    rows = [(k, when, u, "view", v, None) for u in range(40) for k, v in enumerate(values[u:] + values[:u], 1_000 * u)]
    shuffled = sorted(rows, key=lambda r: r[0] * 7_919 % 10_007)
    df = spark.createDataFrame(shuffled, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    df.repartition(8).write.parquet(f"{tmp_path}/events.parquet")
    for name in ("documents", "benchmark", "labels", "conversations", "pages", "embeddings"):
        spark.createDataFrame([(1,)], "x int").write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r.user_id: r.tokens for r in plans.QUERIES["weekly_challenge"](spark, str(tmp_path)).collect()}
    duck = duckdb.connect()
    duck.sql("set threads = 1")
    duck.sql("create table events (event_id bigint, ts timestamp, user_id bigint, event_type varchar, value double, props varchar)")
    duck.executemany("insert into events values (?, ?, ?, ?, ?, ?)", rows)
    assert got == {r[0]: r[1] for r in duck.sql(plans.ORACLES["weekly_challenge"]).fetchall()}


def test_overuse_is_counted_without_moving_words(spark, tmp_path):
    rows = [(1, "Apple apple apple pears"), (2, "apple apple"), (3, None), (4, "tiny tiny tiny")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/a/documents.parquet")
    got = direct.word_overuse(spark, f"{tmp_path}/a")
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString() and [tuple(r) for r in got.collect()] == [(1, 1)]
    spark.createDataFrame([*rows, (2, "apple")], "doc_id long, text string").write.parquet(f"{tmp_path}/b/documents.parquet")
    assert sorted(tuple(r) for r in direct.word_overuse(spark, f"{tmp_path}/b").collect()) == [(1, 1), (2, 1)]

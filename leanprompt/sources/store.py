"""Stores and interchange: history, event log, settings, dictionary, reports, corpus shards, phrase files, exports.

A store is a folder of Parquet that every executor sees. Writers stage the new contents beside the old ones and put them in
place, so that a job that dies leaves the old ones. Appends that need no cap add files and rewrite nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Fixed values.
TURN_CAP, LOG_CAP, REPORT_CAP, LOG_CLIP, LOG_KEYS, WORD_CLIP, LOG_SHOWN = 500, 1_000, 200, 300, 12, 64, 300
TURN = "seq long, prompt string, response string, promptTokens long, responseTokens long, totalTokens long, electricity double, carbon double, efficiencyScore double, qualityIssues array<string>, wasOptimized boolean, tokensSaved long, carbonSaved double, originalPrompt string, timestamp timestamp, attachedImages int, attachedDocs int, attachedLinks int"
LOG = "t long, k string, lvl string, m string, d map<string,string>, src string"
REPORT = "timestamp timestamp, category string, finding string, word string, prompt string, suggestion string"
HISTORY_COLUMNS = [("timestamp", "Time"), ("prompt", "Prompt sent"), ("originalPrompt", "Prompt before rewriting"), ("wasOptimized", "Optimized"), ("promptTokens", "Prompt tokens"), ("responseTokens", "Response tokens"), ("totalTokens", "Total tokens"), ("tokensSaved", "Tokens saved"), ("efficiencyScore", "Efficiency score"), ("carbon", "CO2 (g)"), ("carbonSaved", "CO2 saved (g)"), ("response", "Response")]
REPORT_COLUMNS = [("timestamp", "Time"), ("category", "Category"), ("finding", "Finding"), ("word", "Word"), ("prompt", "Prompt"), ("suggestion", "Suggestion")]


class Store:
    """A table of a fixed schema in one folder; one that was never written is empty."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, StructType.fromDDL(schema)

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def read(self) -> DataFrame:
        fs, path = self._fs()
        return self.spark.read.schema(self.schema).parquet(self.path) if fs.exists(path(self.path)) else self.spark.createDataFrame([], self.schema)

    def overwrite(self, rows: DataFrame) -> None:
        """Replaces the contents; rows may read this store."""
        fs, path = self._fs()
        beside = f"{self.path.rstrip('/')}-{uuid.uuid4().hex}"
        self._fit(rows).write.parquet(beside)
        fs.delete(path(self.path), True)
        fs.rename(path(beside), path(self.path))

    def append(self, rows: DataFrame) -> None:
        self._fit(rows).write.mode("append").parquet(self.path)

    def clear(self) -> None:
        self.overwrite(self.spark.createDataFrame([], self.schema))

    def _fit(self, rows: DataFrame) -> DataFrame:
        """The columns of the schema; what rows lack is null, what they have besides is left out."""
        have = set(rows.columns)
        return rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema])


def history(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, TURN)


def save_turn(store: Store, turn: DataFrame, cap: int = TURN_CAP) -> None:
    """Adds one turn behind the others. Beyond the cap the oldest one goes, a single one a save."""
    old = store.read()
    facts = old.agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last")).first()
    last = facts["last"] if facts["last"] is not None else -1
    if facts["n"] + 1 > cap:
        old = old.where(F.col("seq") != facts["first"])
        store.overwrite(old.unionByName(store._fit(turn.withColumn("seq", F.lit(last + 1)))))
    else:
        store.append(turn.withColumn("seq", F.lit(last + 1)))


def delete_turn(store: Store, timestamp) -> None:
    """Removes every turn of that time; turns without a time stay."""
    store.overwrite(store.read().where(~F.col("timestamp").eqNullSafe(F.lit(timestamp))))


def newest(rows: DataFrame, order: list[str], cap: int) -> DataFrame:
    """The last `cap` rows by order: a sorted limit, which keeps cap rows of each task and not a whole sort."""
    return rows.orderBy(*[F.desc(c) for c in order]).limit(cap)


def log_entries(rows: DataFrame) -> DataFrame:
    """Entries as the log holds them: level info if none, messages and values clipped, the first keys of the details."""
    clip = lambda c: F.when(F.length(c) > LOG_CLIP, F.concat(F.substring(c, 1, LOG_CLIP), F.lit("…"))).otherwise(c)
    some = F.map_from_entries(F.transform(F.slice(F.map_entries("d"), 1, LOG_KEYS), lambda e: F.struct(e["key"], clip(e["value"]))))
    return rows.withColumns({"lvl": F.coalesce("lvl", F.lit("info")), "m": clip(F.coalesce("m", F.lit(""))), "d": F.when(F.size("d") > 0, some)})


def append_log(store: Store, rows: DataFrame, cap: int = LOG_CAP) -> None:
    """A ring buffer: the newest `cap` entries stay."""
    store.overwrite(newest(store.read().unionByName(store._fit(log_entries(rows))), ["t", "k", "m"], cap))


def log_lines(rows: DataFrame) -> DataFrame:
    """(t, line): "time  LEVEL  kind  message  {details}", without an end where there are no details."""
    stamp = F.date_format(F.timestamp_millis("t"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    details = F.when(F.size("d") > 0, F.to_json("d")).otherwise("")
    line = F.concat_ws("  ", stamp, F.rpad(F.upper(F.coalesce("lvl", F.lit("info"))), 5, " "), F.coalesce("k", F.lit("")), F.coalesce("m", F.lit("")), details)
    return rows.select("t", F.rtrim(line).alias("line"))


def filter_log(rows: DataFrame, term: str = "", problems: bool = False, shown: int = LOG_SHOWN) -> DataFrame:
    """The newest entries whose kind, message and details hold the term in any case; errors and warnings alone if asked."""
    whole = F.lower(F.concat_ws(" ", "k", "m", F.coalesce(F.to_json("d"), F.lit("{}"))))
    out = rows.where(F.col("lvl").isin("error", "warn")) if problems else rows
    return newest(out.where(whole.contains(term.lower())), ["t", "k", "m"], shown)


def export_log(rows: DataFrame, path: str, lines: bool = False) -> None:
    """JSON lines, or formatted lines."""
    (log_lines(rows).orderBy("t").select("line").write.text(path) if lines else rows.orderBy("t").write.json(path))


def csv_cell(c: Column, text: bool) -> Column:
    """Quoted, quotes doubled; a text that a spreadsheet would take for a formula begins with an apostrophe."""
    plain = F.coalesce(c.cast("string"), F.lit(""))
    safe = F.when(plain.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), plain)).otherwise(plain) if text else plain
    return F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))


def csv_lines(rows: DataFrame, columns: list[tuple[str, str]]) -> tuple[str, DataFrame]:
    """The header, and rows with a `line` each; lines are to be joined by CRLF."""
    kinds = dict(rows.dtypes)
    header = ",".join('"' + h.replace('"', '""') + '"' for _, h in columns)
    return header, rows.withColumn("line", F.concat_ws(",", *[csv_cell(F.col(c), kinds[c] == "string") for c, _ in columns]))


def export_csv(rows: DataFrame, columns: list[tuple[str, str]], path: str) -> None:
    """Files of lines, each with the header as its first."""
    header, lines = csv_lines(rows, columns)
    lines.select(F.concat("line", F.lit("\r")).alias("line")).write.option("lineSep", "\n").text(path)
    rows.sparkSession.createDataFrame([(header + "\r",)], "line string").coalesce(1).write.mode("append").text(f"{path}/_header")


def settings(spark: SparkSession, path: str, defaults: dict) -> dict:
    """Defaults with what is stored over them."""
    stored = {r["key"]: json.loads(r["value"]) for r in Store(spark, path, "key string, value string").read().collect()}
    return {k: stored.get(k, v) for k, v in defaults.items()}


def set_setting(spark: SparkSession, path: str, key: str, value) -> None:
    store = Store(spark, path, "key string, value string")
    store.overwrite(store.read().where(F.col("key") != key).unionByName(spark.createDataFrame([(key, json.dumps(value))], "key string, value string")))


def normal_word(c: Column) -> Column:
    return F.substring(F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"\s+", " "), 1, WORD_CLIP)


def change_dictionary(store: Store, add: list[str] = (), remove: list[str] = ()) -> None:
    """A sorted set of words in lower case, as store(word)."""
    make = lambda ws: store.spark.createDataFrame([(w,) for w in ws], "word string").select(normal_word(F.col("word")).alias("word"))
    words = store.read().unionByName(make(add)).where("word <> ''").distinct().join(make(remove), "word", "left_anti")
    store.overwrite(words.orderBy("word"))


def add_report(store: Store, rows: DataFrame, cap: int = REPORT_CAP) -> None:
    """Fix reports, of which the newest `cap` stay; a report without a time is of now."""
    new = store._fit(rows).withColumn("timestamp", F.coalesce("timestamp", F.current_timestamp()))
    store.overwrite(newest(store.read().unionByName(new), ["timestamp", "finding"], cap))


# corpus sources and sinks


def pairs(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Raw prompts and rewrites of JSON arrays by split: rows without a prompt, or that are no objects, drop. seq is by
    split and place in the file as read."""
    out = None
    for order, (split, path) in enumerate(paths.items()):
        rows = spark.read.schema("prompt string, optimized_prompt string").json(path, multiLine=True)
        rows = rows.select(F.regexp_replace("prompt", r"^\s+|\s+\z", "").alias("prompt"), F.nullif(F.regexp_replace("optimized_prompt", r"^\s+|\s+\z", ""), F.lit("")).alias("optimized_prompt"), F.lit(split).alias("split"))
        rows = rows.where("prompt <> ''").withColumn("seq", F.monotonically_increasing_id() + F.lit(order) * F.lit(1 << 56).cast("long"))
        out = rows if out is None else out.unionByName(rows)
    return out


def conversations(raw: DataFrame) -> DataFrame:
    """First user turns of raw(conversation array<struct<role,content>>, openai_moderation array<struct<categories
    map<string,boolean>>>, language, redacted), but for those whose own moderation flags anything; without one they stay."""
    roles = F.transform("conversation", lambda t: F.lower(t["role"]))
    at = F.array_position(roles, "user").cast("int")
    rows = raw.withColumn("_at", at).where("_at > 0")
    rows = rows.withColumn("prompt", F.regexp_replace(F.element_at("conversation", F.col("_at"))["content"], r"^\s+|\s+\z", ""))
    moderation = F.when(F.size("openai_moderation") >= F.col("_at"), F.element_at("openai_moderation", F.greatest(F.col("_at"), F.lit(1)))["categories"])
    flagged = F.coalesce(F.exists(F.map_values(moderation), lambda v: F.coalesce(v, F.lit(False))), F.lit(False))
    return rows.where((F.col("prompt") != "") & ~flagged).select("prompt", F.lit(None).cast("string").alias("optimized_prompt"), F.lit("train").alias("split"), "language", F.col("redacted").alias("source_redacted"))


def write_shards(records: DataFrame, path: str, resume: bool = True) -> int:
    """Adds records(id, source, ...) to a corpus partitioned by source; what it holds already by id is passed over, so a job
    that died is run again. Returns how many were added."""
    spark = records.sparkSession
    store = Store(spark, path, "id string, source string")
    fs, at = store._fs()
    if resume and fs.exists(at(path)):
        records = records.join(spark.read.parquet(path).select("id"), "id", "left_anti")
    records = records.dropDuplicates(["id"])
    counter = records.count()
    records.write.mode("append" if resume else "overwrite").partitionBy("source").parquet(path)
    return counter


def read_corpus(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All shards, whatever columns each has; of the wanted columns those that exist."""
    rows = spark.read.option("mergeSchema", "true").parquet(path)
    return rows.select(*[c for c in columns if c in rows.columns]) if columns else rows


def export_sample(corpus: DataFrame, path: str, limit: int | None = None, seed: int = 13) -> None:
    """JSON lines in an order by hash and seed; a sample of `limit` rows, if given."""
    rows = corpus.orderBy(F.xxhash64("id", F.lit(seed)), "id")
    (rows.limit(limit) if limit else rows).write.json(path)


def corpus_stats(corpus: DataFrame) -> DataFrame:
    """(source, task_category, n, rewritten) with totals by each and over all; reads three columns."""
    rewritten = F.sum(F.when(F.coalesce("optimized_prompt", F.lit("")) != "", 1).otherwise(0)).alias("rewritten")
    return corpus.groupingSets([["source"], ["task_category"], []], "source", "task_category").agg(F.count("*").alias("n"), rewritten)


def manual_batches(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(text, label, context, batch) of JSON-lines files, batch by default the file's name; and the lines that are no JSON
    objects, with their file."""
    lines = spark.read.text(path).where("trim(value) <> ''").withColumn("file", F.regexp_extract(F.col("_metadata.file_name"), r"([^/]+?)(?:\.[^./]*)?$", 1))
    row = F.from_json("value", "text string, label string, context string, batch string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    parsed = lines.withColumn("r", row)
    good = F.col("r").isNotNull() & F.col("r._bad").isNull() & F.trim("value").startswith("{")
    return parsed.where(good).select("r.text", "r.label", "r.context", F.coalesce("r.batch", "file").alias("batch")), parsed.where(~good).select("file", "value")


def salvage(replies: DataFrame) -> DataFrame:
    """(text, label, context) from replies(raw, label): the array from the first [ to the last ], if it can be read; items
    without text drop, and have the reply's label unless they name their own."""
    a, b = F.instr("raw", "["), F.length("raw") - F.instr(F.reverse("raw"), "]") + 1
    array = F.when((a > 0) & (F.instr(F.reverse("raw"), "]") > 0) & (b > a), F.substring(F.col("raw"), a, b - a + 1))
    items = F.from_json(array, "array<struct<text: string, label: string, context: string>>")
    flat = replies.select(F.col("label").alias("_label"), F.explode(items).alias("i")).select(F.trim("i.text").alias("text"), F.upper(F.trim(F.coalesce(F.nullif("i.label", F.lit("")), "_label"))).alias("label"), F.trim(F.coalesce("i.context", F.lit(""))).alias("context"))
    return flat.where("text <> ''")


def phrases(spark: SparkSession, path: str) -> DataFrame:
    """(text, label, source) of a CSV file with a header: rows without text or label drop, a missing source is seed."""
    rows = spark.read.csv(path, header=True, escape='"', multiLine=True)
    source = F.col("source") if "source" in rows.columns else F.lit(None).cast("string")
    clean = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return rows.select(clean(F.col("text")).alias("text"), clean(F.col("label")).alias("label"), F.coalesce(F.nullif(clean(source), F.lit("")), F.lit("seed")).alias("source")).where("text <> '' and label <> ''")

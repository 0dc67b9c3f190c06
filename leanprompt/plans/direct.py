"""Queries written as DataFrames, each with an oracle written by hand in the oracle engine's SQL (none where SQL has no way)."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from leanprompt.functions.dialect import SPARK
from leanprompt.operators import classifier, corpus, ingest, text
from leanprompt.operators.native import js_round, token_estimate, token_stats
from leanprompt.text import scoring



def plain(c):
    """The text with a sign that is no letter for each character beyond ASCII: the JVM's word boundaries take accented
    letters for letters, those of the rules do not."""
    return F.regexp_replace(c, r"[^\x00-\x7f]", "\x01")


def table(spark: SparkSession, where: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{where}/{name}.parquet")


def prompts(spark: SparkSession, where: str) -> DataFrame:
    return table(spark, where, "documents").select(F.col("doc_id").alias("seq"), F.col("text").alias("prompt"), F.lit(None).cast("string").alias("optimized_prompt"), "source", "lang")


def corpus_screen(spark, where):
    rows = ingest.gated(prompts(spark, where)).select("seq", "reason", "key", F.md5("prompt").alias("clean_md5"))  # digests: no text is joined
    return ingest.judged(rows).select(F.col("seq").alias("doc_id"), F.coalesce("reason", F.lit("kept")).alias("reason"), "clean_md5")


def reject_reasons(spark, where):
    return ingest.reason_counts(prompts(spark, where), "source")


def dedupe_first_wins(spark, where):
    return ingest.gated(prompts(spark, where)).where("key is not null").groupBy("key").agg(F.min("seq").alias("doc_id"), F.count("*").alias("n"))


def fingerprints(spark, where):
    return prompts(spark, where).select(F.col("seq").alias("doc_id"), ingest.fingerprint(F.col("prompt")).alias("id"))


def redact_pii(spark, where):
    r = prompts(spark, where).select("seq", ingest.redact(F.col("prompt")).alias("r"))
    return r.select(F.col("seq").alias("doc_id"), F.md5("r.text").alias("clean_md5"), F.col("r.hits").cast("long").alias("hits"))


def task_category(spark, where):
    return prompts(spark, where).groupBy("lang", ingest.category(F.col("prompt")).alias("category")).agg(F.count("*").alias("n"))


def derived_flags(spark, where):
    p = F.col("prompt")
    rows = prompts(spark, where).select(F.col("seq").alias("doc_id"), ingest.flags(p).alias("f"), p.contains("\n").alias("is_multiline"))
    return rows.select("doc_id", "f.has_code", "f.has_math", "f.has_url", "is_multiline", "f.word_count")


def token_estimate_documents(spark, where):
    return prompts(spark, where).select(F.col("seq").alias("doc_id"), F.coalesce(token_estimate(F.col("prompt")), F.lit(0)).alias("tokens"))


def token_savings(spark, where):
    p = F.col("prompt")
    return prompts(spark, where).select(F.col("seq").alias("doc_id"), token_stats(p, F.regexp_replace(p, r"\s+", " ")).alias("s")).select("doc_id", "s.*")


def by_length(spark, where):
    """Tokens before and after squeezing white space, by size, by language and in all; each text is measured once."""
    p = F.col("prompt")
    rows = prompts(spark, where).select("lang", token_stats(p, F.regexp_replace(p, r"\s+", " ")).alias("s")).select("lang", F.coalesce("s.original", F.lit(0)).alias("before"), F.coalesce("s.optimized", F.lit(0)).alias("after"))
    rows = rows.withColumn("size", F.when(F.col("before") < 30, "short").when(F.col("before") < 120, "medium").otherwise("long"))
    out = rows.groupBy("size", "lang").agg(F.count("*").alias("n"), F.sum("before").alias("b"), F.sum("after").alias("a"), F.sum((F.col("after") < F.col("before")).cast("int")).alias("l"), F.sum((F.col("after") == F.col("before")).cast("int")).alias("e"))
    total = lambda c, name: F.sum(c).cast("long").alias(name)
    return out.groupingSets([["size"], ["lang"], []], "size", "lang").agg(total("n", "n"), total("b", "before_tokens"), total("a", "after_tokens"), total("l", "smaller"), total("e", "same"))


#: The waste rules that both engines' patterns can express: label in the query's column, place among the rules.
PLAIN_WASTE = {"greetings": 0, "politeness": 1, "preambles": 2, "meta": 3, "wordy": 4, "punctuation": 5, "footer": 7, "slang": 9, "hedging": 10, "urgency": 12, "keyboard": 13, "commentary": 15}


@F.arrow_udf(StructType([StructField(name, LongType()) for name in PLAIN_WASTE]))
def waste_hits(texts: pa.Array) -> pa.Array:
    """Hits of each plain rule by RE2, in time linear in the text. Its counting looks anew at the rest behind a match, which
    is the same here: no rule that begins at a word's edge ends inside a word."""
    rules = [("" if name == "punctuation" else "(?i)") + scoring.WASTE[k][3].pattern for name, k in PLAIN_WASTE.items()]
    return pa.StructArray.from_arrays([pc.cast(pc.count_substring_regex(texts, p), pa.int64()) for p in rules], list(PLAIN_WASTE))


def waste_points(spark, where):
    rows = prompts(spark, where).select(F.col("seq").alias("doc_id"), waste_hits("prompt").alias("h"))
    points = [F.least(F.lit(most), per * F.col(f"h.{name}")).cast("long").alias(name) for name, (_, per, most, _) in ((name, scoring.WASTE[k]) for name, k in PLAIN_WASTE.items())]
    return rows.select("doc_id", *points)


def scope_points(spark, where):
    p = F.col("prompt")
    items = F.array_max(F.transform(F.split(p, r"(?<=[.!?])\s+", -1), lambda s: F.size(F.split(s, ",", -1))))
    wanted = F.regexp_count(plain(p), F.lit("(?i)" + scoring.DELIVERABLE.pattern))
    rows = prompts(spark, where).select(F.col("seq").alias("doc_id"), items.cast("long").alias("items"), wanted.cast("long").alias("deliverables"))
    return rows.select("*", F.when(F.col("items") > 12, F.least(F.lit(20), js_round((F.col("items") - 12) / 2))).otherwise(0).alias("list_points"), F.when(F.col("deliverables") > 3, F.least(F.lit(10), 2 * (F.col("deliverables") - 3))).otherwise(0).alias("deliverable_points"))


def doubled_words(spark, where):
    ws = F.filter(F.split(F.lower("prompt"), r"\s+", -1), lambda w: w != "")
    pairs = F.zip_with(F.slice("ws", F.lit(1), F.greatest(F.size("ws") - 1, F.lit(0))), F.slice("ws", F.lit(2), F.greatest(F.size("ws") - 1, F.lit(0))), lambda a, b: (a == b).cast("int"))
    rows = prompts(spark, where).select(F.col("seq").alias("doc_id"), ws.alias("ws")).withColumn("doubled", F.aggregate(pairs, F.lit(0), lambda s, x: s + x).cast("long"))
    return rows.where("doubled > 0").select("doc_id", "doubled")


def repeated_lines(spark, where):
    ls = F.split("prompt", r"\n", -1)
    pairs = F.zip_with(F.slice("ls", F.lit(1), F.size("ls") - 1), F.slice("ls", F.lit(2), F.size("ls") - 1), lambda a, b: ((a == b) & (F.length(a) >= 12)).cast("int"))
    rows = prompts(spark, where).select(F.col("seq").alias("doc_id"), ls.alias("ls")).where(F.size("ls") > 1).withColumn("repeated", F.aggregate(pairs, F.lit(0), lambda s, x: s + x).cast("long"))
    return rows.where("repeated > 0").select("doc_id", "repeated")


@F.arrow_udf(LongType())
def overused(texts: pa.Array) -> pa.Array:
    """Words of five letters or more that come three times or more."""
    each = (t.as_py() for t in texts)
    return pa.array([t if t is None else sum(n >= 3 for n in Counter(re.findall("[a-z]{5,}", t.lower())).values()) for t in each], pa.int64())


def word_overuse(spark, where):
    """Counted within each text, so that no task holds the words of many; rows that share their doc_id are added up by the SQL."""
    docs = table(spark, where, "documents").select("doc_id", "text")
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        docs.createOrReplaceTempView("documents")
        return spark.sql(corpus.word_overuse(SPARK))
    return docs.select("doc_id", overused("text").alias("overused")).where("overused > 0")


def attested_words(spark, where):
    words = F.array_distinct(F.regexp_extract_all(F.lower("prompt"), F.lit("[a-z]+"), F.lit(0)))
    return prompts(spark, where).select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("df")).where("df >= 3")


def phrase_audit(spark, where):
    labels = table(spark, where, "labels").select("doc_id", F.when(F.col("quality") == 1, "IMPORTANT").when(F.col("quality") == 0, "FILLER").otherwise("none").alias("label"))
    return ingest.audit_phrases(table(spark, where, "documents").select("doc_id", "text").join(labels, "doc_id"))


def review_flag_counts(spark, where):
    labels = table(spark, where, "labels").select("doc_id", F.when(F.col("quality") == 1, "IMPORTANT").otherwise("REPETITIVE").alias("label"))
    rows = table(spark, where, "documents").select("doc_id", "text").join(labels, "doc_id").select(ingest.review_flags(F.col("text"), F.col("label"), F.lit("")).alias("flags"))
    return rows.groupBy("flags").agg(F.count("*").alias("n"))


def near_duplicate_turns(spark, where):
    rows = table(spark, where, "conversations").where("role = 'user' and text is not null").select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("id"), "text")
    return ingest.near_duplicates(rows, 0.5).select("id", "of", F.round("similarity", 6).alias("similarity"))


def classifier_model(spark: SparkSession, where: str) -> classifier.Model:
    """Terms of the benchmark with weights made from their letters: a fixed model to check the algebra with."""
    items = table(spark, where, "benchmark").select(F.col("item_id").alias("id"), "text")
    settings = classifier.Settings(ngrams=2, sublinear=True, bigram_df=2)
    vocabulary = classifier.fit_vocabulary(items, settings)
    labels = spark.createDataFrame([("FILLER", 1), ("IMPORTANT", 2), ("REDUNDANT", 3), ("REPETITIVE", 4)], "label string, k int")
    weights = labels.crossJoin(vocabulary.select("term", "idx")).select("label", "idx", ((F.pmod(F.length("term") * 7 + F.ascii("term") * F.col("k"), F.lit(11)) - 5) / 10.0).alias("w"))
    return classifier.Model(vocabulary, weights.unionByName(labels.select("label", F.lit(-1).alias("idx"), (F.col("k") / 100.0).alias("w"))), settings)


def classifier_inference(spark, where):
    rows = table(spark, where, "conversations").where("role = 'user'").select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("id"), "text")
    got = classifier.classify(rows, classifier_model(spark, where))
    return got.select("id", "label", F.round("confidence", 6).alias("confidence"), F.round("keep", 6).alias("keep"), "veto", "propose")


def badges(spark, where):
    e = table(spark, where, "events").select("user_id", F.to_date("ts").alias("day"), (F.floor("value").cast("long") % 101).alias("score"), "value")
    streaks = _streaks(e)
    a = e.groupBy("user_id").agg(F.count("*").alias("n"), F.avg(F.coalesce("score", F.lit(100))).alias("m"), F.sum(F.when(F.coalesce("score", F.lit(100)) >= 85, 1).otherwise(0)).alias("good"), F.coalesce(F.sum(F.col("value") * 0.00036), F.lit(0.0)).alias("saved"))
    return a.join(streaks, "user_id", "left").select("user_id", ((F.col("n") >= 5) & (F.col("m") >= 90)).alias("efficient"), (F.col("saved") >= 1).alias("saver"), (F.coalesce("streak", F.lit(0)) >= 3).alias("streak3"), (F.col("good") >= 20).alias("steady"))


def _streaks(e: DataFrame) -> DataFrame:
    """(user_id, streak) as of the fixed day: days with a score of 90 or more in a row, up to today or, without one, yesterday."""
    today = F.lit("2024-01-30").cast("date")
    daily = e.where(F.col("day") <= today).groupBy("user_id", "day").agg(F.max(F.when(F.coalesce("score", F.lit(100)) >= 90, 1).otherwise(0)).alias("credit"))
    anchor = daily.groupBy("user_id").agg(F.when(F.max(F.when((F.col("day") == today), F.col("credit"))) == 1, today).when(F.max(F.when(F.col("day") == F.date_sub(today, 1), 1)) == 1, F.date_sub(today, 1)).alias("anchor"))
    back = daily.where("credit = 1").join(anchor, "user_id").where("day <= anchor").withColumn("gap", F.datediff("anchor", "day") - F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("day"))) + 1)
    return back.where("gap = 0").groupBy("user_id").agg(F.count("*").alias("streak"))


def recommendations(spark, where):
    """(user_id, id): what each user of events is told; types stand in for prompts, values for tokens."""
    e = table(spark, where, "events").select("user_id", "event_id", "ts", "event_type", F.to_date("ts").alias("day"), (F.floor("value").cast("long") % 101).alias("score"), F.col("value") * 0.36)
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = e.toDF("user_id", "event_id", "ts", "event_type", "day", "score", "carbon").withColumns({"before": F.lag("event_type").over(w), "was": F.lag("ts").over(w)})
    quick = (F.col("event_type") == F.col("before")) & (F.col("ts").cast("timestamp").cast("double") - F.col("was").cast("timestamp").cast("double") < 180)
    a = e.groupBy("user_id").agg(F.sum(F.when(F.col("score") < 85, 1).otherwise(0)).alias("weak"), js_round(F.avg(F.coalesce("score", F.lit(100)))).alias("mean"), (F.count("event_type") - F.countDistinct("event_type")).alias("repeats"), F.sum(F.when(quick, 1).otherwise(0)).alias("rapid"), F.coalesce(F.sum(F.when(F.col("day") == F.lit("2024-01-30").cast("date"), F.col("carbon"))), F.lit(0.0)).alias("carbon"))
    fired = F.array_compact(F.array(F.when((F.col("weak") > 0) & (F.col("mean") < 85), "filler_reduction"), F.when(F.col("repeats") > 0, "duplicate_prompts"), F.when(F.col("rapid") > 0, "rapid_regens"), F.when(F.col("carbon") > 5.0, "carbon_ceiling")))
    return a.select("user_id", F.explode(F.when(F.size(fired) > 0, fired).otherwise(F.array(F.lit("success_habits")))).alias("id"), (F.col("weak") * 15).alias("savings"))


def low_efficiency(spark, where):
    e = table(spark, where, "events").select("user_id", (F.floor("value").cast("long") % 101).alias("score"))
    a = e.groupBy("user_id").agg((15 * F.sum(F.when(F.col("score") < 85, 1).otherwise(0))).alias("savings"), js_round(F.avg(F.coalesce("score", F.lit(100)))).alias("mean"))
    return a.where("savings > 0 and mean < 85").select("user_id", "savings")


def ranked_words(spark, where) -> list[str]:
    return text.dictionary(ingest.attested(table(spark, where, "documents").select("text")))


def efficiency_scores(spark, where):
    scored = text.scores(table(spark, where, "documents").select("doc_id", "text"), ranked_words(spark, where))
    return scored.select("doc_id", F.col("efficiency.score").alias("score"), F.concat_ws(",", "efficiency.flags").alias("flags"))


def masked_span_census(spark, where):
    return text.span_census(table(spark, where, "documents").select("doc_id", "text"))


def finding_counts(spark, where):
    rows = text.found(table(spark, where, "conversations").where("role = 'user'").select("conv_id", "turn", "text"))
    return rows.select(F.explode("analysis.findings").alias("f")).groupBy("f.category", "f.severity").agg(F.count("*").alias("n"))


def compression_benchmark(spark, where):
    rows = table(spark, where, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    done = text.compressed(rows, ranked_words(spark, where))
    return text.benchmark(done).select("size", "n", "before", "after", "compressed", "median", F.round("reduction", 6).alias("reduction"))


_SPACE = r"[\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_CLEAN = r"regexp_replace(regexp_replace(text, '[\x{200b}-\x{200f}\x{2060}\x{feff}\x{fffd}]', '', 'g'), '[\x01-\x08\x0b\x0c\x0e-\x1f\x{7f}-\x{9f}]', '', 'g')"
_KEY = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(clean), '{_SPACE}+', ' ', 'g'), '^ | $', '', 'g'), ' +([?!.,;:])', '\1', 'g'), '[\t\n\x0b\f\r ?!.,;:/]+$', '')"
_SCREEN = rf"""WITH c AS (SELECT doc_id, source, text, {_CLEAN} AS clean FROM documents),
g AS (SELECT *, CASE WHEN text IS NULL OR NOT regexp_matches(text, '[^\t\n\x0b\f\r ]') THEN 'empty' WHEN length(text) < 8 THEN 'too_short' WHEN length(text) > 8000 THEN 'too_long'
  WHEN NOT regexp_matches(clean, '[^\t\n\x0b\f\r ]') THEN 'empty_after_sanitise' END AS gate FROM c),
s AS (SELECT *, CASE WHEN gate IS NULL THEN md5({_KEY}) END AS key FROM g),
r AS (SELECT *, coalesce(gate, CASE WHEN row_number() OVER (PARTITION BY gate, key ORDER BY doc_id) > 1 THEN 'duplicate' ELSE 'kept' END) AS reason FROM s) """
_CODE = r"```[\s\S]*?```|`[^`\n]+`"

ORACLES = {
    "corpus_screen": _SCREEN + "SELECT doc_id, reason, md5(clean) AS clean_md5 FROM r",
    "reject_reasons": _SCREEN + "SELECT source, reason, count(*) AS n FROM r GROUP BY ALL",
    "dedupe_first_wins": _SCREEN + "SELECT key, min(doc_id) AS doc_id, count(*) AS n FROM r WHERE gate IS NULL GROUP BY key",
    "fingerprints": rf"SELECT doc_id, substr(sha1(regexp_replace(regexp_replace(lower(text), '{_SPACE}+', ' ', 'g'), '^ | $', '', 'g')), 1, 16) AS id FROM documents",
    "redact_pii": rf"""WITH p AS (SELECT doc_id, generate_subscripts(string_split_regex(text, '{_CODE}'), 1) AS i, unnest(string_split_regex(text, '{_CODE}')) AS p0, regexp_extract_all(text, '{_CODE}') AS codes FROM documents WHERE text IS NOT NULL),
a AS (SELECT *, regexp_replace(p0, '\b[\w.+-]+@[\w-]+\.[\w.]{{2,}}\b', '[EMAIL]', 'g') AS p1, len(regexp_extract_all(p0, '\b[\w.+-]+@[\w-]+\.[\w.]{{2,}}\b')) AS h1 FROM p),
b AS (SELECT *, regexp_replace(p1, '\b(?:sk-|ghp_|gho_|github_pat_|xox[baprs]-)[A-Za-z0-9_-]{{16,}}', '[API_KEY]', 'g') AS p2, len(regexp_extract_all(p1, '\b(?:sk-|ghp_|gho_|github_pat_|xox[baprs]-)[A-Za-z0-9_-]{{16,}}')) AS h2 FROM a),
c AS (SELECT *, regexp_replace(p2, '\bBearer\s+[A-Za-z0-9._-]{{20,}}', 'Bearer [TOKEN]', 'g') AS p3, len(regexp_extract_all(p2, '\bBearer\s+[A-Za-z0-9._-]{{20,}}')) AS h3 FROM b),
m AS (SELECT *, regexp_replace(p3, '([\x{{c0}}-\x{{d6}}\x{{d8}}-\x{{f6}}\x{{f8}}-\x{{24f}}])', 'ZqZq\1', 'g') AS q3 FROM c), -- so that \b, of ASCII here, takes accented letters for letters
d AS (SELECT *, replace(regexp_replace(q3, '\b(?:\d[ -]?){{13,19}}\b', '[CARD]', 'g'), 'ZqZq', '') AS p4, len(regexp_extract_all(q3, '\b(?:\d[ -]?){{13,19}}\b')) AS h4 FROM m),
e AS (SELECT *, regexp_replace(p4, '\b\d{{3}}-\d{{2}}-\d{{4}}\b', '[SSN]', 'g') AS p5, len(regexp_extract_all(p4, '\b\d{{3}}-\d{{2}}-\d{{4}}\b')) AS h5 FROM d),
j AS (SELECT doc_id, md5(string_agg(p5 || coalesce(codes[i], ''), '' ORDER BY i)) AS clean_md5, CAST(sum(h1 + h2 + h3 + h4 + h5) AS BIGINT) AS hits FROM e GROUP BY doc_id)
SELECT doc_id, clean_md5, hits FROM documents LEFT JOIN j USING (doc_id)""",
    "task_category": r"""WITH c AS (SELECT lang, CASE
  WHEN regexp_matches(text, '(?i)```|\bdef \w|\bclass \w|\bimport \w|\bfunction\b|\bselect\b|\bjavascript\b|\bpython\b|\bcompile\b|\bdebug\b|\bapi\b|\bregex\b|\bsql\b|\bhtml\b|\bcss\b|\bcode\b') THEN 'code'
  WHEN regexp_matches(text, '(?i)\b(?:solve|equation|integral|derivative|theorem|probability|matrix|calculate|factorial|logarithm)\b|[=+\-*/^]\s*\d|\b\d+\s*[+\-*/^]\s*\d') THEN 'math'
  WHEN regexp_matches(text, '(?i)\b(?:write|draft|compose|essay|story|poem|screenplay|blog|article|rewrite|paraphrase|summari[sz]|translate|joke|letter|email)\b') THEN 'writing'
  WHEN regexp_matches(text, '(?i)\b(?:analyse|analyze|compare|evaluate|critique|review|pros and cons|rate|rank)\b') THEN 'analysis'
  WHEN regexp_matches(text, '(?i)\b(?:you are|act as|pretend|roleplay|imagine you)\b') THEN 'roleplay'
  WHEN regexp_matches(text, '(?i)\b(?:explain|describe|teach me|tell me about|what is|what are|what was|what were|how does|why does|why do|why are|why is)\b') THEN 'explain'
  WHEN regexp_matches(text, '(?i)\bhow (?:do|can|would|should) (?:i|we|you)\b|\bhow to\b|\b(?:steps|ways|methods) to\b|\bhow come\b|\bhow (?:much|many)\b') THEN 'howto'
  WHEN regexp_matches(text, '(?im)^\s*(?:who|what|when|where|which|why|is|are|does|did|can|could|should|would|name|list|give)\b|\?\s*$') THEN 'factual'
  ELSE 'other' END AS category FROM documents) SELECT lang, category, count(*) AS n FROM c GROUP BY ALL""",
    "derived_flags": r"""SELECT doc_id, regexp_matches(text, '(?m)```|\bdef \w|\bimport \w|[{};]\s*$') AS has_code, regexp_matches(text, '[=<>+*/^]\s*\d|\b\d+\s*[+\-*/^]') AS has_math, regexp_matches(text, 'https?://') AS has_url,
  contains(text, chr(10)) AS is_multiline, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS word_count FROM documents""",
    "token_estimate_documents": r"""WITH t AS (SELECT doc_id, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS n, len(regexp_extract_all(text, '\S+')) AS w FROM documents)
SELECT doc_id, CAST(CASE WHEN n IS NULL OR n = 0 THEN 0 WHEN n > 20 * w THEN greatest(1, floor(n / 4.0 + 0.5)) ELSE greatest(1, floor((floor(1.33 * w + 0.5) + floor(n / 4.0 + 0.5)) / 2.0 + 0.5)) END AS BIGINT) AS tokens FROM t""",
    "token_savings": r"""WITH t AS (SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS w, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS n, length(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS m FROM documents),
e AS (SELECT doc_id, CAST(CASE WHEN n IS NULL OR n = 0 THEN 0 WHEN n > 20 * w THEN greatest(1, floor(n / 4.0 + 0.5)) ELSE greatest(1, floor((floor(1.33 * w + 0.5) + floor(n / 4.0 + 0.5)) / 2.0 + 0.5)) END AS BIGINT) AS original,
  CAST(CASE WHEN m IS NULL OR m = 0 THEN 0 WHEN m > 20 * w THEN greatest(1, floor(m / 4.0 + 0.5)) ELSE greatest(1, floor((floor(1.33 * w + 0.5) + floor(m / 4.0 + 0.5)) / 2.0 + 0.5)) END AS BIGINT) AS optimized FROM t)
SELECT *, original - optimized AS saved, CASE WHEN original > 0 THEN CAST(floor((original - optimized) / original * 100 + 0.5) AS BIGINT) ELSE 0 END AS percent FROM e""",
    "waste_points": r"""SELECT doc_id,
  CAST(least(15, 5 * len(regexp_extract_all(text, '(?i)\b(hello|hallo|hi+|he+y+|greetings|dear|good\s+morning|good\s+afternoon|good\s+evening|chatgpt|chat\s*gpt|gpt|yo+|howdy|what''s\s+up|salutations|hi\s+there|hey\s+there|dear\s+ai|dear\s+assistant|hiya)\b'))) AS BIGINT) AS greetings,
  CAST(least(25, 8 * len(regexp_extract_all(text, '(?i)\b(please|plea+se+|ples+a+s+e*|pl+z+|pl+s+|pretty\s+please|thank\s+you|thanks|thx|tysm|ty|could\s+you|would\s+you\s+mind|would\s+you\s+please|can\s+you\s+please|kindly|hope\s+you\s+are\s+well|hope\s+this\s+finds\s+you\s+well|do\s+me\s+a\s+favor|i\s+beg\s+you|my\s+life\s+depends|be\s+a\s+sweetheart|i\s+will\s+tip)\b'))) AS BIGINT) AS politeness,
  CAST(least(25, 10 * len(regexp_extract_all(text, '(?i)\b(i\s+am\s+(?:having|really\s+bored|preparing|studying|working)|i''m\s+(?:having|really\s+bored|preparing|studying|working)|so\s+i\s+want\s+to|i\s+want\s+to|i\s+need\s+to|i\s+would\s+like\s+to|i\s+would\s+like\s+you\s+to|i\s+was\s+wondering\s+if|so\s+basically|to\s+give\s+you\s+a\s+little\s+background|as\s+you\s+might\s+know|i\s+was\s+sitting|i\s+just\s+wanted\s+to\s+ask|i\s+am\s+trying\s+to\s+figure\s+out|is\s+there\s+any\s+chance|do\s+you\s+know\s+if)\b'))) AS BIGINT) AS preambles,
  CAST(least(20, 10 * len(regexp_extract_all(text, '(?i)\b(take\s+a\s+deep\s+breath|think\s+step\s+by\s+step|do\s+not\s+hesitate\s+to|feel\s+free\s+to|without\s+any\s+further\s+delay|brief\s+concise|short\s+and\s+concise|concise\s+and\s+not\s+long|detailed\s+comprehensive\s+step-by-step\s+in-depth)\b'))) AS BIGINT) AS meta,
  CAST(least(20, 8 * len(regexp_extract_all(text, '(?i)\b(in\s+order\s+to|due\s+to\s+the\s+fact\s+that|as\s+a\s+matter\s+of\s+fact|more\s+or\s+less|virtually|for\s+all\s+intents\s+and\s+purposes|can\s+you\s+help\s+me|at\s+this\s+point\s+in\s+time|in\s+the\s+event\s+that|for\s+the\s+purpose\s+of|a\s+large\s+number\s+of|has\s+the\s+capability\s+to|make\s+a\s+decision|perform\s+an\s+analysis|take\s+into\s+consideration|prior\s+to|subsequent\s+to|with\s+regard\s+to|with\s+respect\s+to)\b'))) AS BIGINT) AS wordy,
  CAST(least(10, 10 * len(regexp_extract_all(text, '!{2,}|\?{2,}|\.{4,}'))) AS BIGINT) AS punctuation,
  CAST(least(15, 15 * len(regexp_extract_all(text, '(?i)sent\s+from\s+my\s+(?:iphone|ipad|android|galaxy|outlook)|confidentiality\s+notice:[\s\S]*|page\s+\d+\s+of\s+\d+'))) AS BIGINT) AS footer,
  CAST(least(8, 8 * len(regexp_extract_all(text, '(?i)\b(u|r|w/|w/o|asap|gimme|wanna|gotta|kinda|dunno|bc|b/c|approx)\b'))) AS BIGINT) AS slang,
  CAST(least(18, 6 * len(regexp_extract_all(text, '(?i)\b(?:um+|uh+|erm+|hmm+|you\s+know|i\s+mean|(?:i\s+was\s+)?just\s+wondering|out\s+of\s+curiosity|if\s+that\s+makes\s+sense|or\s+something|or\s+whatever|and\s+stuff|sorry\s+(?:if|for)\s+(?:this|the)|correct\s+me\s+if|i\s+hope\s+(?:this|that)\s+makes\s+sense|is\s+it\s+(?:possible|ok|okay)\s+(?:to|if)|are\s+you\s+able\s+to|do\s+you\s+think\s+you\s+(?:can|could|might|may|would)(?:\s+be\s+able\s+to)?)\b'))) AS BIGINT) AS hedging,
  CAST(least(6, 6 * len(regexp_extract_all(text, '(?i)\b(?:asap|as\s+soon\s+as\s+possible|urgently|as\s+quickly\s+as\s+possible|it(?:''?s|\s+is)\s+urgent|this\s+is\s+urgent|quick(?:ly)?\s+please)\b'))) AS BIGINT) AS urgency,
  CAST(least(12, 12 * len(regexp_extract_all(text, '(?i)\b[a-z]*(?:asdf|sdfg|dfgh|qwer|werty|zxcv|xcvb|hjkl|uiop)[a-z]*\b'))) AS BIGINT) AS keyboard,
  CAST(least(12, 6 * len(regexp_extract_all(text, '(?i)\b(?:i\s+have\s+a\s+(?:quick\s+)?question(?:\s+about)?|quick\s+question(?:\s+about)?|one\s+(?:more|last)\s+thing|just\s+to\s+clarify|for\s+your\s+information|fyi|please\s+note\s+that)\b'))) AS BIGINT) AS commentary
FROM documents""",
    "scope_points": r"""WITH s AS (SELECT doc_id, CAST(list_max(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: length(x) - length(replace(x, ',', '')) + 1)) AS BIGINT) AS items,
  CAST(len(regexp_extract_all(text, '(?i)\b(?:create|build|implement|design|develop|write|generate|provide|produce|explain|describe|summari[sz]e|analy[sz]e|compare|review|refactor|optimi[sz]e|deploy|configure|document|test)\b')) AS BIGINT) AS deliverables FROM documents)
SELECT *, CASE WHEN items > 12 THEN least(20, CAST(floor((items - 12) / 2.0 + 0.5) AS BIGINT)) ELSE 0 END AS list_points, CASE WHEN deliverables > 3 THEN least(10, 2 * (deliverables - 3)) ELSE 0 END AS deliverable_points FROM s""",
    "doubled_words": r"""WITH w AS (SELECT doc_id, generate_subscripts(regexp_extract_all(lower(text), '\S+'), 1) AS i, unnest(regexp_extract_all(lower(text), '\S+')) AS word FROM documents),
l AS (SELECT doc_id, word, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM w) SELECT doc_id, count(*) AS doubled FROM l WHERE word = before GROUP BY doc_id""",
    "repeated_lines": r"""WITH w AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM documents),
l AS (SELECT doc_id, line, lag(line) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM w) SELECT doc_id, count(*) AS repeated FROM l WHERE line = before AND length(line) >= 12 GROUP BY doc_id""",
    "attested_words": "WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) SELECT word, count(*) AS df FROM w GROUP BY word HAVING count(*) >= 3",
    "phrase_audit": rf"""WITH j AS (SELECT CASE WHEN regexp_matches(text, '[^\t\n\x0b\f\r ]') THEN regexp_replace(regexp_replace(lower(text), '{_SPACE}+', ' ', 'g'), '^ | $', '', 'g') END AS key, CASE quality WHEN 1 THEN 'IMPORTANT' WHEN 0 THEN 'FILLER' END AS label FROM documents JOIN labels USING (doc_id)),
k AS (SELECT key, count(*) AS n, count(DISTINCT coalesce(label, 'NONE')) AS labels FROM j WHERE key IS NOT NULL GROUP BY key)
SELECT (SELECT count(*) FROM j) AS rows, (SELECT count(*) FROM j WHERE key IS NULL OR label IS NULL) AS invalid, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates, CAST(coalesce(sum(CASE WHEN labels > 1 THEN 1 END), 0) AS BIGINT) AS conflicts FROM k""",
    "near_duplicate_turns": r"""WITH d AS (SELECT conv_id * 1000000 + turn AS id, text FROM conversations WHERE role = 'user' AND text IS NOT NULL), n AS (SELECT count(*) AS n FROM d),
w AS (SELECT id, ' ' || unnest(regexp_extract_all(lower(text), '\S+')) || ' ' AS w FROM d),
g AS (SELECT id, substr(w, CAST(i AS BIGINT), k) AS gram FROM w, (VALUES (3), (4), (5)) v(k), unnest(range(1, 2000)) r(i) WHERE k <= length(w) AND i <= length(w) - k + 1),
tf AS (SELECT id, gram, count(*) AS tf FROM g GROUP BY ALL), df AS (SELECT gram, count(*) AS df FROM tf GROUP BY gram),
x AS (SELECT id, gram, tf * (ln((1.0 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (gram), n), l AS (SELECT id, sqrt(sum(w * w)) AS l FROM x GROUP BY id), v AS (SELECT id, gram, w / l AS w FROM x JOIN l USING (id)),
p AS (SELECT a.id AS a, b.id AS b, sum(a.w * b.w) AS s FROM v a JOIN v b ON a.gram = b.gram AND a.id < b.id GROUP BY ALL HAVING sum(a.w * b.w) >= 0.5)
SELECT b AS id, arg_min(a, (-round(s, 9), a)) AS of, round(max(s), 6) AS similarity FROM p GROUP BY b""",
    "classifier_inference": r"""WITH it AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[a-z0-9_](?:[a-z0-9_'']*[a-z0-9_])?') AS t FROM benchmark), nn AS (SELECT count(*) AS n FROM benchmark),
f AS (SELECT id, unnest(t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term FROM it), df AS (SELECT term, count(DISTINCT id) AS df FROM f GROUP BY term),
voc AS (SELECT term, ln((1.0 + n) / (1 + df)) + 1 AS idf FROM df, nn WHERE NOT contains(term, ' ') OR df >= 2),
lab AS (SELECT * FROM (VALUES ('FILLER', 1), ('IMPORTANT', 2), ('REDUNDANT', 3), ('REPETITIVE', 4)) v(label, k)),
q AS (SELECT conv_id * 1000000 + turn AS id, regexp_extract_all(lower(text), '[a-z0-9_](?:[a-z0-9_'']*[a-z0-9_])?') AS t FROM conversations WHERE role = 'user'),
c AS (SELECT id, term, count(*) AS n FROM (SELECT id, unnest(t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term FROM q) GROUP BY ALL),
r AS (SELECT id, term, n, (1 + ln(n)) * idf AS v FROM c JOIN voc USING (term)), z AS (SELECT id, sqrt(sum(v * v)) AS l FROM r GROUP BY id HAVING sum(n) >= 2),
s AS (SELECT id, label, k / 100.0 + sum(v / l * (((length(term) * 7 + ascii(term) * k) % 11) - 5) / 10.0) AS s FROM r JOIN z USING (id), lab GROUP BY id, label, k),
e AS (SELECT id, label, exp(s - max(s) OVER (PARTITION BY id)) / sum(exp(s - m)) OVER (PARTITION BY id) * exp(max(s) OVER (PARTITION BY id) - m) AS p FROM (SELECT *, max(s) OVER (PARTITION BY id) AS m FROM s))
SELECT id, arg_min(label, (-p, label)) AS label, round(max(p), 6) AS confidence, round(max(CASE label WHEN 'IMPORTANT' THEN p END), 6) AS keep, max(CASE label WHEN 'IMPORTANT' THEN p END) >= 0.75 AS veto, 1 - max(CASE label WHEN 'IMPORTANT' THEN p END) >= 0.9 AS propose FROM e GROUP BY id""",
    "badges": r"""WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, CAST(floor(value) AS BIGINT) % 101 AS score, value FROM events),
d AS (SELECT user_id, day, max(coalesce(score, 100) >= 90) AS credit FROM e WHERE day <= DATE '2024-01-30' GROUP BY ALL),
a AS (SELECT user_id, CASE WHEN bool_or(day = DATE '2024-01-30' AND credit) THEN DATE '2024-01-30' WHEN bool_or(day = DATE '2024-01-29') THEN DATE '2024-01-29' END AS anchor FROM d GROUP BY user_id),
broken AS (SELECT a.user_id, a.anchor, (SELECT min(k) FROM range(0, 40) r(k) WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.user_id = a.user_id AND d.credit AND d.day = a.anchor - CAST(k AS INTEGER))) AS streak FROM a WHERE anchor IS NOT NULL),
s AS (SELECT user_id, count(*) AS n, avg(coalesce(score, 100)) AS m, sum(CASE WHEN coalesce(score, 100) >= 85 THEN 1 ELSE 0 END) AS good, coalesce(sum(value * 0.00036), 0) AS saved FROM e GROUP BY user_id)
SELECT user_id, n >= 5 AND m >= 90 AS efficient, saved >= 1 AS saver, coalesce(streak, 0) >= 3 AS streak3, good >= 20 AS steady FROM s LEFT JOIN broken USING (user_id)""",
    "recommendations": r"""WITH e AS (SELECT user_id, event_id, ts, event_type, CAST(floor(value) AS BIGINT) % 101 AS score, value * 0.36 AS carbon, lag(event_type) OVER w AS before, lag(ts) OVER w AS was FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
a AS (SELECT user_id, sum(CASE WHEN score < 85 THEN 1 ELSE 0 END) AS weak, floor(avg(coalesce(score, 100)) + 0.5) AS mean, count(event_type) - count(DISTINCT event_type) AS repeats, sum(CASE WHEN event_type = before AND epoch_us(ts) - epoch_us(was) < 180000000 THEN 1 ELSE 0 END) AS rapid, sum(CASE WHEN CAST(ts AS DATE) = DATE '2024-01-30' THEN carbon ELSE 0 END) AS carbon FROM events JOIN e USING (user_id, event_id, ts, event_type) GROUP BY user_id),
f AS (SELECT user_id, 'filler_reduction' AS id, weak FROM a WHERE weak > 0 AND mean < 85 UNION ALL SELECT user_id, 'duplicate_prompts', weak FROM a WHERE repeats > 0 UNION ALL SELECT user_id, 'rapid_regens', weak FROM a WHERE rapid > 0 UNION ALL SELECT user_id, 'carbon_ceiling', weak FROM a WHERE carbon > 5)
SELECT user_id, id, CAST(15 * weak AS BIGINT) AS savings FROM f UNION ALL SELECT user_id, 'success_habits', CAST(15 * weak AS BIGINT) FROM a WHERE user_id NOT IN (SELECT user_id FROM f)""",
    "low_efficiency": "WITH e AS (SELECT user_id, CAST(floor(value) AS BIGINT) % 101 AS score FROM events) SELECT user_id, CAST(15 * count(*) FILTER (WHERE score < 85) AS BIGINT) AS savings FROM e GROUP BY user_id HAVING count(*) FILTER (WHERE score < 85) > 0 AND floor(avg(coalesce(score, 100)) + 0.5) < 85",
}

QUERIES = {f.__name__: f for f in (corpus_screen, reject_reasons, dedupe_first_wins, fingerprints, redact_pii, task_category, derived_flags, token_estimate_documents, token_savings, by_length, waste_points, scope_points, doubled_words, repeated_lines, word_overuse, attested_words, phrase_audit, review_flag_counts, near_duplicate_turns, classifier_inference, badges, recommendations, low_efficiency, efficiency_scores, masked_span_census, finding_counts, compression_benchmark)}

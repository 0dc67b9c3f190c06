"""The text kernels over DataFrames: one Arrow-batched UDF each, run once for each distinct text.

A dictionary is the caller's: a list of words by rank, of which the first MOST_WORDS are broadcast (a documented bound).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leanprompt.text import compress as C
from leanprompt.text import automaton, diff, findings, language, protect, scoring
from leanprompt.text.words import Dictionary

MOST_WORDS = 50_000


def apply_distinct(rows: DataFrame, column: str, schema: str, make: Callable[[], Callable], into: str, batch: bool = False, spread: bool = False) -> DataFrame:
    """rows with `into`, a struct of that schema: make()'s function of each distinct value of the column, joined back by
    its digest, so that a text that comes often is worked on once. A null value is worked on like any other. batch: the
    function is one of a list of values. spread: the work is slow for its bytes, so it is dealt out over all cores, where
    partitions merged by size would leave some idle."""
    kind = StructType.fromDDL(schema)

    def run(batches):
        step = make()
        for s in batches:
            done = [x for part in automaton.slices(s) for x in step(part)] if batch else [step(t) for t in s]
            yield pd.DataFrame(done, columns=kind.names)

    run.__annotations__ = {}
    udf = F.pandas_udf(run, kind, F.PandasUDFType.SCALAR_ITER)
    key = F.coalesce(F.sha2(column, 256), F.lit("null")).alias("_digest")
    keyed = rows.withColumn("_digest", key)
    values = keyed.groupBy("_digest").agg(F.first(column).alias("_value"))
    if spread:
        spark = rows.sparkSession
        values = values.repartition(max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "_digest")
    once = values.select("_digest", udf("_value").alias(into))
    return keyed.join(once, "_digest").drop("_digest")


@lru_cache(maxsize=2)
def _indexed(ranked: tuple[str, ...]) -> Dictionary:
    """The index of a list of words, once for each worker, not for each task."""
    return Dictionary(list(ranked))


def dictionary(words: DataFrame, order: str = "df") -> list[str]:
    """The first MOST_WORDS words of words(word, df), commonest first."""
    return [r["word"] for r in words.orderBy(F.desc(order), "word").limit(MOST_WORDS).collect()]


def masks(rows: DataFrame, column: str = "text") -> DataFrame:
    """rows with mask: the masked text, its spans and their names."""

    def make():
        return lambda ts: [(m.masked, m.spans, m.names) for m in protect.mask_all(ts)]

    return apply_distinct(rows, column, "masked string, spans array<string>, names array<string>", make, "mask", batch=True)


def unmasked(rows: DataFrame, masked: str = "masked", spans: str = "spans") -> DataFrame:
    """rows with `text` from a masked text and its spans."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else protect.unmask(t, list(s) if s is not None else []) for t, s in zip(a, b)])

    return rows.withColumn("text", F.pandas_udf(run, "string")(masked, spans))


def span_census(rows: DataFrame, column: str = "text") -> DataFrame:
    """(name, spans, texts): how many spans of each name masking takes out, and of how many rows."""

    def make():
        return lambda ts: [([{"name": n, "spans": k} for n, k in Counter(m.names).items()],) for m in protect.mask_all(ts)]

    found = apply_distinct(rows.select(column), column, "names array<struct<name: string, spans: long>>", make, "mask", batch=True)
    return found.select(F.explode("mask.names").alias("n")).groupBy("n.name").agg(F.sum("n.spans").alias("spans"), F.count("*").alias("texts"))


def scores(rows: DataFrame, ranked: list[str], column: str = "text") -> DataFrame:
    """rows with efficiency: the score (null for blank text) and the flags with their points."""
    shared = rows.sparkSession.sparkContext.broadcast(ranked)

    def make():
        words = _indexed(tuple(shared.value))

        return lambda ts: [(score, [f"{kind}: {label}" for kind, label, _ in flags], [p for _, _, p in flags]) for score, flags in scoring.efficiencies(ts, words)]

    return apply_distinct(rows, column, "score int, flags array<string>, points array<int>", make, "efficiency", batch=True, spread=True)


def flag_frequency(scored: DataFrame) -> DataFrame:
    """(flag, n): how often each flag of efficiency comes, the commonest first."""
    return scored.select(F.explode("efficiency.flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "flag")


def by_group(scored: DataFrame, group: str, least: int = 1) -> DataFrame:
    """(group, n, mean, perfect, flags): of groups of at least `least` scored rows."""
    e = scored.where("efficiency.score is not null").groupBy(group)
    out = e.agg(F.count("*").alias("n"), F.avg("efficiency.score").alias("mean"), (100 * F.avg(F.when(F.col("efficiency.score") == 100, 1).otherwise(0))).alias("perfect"), F.avg(F.size("efficiency.flags")).alias("flags"))
    return out.where(F.col("n") >= least)


FINDING = "struct<category: string, severity: string, explanation: string, confidence: double, text: string, start: int, question: string, source: string>"


def found(rows: DataFrame, column: str = "text", semantic: Callable[[str], list[dict]] | None = None) -> DataFrame:
    """rows with analysis: merged findings, and the questions to ask. semantic: a caller's own analyser, run on executors."""

    def make():
        def step(t):
            fs = findings.analyze(t, semantic)
            return [(f.category, f.severity, f.explanation, f.confidence, f.text, f.start, f.question, f.source) for f in fs], findings.clarifications(fs)

        return step

    return apply_distinct(rows, column, f"findings array<{FINDING}>, questions array<string>", make, "analysis")


def languages(rows: DataFrame, ranked: list[str], column: str = "text") -> DataFrame:
    """rows with language: whether a text is English, by its vocabulary too, and whether it is code."""
    shared = rows.sparkSession.sparkContext.broadcast(ranked)

    def make():
        words = _indexed(tuple(shared.value))
        return lambda t: (language.looks_english(t, words), language.looks_english_vocabulary(t, words), language.is_code(t))

    return apply_distinct(rows, column, "english boolean, vocabulary boolean, code boolean", make, "language")


def compressed(rows: DataFrame, ranked: list[str], strictness: str = "condense", preserve: frozenset[str] = frozenset(), column: str = "text", count: Callable[[str], int] = C.tokens) -> DataFrame:
    """rows with compression: status, text, mode, tokens before and after, and each candidate's violations. count: a
    caller's own token counter (an exact encoder, say) in place of the estimate."""
    shared = rows.sparkSession.sparkContext.broadcast(ranked)

    def make():
        words = _indexed(tuple(shared.value))

        def step(t):
            r = C.compress(t, words, strictness, count, preserve)
            return r.status, r.text, r.mode, r.before, r.after, r.percent, [(m, n, [f"{a}: {b}" for a, b in v]) for m, _, n, v in r.candidates]

        return step

    return apply_distinct(rows, column, "status string, text string, mode string, before int, after int, percent int, candidates array<struct<mode: string, tokens: int, violations: array<string>>>", make, "compression", spread=True)


def benchmark(done: DataFrame, *groups: str) -> DataFrame:
    """Of compressed rows, in all and by each group and size: prompts, tokens before and after, reduction, how many were
    compressed, and the upper median of the percentages of those."""
    c = F.col("compression")
    flat = done.select(*groups, c["before"].alias("before"), c["after"].alias("after"), c["percent"].alias("percent"), (c["after"] < c["before"]).alias("smaller")).withColumn("size", F.when(F.col("before") < 30, "short").when(F.col("before") < 120, "medium").otherwise("long"))
    keys = ["size", *groups]
    sets = flat.groupingSets([[], *[[k] for k in keys]], *keys).agg(F.count("*").alias("n"), F.sum("before").alias("before"), F.sum("after").alias("after"), F.sum(F.col("smaller").cast("int")).alias("compressed"), F.expr("percentile_disc(0.5) within group (order by percent desc) filter (where smaller)").alias("median"))
    return sets.withColumn("reduction", F.when(F.col("before") > 0, 100.0 * (F.col("before") - F.col("after")) / F.col("before")))


def rejections(done: DataFrame) -> DataFrame:
    """(mode, rule, n): how many candidates of a tier broke each rule; rule null: candidates in all."""
    c = done.select(F.explode("compression.candidates").alias("c")).select("c.mode", F.array_distinct(F.transform("c.violations", lambda v: F.substring_index(v, ":", 1))).alias("rules"))
    total = c.groupBy("mode").agg(F.count("*").alias("n")).select("mode", F.lit(None).cast("string").alias("rule"), "n")
    return c.select("mode", F.explode("rules").alias("rule")).groupBy("mode", "rule").agg(F.count("*").alias("n")).unionByName(total)


def examples(done: DataFrame, order: str, least: int = 40, many: int = 12, clip: int = 150) -> DataFrame:
    """The first `many` rows by order that became at least `least` percent shorter, texts clipped."""
    c = F.col("compression")
    return done.where(c["percent"] >= least).orderBy(order).limit(many).select(order, F.substring("text", 1, clip).alias("before"), F.substring(c["text"], 1, clip).alias("after"), c["percent"].alias("percent"))


def word_diffs(rows: DataFrame, before: str, after: str) -> DataFrame:
    """rows with diff: the words of both sides and whether they changed; null where there are too many."""
    kind = StructType.fromDDL("before array<struct<text: string, changed: boolean>>, after array<struct<text: string, changed: boolean>>")

    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([d if (d := diff.word_diff(x or "", y or "")) else (None, None) for x, y in zip(a, b)], columns=["before", "after"])

    return rows.withColumn("diff", F.pandas_udf(run, kind)(before, after))

"""Language identification by Bayesian evidence fusion (operator 3).

For each page and language: log posterior = log prior of the host + log likelihood of the declared markup language + log
likelihood of the address suffix + tempered log likelihood of the text. The text model is a byte-trigram model of each language
counted over all labelled documents. Declared languages and suffixes are weighed by how they go with the text's
verdicts over all pages (their shares of languages against all pages'); the host's prior is its pages' verdicts, smoothed
towards its domain's and that towards all pages'. Every one of these tables is a grouped aggregation, joined back by its key; a
page's own verdict is taken out of its priors.

A null or empty html has no text evidence and a null url no host or suffix: what is missing counts nothing, and a page
without any evidence gets the commonest language. Null page_ids stay null. Repeated rows give repeated results. Without labelled
documents or without pages the result is empty. Columns besides page_id, url and html are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batch, by_task, keep, table

BUCKETS_LOG2 = 14
ADD, SMOOTH = 0.5, 5.0
TEMPER, MOST = 0.2, 200.0  # neighbouring trigrams overlap; text counts as so many independent trigrams at most


def grams(text: str | None) -> np.ndarray:
    """Hashed trigrams of the lower-cased text's bytes."""
    raw = np.frombuffer((text or "").lower().encode(), np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.empty(0, np.int64)
    return (((raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS_LOG2)).astype(np.int64)


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of docs(text, lang) with a language."""

    def make():
        seen: dict[str, np.ndarray] = {}

        def step(batch: pa.RecordBatch) -> None:
            for t, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if lang not in seen:
                    seen[lang] = np.zeros(1 << BUCKETS_LOG2, np.int64)
                seen[lang] += np.bincount(grams(t), minlength=1 << BUCKETS_LOG2)

        def finish() -> dict:
            some = {lang: np.flatnonzero(n) for lang, n in seen.items()}
            return {"lang": [lang for lang, at in some.items() for _ in at], "gram": np.concatenate(list(some.values())), "n": np.concatenate([seen[lang][at] for lang, at in some.items()])}

        return step, finish

    return by_task(docs.where("lang is not null").select("text", "lang"), "lang string, gram long, n long", make).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def visible(html: Column) -> Column:
    """The text of a page: scripts, styles, comments and tags removed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(bare, r"<[^>]*>", " ")


def evidence(pages: DataFrame) -> DataFrame:
    """page_id, doc_id (the number that ends the address's path, if any), text, declared, suffix, domain and host."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    some = lambda c: F.when(c != "", c)
    declared = F.lower(F.regexp_extract("html", r"(?is)^[^>]*?<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1))
    declared = F.coalesce(some(declared), some(F.lower(F.regexp_extract("html", r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1))))
    return pages.select(
        "page_id",
        F.expr(r"try_cast(nullif(regexp_extract(url, '/([0-9]{1,18})(?:[?#].*)?$', 1), '') as bigint)").alias("doc_id"),
        visible(F.coalesce("html", F.lit(""))).alias("text"),
        declared.alias("declared"),
        some(F.regexp_extract(host, r"\.([a-z0-9-]+)$", 1)).alias("suffix"),
        some(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).alias("domain"),
        some(host).alias("host"),
    )


def text_scores(rows: DataFrame, langs: list[str], logp: np.ndarray) -> DataFrame:
    """rows with its text replaced by each language's tempered log-likelihood; null where the text has no trigram."""
    shared = rows.sparkSession.sparkContext.broadcast(logp)

    @F.pandas_udf("array<double>")
    def score(s):
        def one(t):
            g = grams(t)
            if not len(g):
                return None
            mean = np.bincount(g, minlength=1 << BUCKETS_LOG2) @ shared.value / len(g)
            return (mean - mean.max()) * TEMPER * min(len(g), MOST)

        return s.map(one)

    return rows.withColumn("scores", score("text")).drop("text")


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, doc_id, lang, posterior, text_lang, declared, suffix and host of each page."""
    counts = trigram_counts(docs).collect()  # languages x 2 ** BUCKETS_LOG2 rows at most
    langs = sorted({r["lang"] for r in counts})
    at = {x: k for k, x in enumerate(langs)}
    n = np.zeros((1 << BUCKETS_LOG2, max(1, len(langs))))
    for r in counts:
        n[r["gram"], at[r["lang"]]] = r["n"]
    logp = np.log((n + ADD) / (n.sum(0) + ADD * len(n)))
    scored = text_scores(evidence(pages), langs, logp)
    if not langs:
        return scored.where("false").select("page_id", "doc_id", F.lit("").alias("lang"), F.lit(0.0).alias("posterior"), F.lit("").alias("text_lang"), "declared", "suffix", "host")
    names = F.array(*map(F.lit, langs))
    # without the test of xs, element_at() gives a null place some language
    best = lambda xs: F.when(xs.isNotNull(), F.element_at(names, F.array_position(xs, F.array_max(xs)).cast("int")))
    page = keep(scored.withColumn("key", F.monotonically_increasing_id()).withColumn("text_lang", best(F.col("scores"))))

    own = [F.when(F.col("text_lang") == x, 1).otherwise(0) for x in langs]  # a page's own verdict; null text: none
    sums = [F.sum(o).alias(f"n{k}") for k, o in enumerate(own)]
    vector = F.array(*[F.col(f"n{k}") for k in range(len(langs))])
    world = page.agg(*[F.coalesce(s, F.lit(0)).alias(f"n{k}") for k, s in enumerate(sums)]).first()
    total = sum(world)
    everywhere = F.array(*[F.lit((x + 1) / (total + len(langs))) for x in world])

    def by(column: str) -> DataFrame:
        return page.where(F.col(column).isNotNull()).groupBy(column).agg(*sums).select(column, vector.alias(f"of_{column}"))

    joined = page
    for column in ("declared", "suffix", "domain", "host"):
        joined = joined.join(by(column), column, "left")
    mine = F.array(*own)
    zero = F.array_repeat(F.lit(0), len(langs))

    def less_own(column: str) -> Column:
        return F.zip_with(F.coalesce(F.col(f"of_{column}"), F.when(F.lit(False), zero)), mine, lambda a, b: F.greatest(a - b, F.lit(0)))

    def smooth(column: str, parent: Column) -> Column:
        """The column's counts without this page, drawn towards the parent's shares."""
        c = less_own(column)
        size = F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
        return F.coalesce(F.zip_with(c, parent, lambda x, p: (x + SMOOTH * p) / (size + SMOOTH)), parent)

    def likelihood(column: str) -> Column:
        """log P(value | language) up to a constant of the value: the shares of languages within it, against all pages'."""
        return F.coalesce(F.zip_with(smooth(column, everywhere), everywhere, lambda a, b: F.log(a / b)), F.array_repeat(F.lit(0.0), len(langs)))

    prior = F.transform(smooth("host", smooth("domain", everywhere)), lambda p: F.log(p))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    text = F.coalesce("scores", F.array_repeat(F.lit(0.0), len(langs)))
    post = add(add(add(prior, likelihood("declared")), likelihood("suffix")), text)
    out = joined.select("key", "page_id", "doc_id", "text_lang", "declared", "suffix", "host", post.alias("post"))
    top = F.array_max("post")
    mass = F.aggregate("post", F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return out.select("page_id", "doc_id", best(F.col("post")).alias("lang"), (1 / mass).alias("posterior"), "text_lang", "declared", "suffix", "host")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


QUERIES = {"op3_langid": op3_langid}
ORACLES: dict[str, str] = {}

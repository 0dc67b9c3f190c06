"""Scalar measures as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+\z", "")


def js_round(c: Column) -> Column:
    """Half up, also below zero."""
    return F.floor(c + 0.5).cast("long")


def token_estimate(c: Column) -> Column:
    """0 for blank text; a quarter of the characters, averaged with 1.33 a word unless there are no real words.

    Measured once: the trimmed length and the words go through a one-element array, so that no pattern runs twice.
    """
    sizes = F.array(F.struct(F.length(trim(c)).alias("n"), F.regexp_count(c, F.lit(r"\S+")).alias("w")))

    def one(x: Column) -> Column:
        n, w = x["n"], x["w"]
        quarter = js_round(n / 4.0)
        mixed = F.greatest(F.lit(1), js_round((js_round(1.33 * w) + quarter) / 2.0))
        return F.when(n.isNull() | (n == 0), 0).when((w == 0) | (n > 20 * w), F.greatest(F.lit(1), quarter)).otherwise(mixed).cast("long")

    return F.element_at(F.transform(sizes, one), 1)


def energy(tokens: Column) -> Column:
    """Wh, to four places; none below zero."""
    return F.round(F.greatest(F.lit(0), tokens) * 0.001, 4)


def carbon(tokens: Column) -> Column:
    """Grams of CO2, to four places; none below zero."""
    return F.round(F.greatest(F.lit(0), tokens) * 0.001 * 0.36, 4)


def avoided(tokens: Column) -> Column:
    """Grams that saved tokens avoid, not rounded."""
    return F.greatest(F.lit(0), tokens) * 0.001 * 0.36


def token_stats(before: Column, after: Column) -> Column:
    """struct(original, optimized, saved, percent); what is saved can be negative."""
    b, a = token_estimate(before), token_estimate(after)
    return F.struct(b.alias("original"), a.alias("optimized"), (b - a).alias("saved"), F.when(b > 0, js_round((b - a) / b * 100)).otherwise(0).alias("percent"))


def attachment_tokens(prompt: Column, images: Column, pills: Column) -> Column:
    """What links (2,000 each), images (170) and documents cost; a document by the size on its pill, a quarter token a byte,
    or 2,000 if none is shown."""

    def pill(p: Column) -> Column:
        size, unit = (F.regexp_extract(p, r"(?i)(\d+(?:\.\d+)?)\s*(KB|MB|bytes)", k) for k in (1, 2))
        scale = F.when(F.upper(unit) == "MB", 1024 * 1024).when(F.upper(unit) == "KB", 1024).otherwise(1)
        return F.when(size == "", 2000).otherwise(js_round(size.cast("double") * scale * 0.25)).cast("long")

    docs = F.aggregate(F.transform(F.coalesce(pills, F.array().cast("array<string>")), pill), F.lit(0).cast("long"), lambda s, x: s + x)
    return F.regexp_count(prompt, F.lit(r"https?://[^\s]+")) * 2000 + F.coalesce(images, F.lit(0)) * 170 + docs


def grams(g: Column) -> Column:
    milli = F.concat(js_round(g * 1000).cast("string"), F.lit(" mg"))
    return F.when(g.isNull() | (g <= 0), "0 g").when(g < 0.001, "<1 mg").when(g < 1, milli).otherwise(F.concat(F.format_number(g, "0.0"), F.lit(" g")))

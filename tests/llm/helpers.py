"""Small fixtures and plain-Python versions of what the operators compute."""

import re
import zlib

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = " \t\n\v\f\r"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return [w for w in re.split(f"[{SPACE}]+", lower(text)) if w]


def fold(i, modulus):
    return zlib.crc32(str(i).encode()) % modulus


def table(name):
    import pandas as pd

    return pd.read_parquet(f"{DIR}/{name}.parquet")


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns with clashing names."""
    long = "the quick brown fox jumps over a lazy dog " * 9_000
    rows = [(1, "", "en", "a", 0), (2, None, None, None, None), (None, "some text here", "en", "a", 3), (3, long, "en", "b", 5), (3, long, "en", "b", 5), (4, "plain words of a plain text", "en", "a", 2), (4, "plain words of a plain text", "en", "a", 2), (None, None, None, None, None), (5, "plain words of a plain text", "en", "a", 2)]
    from pyspark.sql import functions as F

    extra = "score word c n key fp component_id u v root held_out y item_id start words keys hash digest k part gram tf base label".split()
    return spark.createDataFrame(rows, DOCS).withColumns({x: F.lit("clash") for x in extra})


def no_documents(spark):
    return spark.createDataFrame([], DOCS)

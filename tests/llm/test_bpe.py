"""Chunked encoding against the library that defines the ids, and exact round trips."""

import hashlib
import random
import time

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from leanprompt.llm import bpe

from .helpers import DIR, no_documents, odd_documents, table

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def whole():
    from tiktoken.load import load_tiktoken_bpe

    return tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(PATH), special_tokens={})


def digest(x):
    return hashlib.sha256(x).hexdigest()


def check(whole, text, row):
    ids = whole.encode_ordinary(text or "")
    assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (len(ids), digest(" ".join(map(str, ids)).encode()), digest((text or "").encode()))


def test_whole_table(spark, whole):
    t = table("documents")
    got = {r.doc_id: r for r in bpe.op10_bpe_codec(spark, DIR).collect()}
    for i, text in zip(t.doc_id, t.text):
        check(whole, text, got[i])


@pytest.mark.parametrize("chunk,overlap", [(64, 16), (50, 3), (7, 2)])
def test_small_chunks(spark, whole, chunk, overlap):
    r = random.Random(1)
    parts = ["a", "word", " ", "   ", "\n", "\n\n", "'s", "'ll", "1234", "!?", "é", "漢字", "😀", "\t", "x" * 90, " " * 70, "1" * 70, "́"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(0, 120))) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in bpe.encode_documents(docs, PATH, chunk=chunk, overlap=overlap).collect():
        check(whole, texts[row.doc_id], row)


def test_odd_rows(spark, whole):
    docs = odd_documents(spark)
    got = bpe.encode_documents(docs, PATH).collect()
    assert len(got) == docs.count()
    texts = {r.doc_id: r.text for r in docs.where(F.col("doc_id").isNotNull()).collect()}
    for row in got:
        if row.doc_id is not None:
            check(whole, texts[row.doc_id], row)
    assert bpe.encode_documents(no_documents(spark), PATH).count() == 0


def test_a_very_long_text_takes_linear_time(spark, whole):
    text = "wörter ünd so weiter, 123 " * 400_000
    docs = spark.createDataFrame([(k, text) for k in range(2)], "doc_id long, text string").repartition(2)
    began = time.time()
    got = bpe.encode_documents(docs, PATH).collect()
    assert time.time() - began < 90
    assert len(got) == 2 and {r.decoded_sha256 for r in got} == {digest(text.encode())}
    assert {r.n_tokens for r in got} == {len(whole.encode_ordinary(text))}

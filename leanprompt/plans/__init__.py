"""Registered queries of the engine's own operators, and their oracles: those of `operators` in
one text, in the spelling of either engine; those of `direct` as DataFrames with oracles of their own."""

from __future__ import annotations

from leanprompt.functions.dialect import ORACLE, SPARK
from leanprompt.operators import corpus, history
from leanprompt.plans import direct
from leanprompt.sources.tables import register


def _query(make):
    def run(spark, sf_dir):
        register(spark, sf_dir)
        return spark.sql(make(SPARK))

    return run


_ALL = [*history.QUERIES, *corpus.QUERIES]
QUERIES = {make.__name__: _query(make) for make in _ALL} | direct.QUERIES
ORACLES = {make.__name__: make(ORACLE) for make in _ALL} | direct.ORACLES

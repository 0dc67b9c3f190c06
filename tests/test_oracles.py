"""Each registered query against its oracle, on the smallest tables."""

import duckdb
import pytest

from leanprompt import plans

DIR = "/root/testdata/sf0.001"


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    show = lambda x: f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted(tuple(show(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations", "events", "pages", "embeddings"):
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_matches_oracle(spark, duck, name):
    got = plans.QUERIES[name](spark, DIR)
    want = duck.sql(plans.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())

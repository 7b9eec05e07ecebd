import os

import duckdb
import pytest

from tidemark.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_oracle(spark, duck, name):
    found = registry.QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    result = duck.execute(registry.ORACLE_SQL[name])
    places = [[d[0] for d in result.description].index(c) for c in columns]
    assert sorted(repr(tuple(r)) for r in found.select(columns).collect()) == sorted(repr(tuple(r[i] for i in places)) for r in result.fetchall())


def test_every_query_has_an_oracle():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)

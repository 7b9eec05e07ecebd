"""What the parsers read from feeds and pages that are given as texts."""

import duckdb
import pytest

from tests import golden_feeds


@pytest.mark.parametrize("name", sorted(golden_feeds.QUERIES))
def test_golden(spark, name):
    found = golden_feeds.QUERIES[name](spark, None)
    columns = sorted(found.columns)
    result = duckdb.connect().execute(golden_feeds.ORACLE_SQL[name])
    places = [[d[0] for d in result.description].index(c) for c in columns]
    assert sorted(repr(tuple(r)) for r in found.select(columns).collect()) == sorted(repr(tuple(r[i] for i in places)) for r in result.fetchall())

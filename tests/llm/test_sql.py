"""Queries against their SQL, on the small tables."""

from collections import Counter

import duckdb
import pytest

from vantle.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op2_near_duplicates"])
def test_query_equals_its_sql(spark, name):
    found = queries.queries()[name](spark, SMALL)
    with duckdb.connect() as c:
        for table in ("documents", "benchmark", "labels", "pages"):
            c.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
        got = c.sql(queries.oracle_sql()[name])
        columns = sorted(found.columns)
        assert sorted(got.columns) == columns
        assert Counter(map(tuple, found.select(*columns).collect())) == Counter(got.select(*columns).fetchall())

"""Corpus queries that SQL can express, against DuckDB."""

import pytest

from tests.test_queries import plain
from vellum.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_duckdb(spark, duck, sf, name):
    got, want = QUERIES[name](spark, sf), duck.sql(ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    assert sorted(repr(plain(tuple(r))) for r in got.select(*columns).collect()) == sorted(repr(plain(tuple(r[i] for i in order))) for r in want.fetchall())

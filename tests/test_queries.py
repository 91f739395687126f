"""Every query with SQL against DuckDB, and every other one for its schema and rows."""

import pytest

from vellum.plans.queries import ORACLE, QUERIES


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_duckdb(spark, duck, sf, name):
    got = QUERIES[name](spark, sf)
    want = duck.sql(ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    a = sorted(repr(plain(tuple(r))) for r in got.select(*columns).collect())
    b = sorted(repr(plain(tuple(r[i] for i in order))) for r in want.fetchall())
    assert a == b


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


OVERLAPS = [(1, "a\nb\nc\nd", "c\nd\ne"), (2, "a\nb", "x\ny"), (3, "", "x"), (4, "a\nb\nc", "c\nz"), (5, "a\nb\nc\nt", "b\nc\nd\nu"), (6, "p\nq\nr\ns", "n\nq\nr\ns\nv")]
EXPECTED = [(1, "a\nb\nc\nd\ne", 2, 1.0), (2, "a\nb\n\nx\ny", 0, 0.0), (3, "\nx", 0, 0.0), (4, "a\nb\nc\n\nc\nz", 0, 0.0), (5, "a\nb\nc\nt\n\nb\nc\nd\nu", 0, 0.0), (6, "p\nq\nr\ns\n\nn\nq\nr\ns\nv", 0, 0.0)]


def test_merge_pairs_as_expected(spark):
    from vellum.operators.merge import merge_pairs

    assert [tuple(r) for r in merge_pairs(spark.createDataFrame(OVERLAPS, "pair_id int, text_a string, text_b string")).orderBy("pair_id").collect()] == EXPECTED


@pytest.mark.parametrize("partitions", [1, 3, 11])
def test_partitions_do_not_matter(spark, sf, partitions):
    from vellum.operators.frequency import strip_repeated_lines
    from vellum.plans.queries import DEMO, pages_of

    rows = lambda df: sorted(map(tuple, strip_repeated_lines(df, DEMO).select("group_id", "page_seq", "text", "removed").collect()))
    pages = pages_of(spark, sf)
    assert rows(pages.repartition(partitions)) == rows(pages)

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    flat = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 9) if isinstance(v, float) else v
    return sorted(([flat(r[k]) for k in order] for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equal_to_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got.columns, got.collect()) == _rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n.startswith("dedup_") and n not in entry.oracle_sql()))
def test_cdc_measures(spark, name):
    r = entry.queries()[name](spark, SF).first()
    assert r.cdc_dedup_ratio >= 1 and r.span_count >= r.chunk_count > 200


def test_entry(spark):
    assert entry.entry(spark).count() == 1

"""Every query with SQL equals it on the smallest tables; every other one gives rows."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

from cuelattice.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _plain(v):
    if isinstance(v, (float, Decimal)):
        return "nan" if math.isnan(v) else f"{float(v) + 0.0:.7g}"
    return [_plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def _rows(rows, columns):
    return sorted(repr([_plain(r[c]) for c in sorted(columns)]) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    there = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    assert _rows(got.collect(), got.columns) == _rows(there, got.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name, tmp_path):
    # written, as a result with two columns of one name can be counted, but not kept
    QUERIES[name](spark, SF).write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_have_names_of_their_own(spark, name):
    columns = [c.lower() for c in QUERIES[name](spark, SF).columns]
    assert len(columns) == len(set(columns))


#: Queries whose intervals are far longer than the buckets they meet in: they must stand a larger table, too.
LONG = ("cut_places", "sentence_home", "lead_times", "fills_needed", "sound_judged", "where_said", "owned_lines")


@pytest.mark.parametrize("name", LONG)
def test_equals_sql_on_a_larger_table(spark, name):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    large = "/root/testdata/sf0.1"
    for t in ("events", "documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{large}/{t}.parquet'")
    got, want = QUERIES[name](spark, large).toPandas(), con.sql(SQL[name]).df()
    assert len(got) == len(want) > 0
    for c in want.columns:
        assert sorted(map(str, got[c].map(_plain))) == sorted(map(str, want[c].map(_plain))) or abs(got[c].sum() - want[c].sum()) < 1


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)

"""Every registered query against its DuckDB oracle on the smallest tables."""

import math

import duckdb
import pytest

from folioscale.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return connection


def cells(row):
    return tuple("NULL" if x is None or (isinstance(x, float) and math.isnan(x)) else repr(float(x)) if isinstance(x, float) else str(x) for x in row)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    if name not in catalogue.ORACLES:
        assert got.count() > 0
        return
    columns = sorted(got.columns)
    want = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert sorted(cells(r) for r in got.select(*columns).collect()) == sorted(cells([r[i] for i in order]) for r in want.fetchall())


@pytest.mark.parametrize("name, source, key", [("product_resolution", "orders", "o_orderkey"), ("verdict_table", "orders", "o_orderkey"), ("cell_completeness", "orders", "o_orderkey"), ("cell_range_read", "lineitem", "l_orderkey"), ("unresolved_spans", "orders", "o_orderkey")])
def test_whole_queries_leave_no_row_out(spark, duck, name, source, key):
    got = catalogue.QUERIES[name](spark, SF)
    own = got.columns[0]
    assert {r[0] for r in got.select(own).distinct().collect()} == {r[0] for r in duck.execute(f"SELECT DISTINCT {key} FROM {source}").fetchall()}


def confidence_rows(spark, sf):
    connection = duckdb.connect()
    connection.execute("SET threads = 1")
    connection.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{sf}/lineitem.parquet')")
    want = connection.execute(catalogue.ORACLES["line_confidence"])
    names = [d[0] for d in want.description]
    return sorted(map(cells, catalogue.QUERIES["line_confidence"](spark, sf).select(*names).collect())), sorted(map(cells, want.fetchall()))


def test_line_confidence_adds_up_in_a_fixed_order(spark):
    got, want = confidence_rows(spark, "/root/testdata/sf0.01")
    assert got == want


def test_line_confidence_of_lines_with_nulls(spark, tmp_path):
    rows = ["(1, 1, 0.05, NULL)", "(1, 2, 0.01, 'N')", "(2, 1, 0.09, NULL)", "(3, NULL, 0.09, 'N')", "(3, 1, NULL, 'A')", "(NULL, 1, 0.09, 'N')", "(4, 3, 0.09, 'N')", "(4, 2, 0.02, 'R')", "(5, 1, 'nan'::DOUBLE, 'N')", "(5, 2, 0.09, 'N')"]
    duckdb.sql(f"COPY (SELECT k::BIGINT AS l_orderkey, n::INTEGER AS l_linenumber, d::DOUBLE AS l_discount, f AS l_returnflag FROM (VALUES {', '.join(rows)}) t(k, n, d, f)) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    got, want = confidence_rows(spark, tmp_path)
    assert got == want and ("2", "NULL", "NULL", "ok") in got

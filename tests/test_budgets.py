"""Ordered greedy budgets against one walk."""

import random

import duckdb
import pytest

from folioscale.operators import budgets
from folioscale.sources import readers


def walk(rows, total, most):
    out, used, n = {}, 0, 0
    for name, size in sorted(rows):
        if n >= most:
            out[name] = "count"
        elif used + (size or 0) > total:
            out[name] = "total"
        else:
            out[name], used, n = "taken", used + (size or 0), n + 1
    return out


@pytest.mark.parametrize("total, most", [(10_000, 10**6), (3_000, 70), (0, 50), (500, 0), (10**9, 10**6), (10**9, 400), (37, 10**6)])
def test_budgets_equal_one_walk(spark, total, most):
    rng = random.Random(total + most)
    rows = [(f"{i:05d}", rng.choice([0, 1, 2, 7, 300, 2000, None])) for i in range(400)]
    df = spark.createDataFrame(rows, "name string, size long").repartition(3)
    got = {r.name: r.verdict for r in budgets.budgeted(df, ["name"], "size", total, most).collect()}
    assert got == walk(rows, total, most)


def test_a_million_sizes(spark):
    import numpy as np

    sizes = np.random.default_rng(1).integers(1, 5000, 1_000_000)
    df = spark.createDataFrame(__import__("pandas").DataFrame({"i": np.arange(1_000_000), "size": sizes}))
    total = int(sizes.sum() // 2)
    got = budgets.budgeted(df, ["i"], "size", total, 900_000).where("verdict = 'taken'")
    used, taken = 0, 0
    for size in sizes.tolist():
        if used + size <= total:
            used, taken = used + size, taken + 1
    row = got.agg({"size": "sum", "i": "count"}).first()
    assert (row["sum(size)"], row["count(i)"]) == (used, taken)


def test_every_document_within_a_budget(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text").collect()
    rows = [((f"{r.source}/{r.doc_id:09d}", r.doc_id), len(r.text.encode())) for r in docs]
    want = walk(rows, sum(s for _, s in rows) // 3, len(rows) * 2 // 3)
    assert {r.doc_id: r.verdict for r in budgets.QUERIES["greedy_budget"](spark, sf).collect()} == {k[1]: v for k, v in want.items()}


def test_a_folder_within_its_budgets(spark, tmp_path):
    for name, size in (("a.md", 5), ("b.md", 50), ("c.txt", 4), ("d.md", 3), ("e.exe", 1), (".h.md", 1), ("f.md", 200)):
        (tmp_path / name).write_bytes(b"x" * size)
    got = {r.relative: r.issue for r in readers.scan_within(spark, str(tmp_path), 3, 100, 12).collect()}
    assert got == {"a.md": None, "b.md": "no_room_left", "c.txt": None, "d.md": None, "e.exe": "unsupported", "f.md": "too_large"}


def test_pages_of_a_group_that_has_no_room(spark, tmp_path):
    """One order of 20 lines (floors of 20480 bytes within 20000) has no bytes, and the others keep theirs, as in the SQL."""
    lines = " UNION ALL ".join(f"SELECT {k}::BIGINT AS l_orderkey, n::INTEGER AS l_linenumber, n::BIGINT AS l_partkey, 0::BIGINT AS l_suppkey FROM range({n}) r(n)" for k, n in ((1, 19), (2, 20), (3, 2), (4, 1100)))
    duckdb.sql(f"COPY ({lines}) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet')")
    want = sorted(connection.execute(budgets.ORACLES["page_budget_alloc"]).fetchall())
    got = sorted(map(tuple, budgets.QUERIES["page_budget_alloc"](spark, str(tmp_path)).collect()))
    assert got == want and got[1] == (2, 20, None, None, None) and got[0][4] == 20_000

"""Every query of the library against its SQL on the smallest tables, and a self-test of the comparison."""

import os
from decimal import Decimal

import duckdb
import pytest

from scrivane.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, Decimal):
        return round(float(value), 9)
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    assert len(set(df.columns)) == len(df.columns)
    if name in catalog.ORACLES:
        rel = db.sql(catalog.ORACLES[name])
        assert sorted(rel.columns) == sorted(df.columns)
        assert rows_of(df.columns, rows) == rows_of(rel.columns, rel.fetchall())
    else:
        assert rows


def test_a_broken_operator_is_noticed(spark, db):
    df = catalog.QUERIES["chunks_legacy"](spark, SF).where("chunk_id <> 'chunk-00002'")
    rel = db.sql(catalog.ORACLES["chunks_legacy"])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) != rows_of(rel.columns, rel.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_library_does_not_lean_on_the_training_data_operators():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scrivane")
    for folder, _, names in os.walk(root):
        if os.sep + "llm" not in folder:
            for name in names:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name), encoding="utf-8") as f:
                        assert "scrivane.llm" not in f.read(), name

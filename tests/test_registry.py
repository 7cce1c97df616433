"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from quarry.plans import registry

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Queries that SQL cannot express, and the test that holds each against a plain replay.
WITHOUT_SQL = {"queue_accounting": "tests/test_more.py::test_queue_accounting_matches_a_plain_replay"}


def canonical(rows):
    def one(v):
        return "null" if v is None else repr(round(float(v), 6) + 0.0) if isinstance(v, float) else v.isoformat()[:19] if hasattr(v, "isoformat") else str(v)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    frame = registry.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    rows = [tuple(r[c] for c in columns) for r in frame.collect()]
    if name not in registry.ORACLE:
        path, test = WITHOUT_SQL[name].split("::")
        assert f"def {test}(" in open(os.path.join(ROOT, path), encoding="utf-8").read()
        return
    result = con.execute(registry.ORACLE[name])
    have = [d[0] for d in result.description]
    assert sorted(have) == columns
    assert canonical(rows) == canonical([tuple(r[have.index(c)] for c in columns) for r in result.fetchall()])


def test_every_query_has_sql_or_a_test():
    assert set(registry.QUERIES) == set(registry.ORACLE) | set(WITHOUT_SQL)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["value", "cnt"]

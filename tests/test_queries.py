"""Every query that SQL can express against DuckDB on the same files."""

import duckdb
import pytest

from tessera.plans.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def db():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return c


def plain(v):
    return v.isoformat() if hasattr(v, "isoformat") else repr(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    got = df.collect()
    found = db.execute(ORACLES[name])
    names = [x[0] for x in found.description]
    want = found.fetchall()
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    assert got, "a query without rows shows nothing"
    assert sorted(tuple(plain(r[k]) for k in order) for r in got) == sorted(tuple(plain(r[names.index(k)]) for k in order) for r in want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLES) <= set(__spark_entry__.oracle_sql())


def test_nothing_else_imports_the_corpus_operators():
    import pathlib
    import re

    root = pathlib.Path(__file__).parent.parent
    for path in root.glob("tessera/**/*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"tessera\.llm|corpus_pipeline", path.read_text()), path

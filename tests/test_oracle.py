"""Every query that has oracle SQL against DuckDB on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as entry
from plumbline import queries as engine

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLE = engine.oracle_sql()


def rows(raw, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple("NULL" if r[i] is None else f"{r[i]:.6g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in raw)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_oracle(spark, sf_dir, duck, name):
    df = engine.queries()[name](spark, sf_dir)
    got = duck.execute(ORACLE[name])
    names = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(names)
    assert not [f.name for f in df.schema if f.dataType.typeName() == "decimal"]
    assert rows(map(tuple, df.collect()), df.columns) == rows(got.fetchall(), names)


def test_entry_is_lazy_and_has_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Every query of the driver's map against its DuckDB SQL, or against a plain version."""

import math

import duckdb
import pytest

from plain import PLAIN

from cadenza.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else int(v) if v == int(v) else round(v, 6)
    return float(v) if type(v).__name__ == "Decimal" else v


def rows(names, records):
    by = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(r[i]) for i in by]) for r in records)


@pytest.fixture(scope="module")
def duck(tables):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{tables}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, duck, name):
    df = QUERIES[name](spark, tables)
    got = df.collect()
    if name not in ORACLE_SQL:
        assert sorted(repr([plain(v) for v in r]) for r in got) == sorted(repr([plain(v) for v in r]) for r in PLAIN[name](tables))
        return
    want = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, got) == rows(names, want.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)

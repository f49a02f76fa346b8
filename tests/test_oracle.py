"""Every query of the library against its SQL, over the smallest tables."""

import math
from decimal import Decimal

import duckdb
import pytest

from termforge import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if isinstance(v, (float, Decimal)):
        return None if math.isnan(v) else round(float(v), 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    return float(v) if isinstance(v, (int, bool)) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    said = duck.execute(registry.oracle_sql()[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in said.description], said.fetchall())


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())

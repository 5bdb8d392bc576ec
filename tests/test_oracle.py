"""Every registered query against its DuckDB oracle on sf0.001 (the driver does sf0.01)."""

import hashlib
import json
import math

import duckdb
import pytest

from conftest import SF_SMALL

import __spark_entry__ as E
from tillgrid.plans.registry import all_oracle_sql, all_queries

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
ORACLE = all_oracle_sql()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    return str(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(json.dumps([_norm(r[i]) for i in order]) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_matches_oracle(spark, duck, key):
    df = E.queries()[key](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    res = duck.execute(ORACLE[key])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(rows) == len(drows)
    assert hashlib.sha256("\n".join(_digest(df.columns, rows)).encode()).hexdigest() == \
        hashlib.sha256("\n".join(_digest(dcols, drows)).encode()).hexdigest()


def test_every_key_registered():
    keys = set(all_queries())
    assert keys == set(ORACLE) and keys <= set(E.queries()) and len(keys) == 110


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["nom_produit", "quantite", "chiffre", "marge_estimee"]
    assert df.count() <= 8

"""Every registered query against its DuckDB oracle on the smallest driver tables."""

import hashlib
import math

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from tessera.plans import registry

registry.load_all()
KEYS = sorted(registry.QUERIES)
SQL = registry.ORACLE


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "∅"
    if isinstance(v, float):
        return repr(round(v, 6))
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def _digest(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("\x1f".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\x1e".join(lines).encode()).hexdigest()


def test_every_key_has_oracle():
    assert set(KEYS) == set(SQL)


@pytest.mark.parametrize("key", KEYS)
def test_matches_duckdb(spark, duck, key):
    df = registry.QUERIES[key](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    rel = duck.sql(SQL[key])
    drows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(rows) == len(drows)
    assert _digest(rows, df.columns) == _digest(drows, rel.columns)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["Cliente", "SaldoCliente", "CF", "Denominazione"]
    assert df.count() > 0

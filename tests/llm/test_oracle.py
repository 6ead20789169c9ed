"""The operators' queries that SQL can express, against DuckDB on the smallest driver tables."""
import pytest

from tessera.llm import queries as Q

from .common import SF


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_matches_duckdb(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    got = duck.sql(Q.ORACLE[name])
    columns = sorted(df.columns)
    assert columns == sorted(got.columns)
    assert sorted(map(str, df.select(*columns).collect())) == sorted(map(str, spark.createDataFrame(got.project(", ".join(columns)).fetchall(), df.select(*columns).schema).collect()))

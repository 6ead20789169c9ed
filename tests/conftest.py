import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tessera.session import build_session
    s = build_session("local[*]", app_name="tessera-tests", shuffle_partitions=8)
    yield s
    from tessera.session import drop_scratch
    drop_scratch(s)
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb
    from tessera.plans.fixtures import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.fixture()
def tmp_dir(tmp_path):
    return str(tmp_path)

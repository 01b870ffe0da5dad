import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = os.environ.get("TESTDATA", "/root/testdata") + "/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from editloom.session import local_session
    s = local_session(8, "editloom-tests")
    s.sparkContext.setLogLevel("OFF")
    return s


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    from editloom.checks.fixtures import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con

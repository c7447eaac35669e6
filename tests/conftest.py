"""One session, and DuckDB over the same tables."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (str(ROOT), os.environ.get("PYTHONPATH")) if x)
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from quernel.session import get_session

    made = get_session("8")
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


@pytest.fixture(scope="session")
def duck():
    return connect(SF)


@pytest.fixture(scope="session")
def same_rows(duck):
    """Asserts that a DataFrame has the rows and columns of a DuckDB query, in any order."""
    from tests.compare import normal

    known = {SF: duck}

    def check(df, sql, folder=SF):
        con = known.setdefault(folder, None) or known.update({folder: connect(folder)}) or known[folder]
        got = con.execute(sql)
        names = [x[0] for x in got.description]
        order = sorted(range(len(names)), key=names.__getitem__)
        want = sorted(normal([r[i] for i in order]) for r in got.fetchall())
        assert sorted(df.columns) == sorted(names)
        found = sorted(normal(r) for r in df.select(*sorted(df.columns)).collect())
        assert len(found) == len(want)
        assert found == want

    return check

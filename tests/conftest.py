import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from terrace.session import build_session

    os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
    os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 4g pyspark-shell")
    session = build_session("tests", "local[4]", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return str([_cell(x) for x in v])
    return str(v)


@pytest.fixture(scope="session")
def same(spark, duck):
    """Compare a query with its SQL: columns, and rows whatever their order."""

    def check(query, sql):
        df = query(spark, DATA)
        columns = sorted(df.columns)
        ours = sorted(tuple(_cell(r[c]) for c in columns) for r in df.collect())
        found = duck.sql(sql)
        assert sorted(found.columns) == columns
        at = [found.columns.index(c) for c in columns]
        theirs = sorted(tuple(_cell(r[i]) for i in at) for r in found.fetchall())
        assert ours == theirs

    return check

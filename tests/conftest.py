import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x)


@pytest.fixture(scope="session")
def spark():
    from shelfspark.session import build_session

    s = build_session("4", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    return DATA


def compare(spark, queries, oracles, names, data):
    """Each query against its SQL in DuckDB: same columns, same rows."""
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")

    def plain(v):
        if isinstance(v, float):
            return round(v, 5)
        if isinstance(v, (list, tuple)):
            return tuple(map(plain, v))
        return str(v) if hasattr(v, "isoformat") else v

    for name in names:
        df = queries[name](spark, data)
        got = con.execute(oracles[name])
        columns = [c[0] for c in got.description]
        assert sorted(columns) == sorted(df.columns), name
        want = sorted((tuple(plain(v) for v in r) for r in got.fetchall()), key=repr)
        have = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
        assert have == want, name

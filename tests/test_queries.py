"""Every core query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from compare import canon
from docweave.queries import core

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in os.listdir(DATA):
        c.execute(f"CREATE VIEW {p[:-8]} AS SELECT * FROM read_parquet('{DATA}/{p}')")
    return c


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, con, name):
    df = core.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    flat = lambda v: tuple(v) if hasattr(v, "asDict") else v
    got = sorted("|".join(canon(flat(v)) for v in r) for r in df.select(*cols).collect())
    if name in core.SQL:
        rows = con.execute(f"SELECT {', '.join(cols)} FROM ({core.SQL[name]})").fetchall()
        assert got == sorted("|".join(canon(tuple(v.values()) if isinstance(v, dict) else v) for v in r) for r in rows)


def test_entry_without_llm(monkeypatch):
    import importlib
    import sys

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "docweave.llm.queries", None)
    monkeypatch.setitem(sys.modules, "docweave.llm", None)
    entry = importlib.reload(__spark_entry__)
    assert entry.llm is None and set(entry.queries()) == set(core.QUERIES)
    monkeypatch.undo()
    importlib.reload(__spark_entry__)

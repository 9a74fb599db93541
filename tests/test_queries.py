"""Every query against its SQL in DuckDB, at the smallest scale."""

import math
from pathlib import Path

import duckdb
import pytest

from tidemark.plans import journeys  # noqa: F401  registers its queries
from tidemark.plans import queries as Q

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="driver tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query(spark, db, name):
    df = Q.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = db.execute(Q.ORACLES[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)


def test_entry_without_optional_parts(spark, monkeypatch):
    import sys

    saved = {k: v for k, v in sys.modules.items() if k.startswith(("tidemark.llm", "__spark_entry__", "corpus_pipeline"))}
    for k in saved:
        monkeypatch.delitem(sys.modules, k)

    class Missing:
        def find_spec(self, name, path=None, target=None):
            if name.startswith("tidemark.llm") or name == "corpus_pipeline":
                raise ModuleNotFoundError(f"No module named {name!r}", name="tidemark.llm" if name.startswith("tidemark") else name)

    monkeypatch.setattr(sys, "meta_path", [Missing(), *sys.meta_path])
    import __spark_entry__ as entry

    assert set(entry.queries()) == set(Q.QUERIES) and set(entry.oracle_sql()) == set(Q.ORACLES)
    sys.modules.pop("__spark_entry__")
    sys.modules.update(saved)

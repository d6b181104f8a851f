import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tilewright import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else 0.0 if v == 0 and isinstance(v, float) else v


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_equals_its_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    assert got
    if name in registry.ORACLES:
        found = con.sql(registry.ORACLES[name])
        assert sorted(found.columns) == columns
        assert got == sorted((tuple(plain(dict(zip(found.columns, r, strict=True))[c]) for c in columns) for r in found.fetchall()), key=str)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_training_data_operators():
    from pathlib import Path

    root = Path(entry.ROOT)
    for f in (root / "tilewright").rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "llm" not in f.read_text()

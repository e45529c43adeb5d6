"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from tessera.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return connection


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return "" if v is None else str(v)


def rows(found, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    got = df.collect()
    assert df.columns and len(set(df.columns)) == len(df.columns)
    if name in registry.SQL:
        want = db.execute(registry.SQL[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(df.columns)
        assert rows(got, df.columns) == rows(want.fetchall(), names)


def test_zip_list_of_odd_texts(spark, tmp_path):
    """Null, empty and multi-byte texts, and one that is far longer when inflated."""
    texts = [(0, None), (1, ""), (2, "a\x00\n"), (3, "\u00e9\u4e16\U0001f600"), (-4, "x" * 300_000), (2**62, "z")]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["zip_list"](spark, str(tmp_path))
    connection = duckdb.connect()
    connection.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = connection.execute(registry.SQL["zip_list"])
    names = [d[0] for d in want.description]
    assert got.columns == names and dict(got.dtypes) == {"doc_id": "bigint", "name": "string", "size": "bigint", "method": "int", "sha256": "string", "ok": "boolean"}
    assert rows(got.collect(), names) == rows(want.fetchall(), names)

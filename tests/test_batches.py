"""Kernels hold one row's files at a time, and images are put together without a Python call or a join for each."""

import duckdb
import pyarrow as pa
import pytest

from tessera import batches, ship
from tessera.plans import registry

from .test_queries import rows


def test_batches_are_bounded_by_bytes(spark):
    made = []

    def files():
        for k in range(64):
            made.append(k)
            yield str(k), bytes(1 << 20)

    schema = batches.arrow("path string, content binary")
    first = next(batches.given(files(), schema))
    assert first.num_rows == len(made) == 4 and batches.BYTES == 4 << 20
    whole = pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(1000)])], names=["a"])
    assert [r[0] for r in batches.taken([whole])] == [str(k) for k in range(1000)]
    assert sum(b.num_rows for b in batches.given(((str(k), b"") for k in range(20_000)), schema)) == 20_000


def test_sessions_bound_their_batches(spark):
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == 32 << 20
    own = spark.newSession()
    own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 1 << 20)
    assert int(ship(own).conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == 1 << 20


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Null, empty and multi-byte texts, whole blocks, and one beyond a chunk."""
    at = str(tmp_path_factory.mktemp("odd"))
    texts = [None, "", "a\n", "é世\U0001f600", "x" * 4096, "y" * 4097, "z" * 1_100_000, "w" * 8192]
    made = [(k, t, "de", "web", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{at}/documents.parquet")
    return at


def check(spark, odd, name, groups=0, kernels=None):
    """The query says what its SQL says; its plan calls Python for no group, and has so many kernels at most."""
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{odd}/documents.parquet/*.parquet'")
    want = db.execute(registry.SQL[name])
    found = registry.QUERIES[name](spark, odd)
    assert rows(found.collect(), found.columns) == rows(want.fetchall(), [d[0] for d in want.description])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsIn") == groups
    assert kernels is None or plan.count("MapInArrow") <= kernels
    return plan


def test_lp_extract(spark, odd):
    """A null text leaves the other partition what it is."""
    assert "InMemoryRelation" not in check(spark, odd, "lp_extract")


def test_erofs_files(spark, odd):
    """Images are walked once."""
    assert "InMemoryRelation" in check(spark, odd, "erofs_files")


def test_block_merge(spark, odd):
    """Archives are packed and unpacked once, and contents are dealt with their commands, without joins before."""
    plan = check(spark, odd, "block_merge")
    assert "InMemoryRelation" in plan
    assert plan.count("Join") <= 6


def test_zip_list(spark, odd):
    check(spark, odd, "zip_list")


def test_bsdiff_apply(spark, odd):
    check(spark, odd, "bsdiff_apply", kernels=1)


def test_update_merge(spark, odd):
    """Operations are read out once; images are put together in one call for many."""
    assert "InMemoryRelation" in check(spark, odd, "update_merge")


def test_payload_check(spark, odd):
    check(spark, odd, "payload_check")


def test_partition_patch(spark, odd):
    """Archives are packed and unpacked once."""
    assert "InMemoryRelation" in check(spark, odd, "partition_patch")


def test_payload_apply(spark, odd):
    check(spark, odd, "payload_apply")


def test_direct_files(spark, odd):
    check(spark, odd, "direct_files")


def test_tar_list(spark, odd):
    """Entries are cut out where they are found: archives are packed once and not joined."""
    assert "Join" not in check(spark, odd, "tar_list", kernels=2)


def test_block_apply(spark, odd):
    """Contents are not joined."""
    assert "Join" not in check(spark, odd, "block_apply")


def test_sparse_expand(spark, odd):
    """Contents are not joined."""
    assert "Join" not in check(spark, odd, "sparse_expand")


def test_fs_sniff(spark, odd):
    check(spark, odd, "fs_sniff", kernels=1)

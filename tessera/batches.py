"""Rows to and from Python kernels, a bounded part at a time.

A kernel is a function from an iterator of row tuples to one of row tuples, so that what a worker holds is one row's files,
however many rows a batch has, and not a batch of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame

#: How many rows become Python values at once; bytes and rows of a batch that goes out; bytes of input files for a task.
STEP, BYTES, ROWS, SHARE = 16, 4 << 20, 8192, 8 << 20

Kernel = Callable[[Iterator[tuple]], Iterable[tuple]]


def taken(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of batches."""
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, STEP).columns), strict=True)


def given(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """rows in batches of about BYTES bytes of texts and binary values, and ROWS rows at most."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes | bytearray | str))
        if size >= BYTES or len(held) >= ROWS:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def mapped(rows: DataFrame, kernel: Kernel, schema: str) -> DataFrame:
    """What the kernel makes of rows."""
    kind = arrow(schema)
    return rows.mapInArrow(lambda batches: given(kernel(taken(batches)), kind), schema)


def grouped(rows: DataFrame, keys: list[str], order: list[str], kernel: Callable[[tuple, Iterator[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """What kernel(key, rows of that key) makes of each group: the keys come first in a row, and rows in order.

    Groups follow one another in one call of a worker, so that a group costs no call of its own.
    """
    kind, n = arrow(schema), len(keys)

    def run(batches):
        groups = groupby(taken(batches), key=lambda r: r[:n])
        yield from given((out for key, own in groups for out in kernel(key, own)), kind)

    slim = rows.select(*keys, *[c for c in rows.columns if c not in keys])
    return dealt(slim, keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows dealt by keys to as many tasks as the input's size asks for."""
    return rows.repartition(tasks(rows), *keys)


def tasks(*tables: DataFrame) -> int:
    """How many tasks should share what is made from tables: spark.sql.shuffle.partitions, or more, so that one has about
    SHARE bytes of their input files."""
    spark, size = tables[0].sparkSession, 0
    for table in tables:
        leaves = table._jdf.queryExecution().optimizedPlan().collectLeaves()
        own = {}
        for leaf in (leaves.apply(i) for i in range(leaves.size())):
            own[leaf.canonicalized().toString()] = int(str(leaf.stats().sizeInBytes()))
        size = max(size, sum(x for x in own.values() if x < 1 << 60))  # unknown sizes are the largest number
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARE))

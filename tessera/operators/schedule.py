"""Write-after-read order of operations that change an image in place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import batches
from ..errors import FormatError
from . import ranges


def conflicts(sources: DataFrame, targets: DataFrame, key: list[str], width: int = 1024) -> DataFrame:
    """(key, reader, writer): operations of which one reads what another writes. sources and targets: (key, op, s, e)."""
    readers, writers = sources.withColumnRenamed("op", "reader"), targets.withColumnRenamed("op", "writer")
    n = batches.tasks(sources, targets)
    pairs = ranges.overlap_pairs(readers, writers, key, "s", "e", ("reader", "writer"), width, n)
    return pairs.filter("reader <> writer").repartition(n, *key, "reader", "writer").distinct()


def order(operations: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, position, op, save, until): an order in which every reader comes before those that overwrite what it reads.

    operations: (key, op, cost), edges: (key, reader, writer). It is made in rounds: all operations that wait for no reader run,
    by number. If all wait for one another, the cheapest of the readers that hold others up saves its source (save is
    true), of equal ones that with the smallest number; it holds nobody up then, and runs later. until: on the first row of
    an operation, where the first of those runs that overwrite what it reads.
    """
    both = operations.select(key, F.col("op").alias("a"), F.lit(None).cast("long").alias("b"), "cost")
    both = both.unionByName(edges.select(key, F.col("reader").alias("a"), F.col("writer").alias("b"), F.lit(None).cast(operations.schema["cost"].dataType).alias("cost")))
    kind = operations.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, position long, op long, save boolean, until long"
    form = batches.arrow(schema)

    def run(parts):
        for table in _whole(parts):
            yield from _ordered(table, form).to_batches()

    return batches.dealt(both, [key]).sortWithinPartitions(key).mapInArrow(run, schema)


#: How many rows of operations and edges are ordered at once, or those of one key.
MANY = 1 << 17


def _whole(parts) -> Iterator[pa.Table]:
    """Batches that are sorted by their first column put together, so that no key's rows are in two tables."""
    held, n = [], 0
    for batch in parts:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < MANY:
            continue
        at = int(_starts(batch.column(0))[-1])  # the last key's first row, if it began in this batch
        if not at and len(held) > 1 and held[-2].column(0)[-1] == batch.column(0)[0]:
            continue
        if at or len(held) > 1:
            held[-1] = batch.slice(0, at)
            yield pa.Table.from_batches(held)
            held, n = [batch.slice(at)], batch.num_rows - at
    if held:
        yield pa.Table.from_batches(held)


def _starts(column: pa.Array) -> np.ndarray:
    """Where a sorted column's values begin; nulls are one value."""
    if not len(column):
        return np.zeros(0, np.int64)
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
    return np.concatenate([[0], np.flatnonzero(~np.asarray(same)) + 1])


def _ordered(table: pa.Table, form: pa.Schema) -> pa.Table:
    """order() of the keys of one table, all at once."""
    names = table.column(0).combine_chunks()
    starts = _starts(names)
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(names))))
    own = np.asarray(pc.is_null(table.column("b")))
    a, b = np.asarray(table.column("a")), np.asarray(pc.fill_null(table.column("b"), 0))
    op, of, cost = a[own], group[own], np.asarray(table.column("cost").filter(pa.array(own)))
    by = np.lexsort((op, of))
    op, of, cost = op[by], of[by], cost[by]
    reader, writer = _places(op, of, a[~own], group[~own]), _places(op, of, b[~own], group[~own])
    pair = np.unique(reader * len(op) + writer) if len(reader) else reader
    reader, writer = pair // max(1, len(op)), pair % max(1, len(op))
    at, saved = _rounds(reader, writer, cost, of)
    key = of[at]
    position = np.arange(len(at)) - np.searchsorted(key, np.arange(len(starts)))[key]
    ran = np.empty(len(op), np.int64)
    ran[at[~saved]] = position[~saved]
    never = np.iinfo(np.int64).max
    until = np.full(len(op), never)
    np.minimum.at(until, reader, ran[writer])
    had = np.zeros(len(op), bool)
    had[at[saved]] = True
    told = np.where(saved | ~had[at], until[at], never)
    return pa.Table.from_arrays([names.take(pa.array(starts[key])).cast(form.types[0]), pa.array(position, pa.int64()), pa.array(op[at], pa.int64()), pa.array(saved), pa.array(told, pa.int64(), mask=told == never)], schema=form)


def _places(op: np.ndarray, of: np.ndarray, wanted: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Where operations (of, op), which are sorted, have the wanted ones, which must be there."""
    if not len(wanted):
        return np.zeros(0, np.int64)
    values = np.unique(op)
    code = np.searchsorted(values, wanted)
    code[code == len(values)] = 0
    have = of * len(values) + np.searchsorted(values, op)
    at = np.searchsorted(have, group * len(values) + code)
    at[at == len(have)] = 0
    if not len(have) or ((op[at] != wanted) | (of[at] != group)).any():
        raise FormatError("an operation that others wait for is missing")
    return at


def _rounds(reader: np.ndarray, writer: np.ndarray, cost: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Operations of all groups (`of`, ascending) in order, and which of these places are saves. A group's rounds don't depend
    on others', so that a round is one of all groups that still have one. Edges are ordered by reader once, so that a round
    takes the edges of those that ran, or saved, as slices."""
    n = len(cost)
    groups = int(of[-1]) + 1 if n else 0
    by = np.argsort(reader, kind="stable")
    writer, edge = writer[by], np.searchsorted(reader[by], np.arange(n + 1))
    waits, holds = np.bincount(writer, minlength=n), np.diff(edge) > 0
    dear = np.lexsort((np.arange(n), cost, of))  # a group's own ones lie where its operations do
    edges = np.searchsorted(of, np.arange(groups + 1))
    next_, end = edges[:-1].copy(), edges[1:]
    left = end - next_
    order, saved, turn = [np.zeros(0, np.int64)], [np.zeros(0, bool)], [np.zeros(0, np.int64)]
    now, active, round_ = np.flatnonzero(waits == 0), np.flatnonzero(left > 0), 0
    while len(active):
        np.subtract.at(left, of[now], 1)
        stuck = _without(active, of[now])
        save = _savers(stuck, next_, end, dear, holds)
        did = np.concatenate([now, save])
        order.append(did)
        saved.append(np.arange(len(did)) >= len(now))
        turn.append(np.full(len(did), round_))
        let = did[holds[did]]
        holds[let] = False
        count = edge[let + 1] - edge[let]
        held = writer[np.repeat(edge[let] - np.cumsum(count) + count, count) + np.arange(count.sum())]
        np.subtract.at(waits, held, 1)
        now = np.unique(held[waits[held] == 0])
        active, round_ = active[left[active] > 0], round_ + 1
    at, saves, turns = np.concatenate(order), np.concatenate(saved), np.concatenate(turn)
    by = np.lexsort((at, turns, of[at]))
    return at[by], saves[by]


def _without(active: np.ndarray, busy: np.ndarray) -> np.ndarray:
    """Those of the active groups (ascending) that are not busy; busy ones are active."""
    if not len(busy):
        return active
    keep = np.ones(len(active), bool)
    keep[np.searchsorted(active, busy)] = False
    return active[keep]


def _savers(stuck: np.ndarray, next_: np.ndarray, end: np.ndarray, dear: np.ndarray, holds: np.ndarray) -> np.ndarray:
    """The cheapest operation of each stuck group that holds others up."""
    todo = stuck
    while len(todo):
        if (next_[todo] >= end[todo]).any():
            raise FormatError("operations can't be ordered")
        todo = todo[~holds[dear[next_[todo]]]]
        next_[todo] += 1
    return dear[next_[stuck]]

"""Approximate nearest neighbours: a graph by NN-descent, queries by greedy search on it.

Equal vectors are one node, with the few smallest ids that a query can return; a vector that a third of all rows have
is thus one node. The graph starts from neighbours within small random groups and groups by random hyperplanes. A round
of NN-descent is a join: every node's neighbours, and as many of those that have it as a neighbour, meet at the node
with their vectors, and each learns which of the others are nearer than its farthest neighbour. Rounds end when few
neighbours change.

A query starts from its own node, where its vector has one, and from the nearest of a sample of nodes (ENTRIES at least,
and four times the root of their number). In each round it expands its nearest nodes that aren't expanded yet: a join
with the graph brings their neighbours, and as many of those that have them as neighbours. It keeps the BEAM nearest nodes and ends when
these are all expanded. The graph, the beam and the results, which are ranked from the whole beam, all go by the
cosine of the original vectors in double precision, so that near copies are told apart.

All rows are indexed; the sample is for entry points only. Vectors that are null, zero, of another length than most, or
hold null or non-finite components take no part, nor do null ids. Components are read as floats: doubles are rounded, and
those beyond a float's range take no part. Rows alike in id and vector count once; an id with
several vectors is found, and asks, with each. A query's own id is no candidate. Extra columns are dropped; an empty
table gives an empty table; with fewer candidates than asked for, all are returned.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, cut_bucketed, drop, load, shards_of

NEIGHBOURS, ROUNDS, BEAM, EXPAND, ENTRIES, GROUP = 32, 8, 256, 32, 512, 64


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of rows that take part."""
    v = F.col(f"`{vector_col}`")
    some = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.cast("array<float>").alias("vector")).dropna()
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    some = some.filter(F.forall("vector", fine) & F.exists("vector", lambda x: x != 0))
    common = some.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return some.filter(F.size("vector") == (common["d"] if common else 0))


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    scale = np.abs(rows).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    rows = rows / scale
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _units(raw: list[bytes]) -> np.ndarray:
    if not raw:
        return np.zeros((0, 1))
    return unit(np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), -1))


def nodes_of(some: DataFrame, ids: int) -> DataFrame:
    """(node, ids, vector): distinct vectors with their `ids` smallest ids; node is the smallest."""

    def distinct(batches):
        for batch in batches:
            flat = batch.column("vector").flatten()
            rows = np.asarray(flat.cast(pa.float32())).reshape(batch.num_rows, -1) + np.float32(0)
            have: dict[bytes, list[int]] = {}
            for key, i in sorted(zip((r.tobytes() for r in rows), batch.column("id").to_pylist(), strict=True)):
                own = have.setdefault(key, [])
                if len(own) < ids and (not own or own[-1] != i):
                    own.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(have.keys(), pa.binary()), pa.array(have.values(), pa.list_(pa.int64()))], names=["vector", "ids"])

    few = some.mapInArrow(distinct, "vector binary, ids array<long>").select("vector", F.explode("ids").alias("id"))
    # a rank with a bound is taken in each task before the shuffle too, so that one hot vector is few rows
    few = few.withColumn("r", F.dense_rank().over(Window.partitionBy("vector").orderBy("id"))).filter(F.col("r") <= ids)
    few = few.groupBy("vector").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    return few.select(F.col("ids")[0].alias("node"), "ids", "vector")


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of each node's (node, nbr, score)."""
    once = edges.groupBy("node", "nbr").agg(F.max("score").alias("score"))
    rank = Window.partitionBy("node").orderBy(F.desc("score"), "nbr")
    return once.withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= k).drop("r")


def _both_ways(edges: DataFrame, k: int) -> DataFrame:
    """(node, nbr): edges, and the other way round about k of each node's, by hash, so that a hub's list stays bounded."""
    indegree = edges.groupBy("nbr").agg(F.count("*").alias("n"))
    back = edges.join(indegree, "nbr").filter(F.pmod(F.xxhash64("node", "nbr"), F.lit(1_000_000)) < 1_000_000 * k / F.col("n"))
    return edges.select("node", "nbr").union(back.select(F.col("nbr").alias("node"), F.col("node").alias("nbr"))).distinct()


def _near_in_groups(rows: pa.Table, key: str, k: int) -> pa.Table:
    """For each member of a group (column key; with node, vector and the score to beat), its k nearest others there."""
    group = np.asarray(rows.column(key))
    order = np.argsort(group, kind="stable")
    node, floor = np.asarray(rows.column("node"))[order], np.asarray(rows.column("floor"))[order]
    x = _units(rows.column("vector").to_pylist())[order]
    group = group[order]
    cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    a, b, s = [], [], []
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        if hi - lo < 2:
            continue
        score = x[lo:hi] @ x[lo:hi].T
        np.fill_diagonal(score, -2)
        score[score <= floor[lo:hi, None]] = -2
        if hi - lo > k:
            low = np.partition(score, hi - lo - k, axis=1)[:, hi - lo - k]
            score[score < low[:, None]] = -2
        i, j = np.nonzero(score > -2)
        a.append(node[lo + i])
        b.append(node[lo + j])
        s.append(score[i, j])
    cat = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0), kind)
    return pa.table({"node": cat(a, pa.int64()), "nbr": cat(b, pa.int64()), "score": cat(s, pa.float64())})


_EDGE = "node long, nbr long, score double"


def build(nodes: DataFrame, *, k: int = NEIGHBOURS, rounds: int = ROUNDS, seed: int = 11, done: float = 0.01) -> DataFrame:
    """(node, nbr, score): each node's k nearest as far as NN-descent finds them. nodes: a written table."""
    spark = nodes.sparkSession
    n = nodes.count()
    bins = max(4, 4 * shards_of(spark))
    slim = nodes.select("node", "vector")
    groups = max(1, math.ceil(n / GROUP))
    bits = max(1, groups.bit_length())

    def near(rows: pa.Table) -> pa.Table:
        return _near_in_groups(rows, "group", k // 2)

    def signs(batches):
        planes = None
        for batch in batches:
            x = _units(batch.column("vector").to_pylist())
            if planes is None or planes.shape[1] != x.shape[1] * 2:
                planes = np.random.default_rng(seed).normal(size=(2 * bits, x.shape[1]))
            for t in range(2):
                code = ((x @ planes[t * bits : (t + 1) * bits].T) > 0) @ (1 << np.arange(bits)) if batch.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code.astype(np.int64) * 2 + t, pa.int64())], names=["node", "vector", "code"])

    coded = slim.mapInArrow(signs, "node long, vector binary, code long")
    count = coded.groupBy("code").agg(F.count("*").alias("n"))
    coded = coded.join(count, "code").withColumn("group", F.xxhash64("code", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / GROUP).cast("long"))))
    random = slim.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(1))))
    random = random.withColumn("group", F.xxhash64("t", F.pmod(F.xxhash64("node", "t", F.lit(seed)), F.lit(groups))))
    start = coded.select("group", "node", "vector").unionByName(random.select("group", "node", "vector")).withColumn("floor", F.lit(-1.5).cast("double"))
    start = start.withColumn("bin", F.pmod(F.xxhash64("group"), F.lit(bins)))
    edges = cut(_best(start.groupBy("bin").applyInArrow(near, _EDGE), k), "ann-graph")

    def meet(rows: pa.Table) -> pa.Table:
        return _near_in_groups(rows, "centre", 8)

    for _ in range(rounds):
        both = _both_ways(edges, k).select(F.col("node").alias("centre"), F.col("nbr").alias("node"))
        floor = edges.groupBy("node").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(-1.5)).cast("double").alias("floor"))
        members = both.join(slim.join(floor, "node"), "node").withColumn("bin", F.pmod(F.xxhash64("centre"), F.lit(bins)))
        found = members.groupBy("bin").applyInArrow(meet, _EDGE)
        new = cut(_best(edges.union(found), k), "ann-graph")
        changed = new.join(edges, ["node", "nbr"], "left_anti").count()
        drop(edges)
        edges = new
        if changed <= done * k * n:
            break
    return edges


class Beam:
    """A query's nearest nodes so far: node, score, expanded."""

    def __init__(self, node, score, expanded):
        self.node, self.score, self.expanded = node, score, expanded

    def dump(self) -> bytes:
        return np.int64(len(self.node)).tobytes() + self.node.tobytes() + self.score.astype(np.float64).tobytes() + self.expanded.tobytes()

    @classmethod
    def parse(cls, raw: bytes):
        n = int(np.frombuffer(raw[:8], np.int64)[0])
        return cls(np.frombuffer(raw[8 : 8 + 8 * n], np.int64), np.frombuffer(raw[8 + 8 * n : 8 + 16 * n], np.float64), np.frombuffer(raw[8 + 16 * n :], bool))

    def merged(self, node, score, most: int):
        expanded = np.concatenate([self.expanded, np.zeros(len(node), bool)])
        node, at = np.unique(np.concatenate([self.node, node]), return_index=True)
        score, expanded = np.concatenate([self.score, score])[at], expanded[at]
        top = np.lexsort((node, -score))[:most]
        return Beam(node[top], score[top], expanded[top])

    def next(self, most: int) -> np.ndarray:
        return np.flatnonzero(~self.expanded)[:most]


def search(nodes: DataFrame, graph: DataFrame, queries: DataFrame, *, top: int = 5, beam: int = BEAM, expand: int = EXPAND, entries: int | None = None) -> DataFrame:
    """(query, rank, id, score): the `top` nearest ids of each of queries (id, vector). Goes on until no query has a node left to
    expand; that ends, as a node that has left a beam is no better than its last and never returns."""
    spark = nodes.sparkSession
    bins = shards_of(spark)
    entries = entries or max(ENTRIES, 4 * math.isqrt(nodes.count()))
    listed = _both_ways(graph, NEIGHBOURS).join(nodes.select(F.col("node").alias("nbr"), "vector"), "nbr").groupBy("node")
    listed = listed.agg(F.collect_list(F.struct("nbr", "vector")).alias("nbrs"))  # about twice as many as a node has neighbours
    listed = cut_bucketed(listed, "node", bins, "ann_lists")
    sample = nodes.select("node", "vector").orderBy(F.xxhash64("node"), "node").limit(entries).collect()  # grows with the root of the nodes
    entry, entry_raw = np.array([r["node"] for r in sample], np.int64), [bytes(r["vector"]) for r in sample]

    def bare(batches):
        for batch in batches:
            rows = np.asarray(batch.column("vector").flatten().cast(pa.float32())).reshape(batch.num_rows, -1) if batch.num_rows else ()
            raw = [(r + np.float32(0)).tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(raw, pa.binary())], names=["id", "vector"])

    def begin(batches):
        base = _units(entry_raw)
        for batch in batches:
            if not batch.num_rows or not len(entry):
                continue
            raw = batch.column("vector").to_pylist()
            state = []
            for s, own in zip(_units(raw) @ base.T, batch.column("own").to_pylist(), strict=True):
                t = np.lexsort((entry, -s))[:expand]
                first = Beam(entry[t], s[t], np.zeros(len(t), bool))
                if own is not None:
                    first = first.merged(np.array([own], np.int64), np.ones(1), expand)
                state.append(first.dump())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(state, pa.binary())], names=["query", "id", "vector", "state"])

    asked = queries.select("id", "vector").mapInArrow(bare, "id long, vector binary")
    asked = asked.withColumn("query", F.xxhash64("id", "vector")).dropDuplicates(["query"])
    asked = asked.join(nodes.select("vector", F.col("node").alias("own")), "vector", "left").select("query", "id", "vector", "own")
    asked = asked.mapInArrow(begin, "query long, id long, vector binary, state binary")
    state = cut(asked.select("query", "id", "vector", "state"), "ann-state")

    def frontier(batches):
        for batch in batches:
            query, node = [], []
            for q, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                b = Beam.parse(raw)
                at = b.next(expand)
                query += [q] * len(at)
                node += b.node[at].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(node, pa.int64())], names=["query", "node"])

    def advance(rows: pa.Table) -> pa.Table:
        out = {"query": [], "id": [], "vector": [], "state": []}
        states, got = {}, {}
        for r in rows.to_pylist():
            if r["state"] is not None:
                states[r["query"]] = r
            elif r["nbrs"] is not None:
                got.setdefault(r["query"], []).extend(r["nbrs"])
        for q, r in states.items():
            b = Beam.parse(r["state"])
            done = b.expanded.copy()
            done[b.next(expand)] = True
            b.expanded = done
            new = {x["nbr"]: x["vector"] for x in got.get(q, ())}
            for x in b.node.tolist():
                new.pop(x, None)
            if new:
                b = b.merged(np.fromiter(new, np.int64, len(new)), _units(list(new.values())) @ _units([r["vector"]])[0], beam)
            for k, x in (("query", q), ("id", r["id"]), ("vector", r["vector"]), ("state", b.dump())):
                out[k].append(x)
        return pa.table({k: pa.array(v, pa.binary() if k in ("vector", "state") else pa.int64()) for k, v in out.items()})

    schema = "query long, id long, vector binary, state binary"
    while True:
        open_ = cut(state.select("query", "state").mapInArrow(frontier, "query long, node long"), "ann-frontier")
        if open_.isEmpty():
            drop(open_)
            break
        got = open_.join(listed, "node").select("query", F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("vector"), F.lit(None).cast("binary").alias("state"), "nbrs")
        kept = state.withColumn("nbrs", F.lit(None).cast("array<struct<nbr:bigint,vector:binary>>"))
        both = kept.unionByName(got).withColumn("bin", F.pmod(F.xxhash64("query"), F.lit(bins)))
        new = cut(both.groupBy("bin").applyInArrow(advance, schema), "ann-state")
        drop(open_, state)
        state = new

    drop(listed)

    def candidates(batches):
        for batch in batches:
            query, node = [], []
            for q, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                near = Beam.parse(raw).node.tolist()
                query += [q] * len(near)
                node += near
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(node, pa.int64())], names=["query", "node"])

    last = state.select("query", "state").mapInArrow(candidates, "query long, node long")
    last = last.join(nodes.select("node", "ids", F.col("vector").alias("other")), "node").join(state.select("query", "id", "vector"), "query")

    def exact(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.float32).reshape(batch.num_rows, -1).astype(np.float64) for c in ("vector", "other"))
            score = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
            odd = ~np.isfinite(score)
            if odd.any():  # squares out of range
                score[odd] = (unit(a[odd]) * unit(b[odd])).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("own"), batch.column("ids"), pa.array(score)], names=["query", "own", "ids", "score"])

    scored = last.select("query", F.col("id").alias("own"), "ids", "vector", "other").mapInArrow(exact, "query long, own long, ids array<long>, score double")
    each = scored.select("query", "own", "score", F.explode("ids").alias("id")).filter("id <> own")
    each = each.groupBy("query", "own", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return each.withColumn("rank", rank).filter(F.col("rank") <= top).select(F.col("own").alias("query"), "rank", "id", "score")


def nearest(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, top: int = 5, **options) -> DataFrame:
    """(query_id, rank, id_col, score) for the rows whose id is divisible by `every`."""
    some = valid(vectors, id_col, vector_col)
    nodes = cut(nodes_of(some, top + 1), "ann-nodes")
    graph = build(nodes)
    out = search(nodes, graph, some.filter(F.col("id") % every == 0), top=top, **options)
    return out.select(F.col("query").alias("query_id"), "rank", F.col("id").alias(id_col), "score")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(load(spark, sf_dir, "embeddings"))


QUERIES = {"op6_ann": op6_ann}
SQL: dict[str, str] = {}

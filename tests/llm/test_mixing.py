import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing as M
from tessera.llm.common import load


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets_are_shared_by_weight_and_stop():
    assert M.targets([100, 100, 100]) == pytest.approx([200, 250 / 3, 500 / 3])
    assert M.targets([]) == []
    assert M.targets([0, 0]) == [0, 0]
    got = M.targets([10, 1000, 10, 500])
    assert sum(got) == pytest.approx(1.5 * 1520) and all(t <= 2 * s + 1e-9 for t, s in zip(got, [10, 1000, 10, 500], strict=True))
    assert got[0] == 20 and got[2] == 20


def test_tree_leaves_add_up_to_the_quotas():
    quotas = np.array([1000, 0, 37, 5, 480])
    leaves = M.split_quotas(quotas, 13)
    assert (leaves.sum(axis=0) == quotas).all() and (leaves >= 0).all()
    assert set(leaves.sum(axis=1)) <= {quotas.sum() // 13, quotas.sum() // 13 + 1}
    assert (M.split_quotas(quotas, 13) == leaves).all()
    assert M.split_quotas(np.zeros(0, np.int64), 4).shape == (4, 0)


def check(rows, got):
    sizes = defaultdict(int)
    for _, s, t in rows:
        sizes[s] += size(t)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, M.targets([sizes[s] for s in order]), strict=True))
    assert len(got) == len(rows)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.size == size(r.text) and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.times * r.size and len(r.draws) == r.times
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in order:
        assert abs(taken[s] - want[s]) <= largest[s], s
    return want


def test_mix_meets_targets(spark):
    rows = [(i, f"s{i % 5}" if i % 3 else "s0", "w " * (i * 7 % 40)) for i in range(600)]
    rows += [(None, None, "a b c")] * 3 + [(None, "s1", None), (1, "s1", "x " * 7), (1, "s1", "x " * 7), (700, "é", ""), (701, "long", "w " * 9000)]
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, source string, text string, size int, at int, of string")
    got = M.mix(docs, shards=7, blocks=16).collect()
    check(rows, got)
    again = M.mix(docs.repartition(5), shards=7, blocks=16).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r.size, r.times, str(r.draws))
    assert sorted(map(key, got)) == sorted(map(key, again))
    mixed = M.drawn(M.mix(docs, shards=7, blocks=16)).collect()
    assert len(mixed) == sum(r.times for r in got) and {r.shard for r in mixed} <= set(range(7))
    assert M.mix(docs.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    text = {r.doc_id: r for r in load(spark, sf, "documents").collect()}
    got = M.op5_mixing(spark, sf).collect()
    assert Counter(r.doc_id for r in got) == Counter(text.keys())
    by = defaultdict(list)
    for r in got:
        assert r.size == size(text[r.doc_id].text) and r.taken <= 2 * r.size
        by[text[r.doc_id].source].append(r)
    for rows in by.values():
        assert sum(r.size for r in rows) == rows[0].source_size
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= max(r.size for r in rows)


def points(docs):
    text = F.xxhash64(F.lit(M.SEED), "doc_id", "source", "text")
    return docs.withColumn("point", F.shiftrightunsigned(text, 1)).collect()


def brute(rows, *, shards, blocks):
    """How often each of rows (doc_id, source, text, point) is taken, and to which shards it goes, without Spark."""
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += size(r.text)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    wanted = M.targets([sizes[s] for s in order])
    of = {s: max(1, round(blocks * sizes[s] / sum(wanted))) for s in order}
    times, quotas = {}, []
    for s, t in zip(order, wanted, strict=True):
        passes = int(t // sizes[s]) if sizes[s] else 0
        room, last = t - passes * sizes[s] if sizes[s] else 0, None
        for r in sorted((r for r in rows if r.source == s), key=lambda r: r.point):
            times[r] = passes
            if room > 0 and last is None:
                if size(r.text) > room:
                    last = r.point
                    times[r] += room >= size(r.text) / 2
                else:
                    times[r] += 1
                    room -= size(r.text)
        quotas.append(passes * of[s] + ((last >> 31) * of[s] // 2**32 + 1 if last is not None else 0))
    ends = M.split_quotas(np.array(quotas), shards).cumsum(axis=0)
    where = {}
    for r, n in times.items():
        block, own = (r.point >> 31) * of[r.source] // 2**32, ends[:, order.index(r.source)]
        where[r] = [int((own <= k * of[r.source] + block).sum()) for k in range(n)]
    return times, where


def test_draws_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, f"s{i % 7}" if i % 3 else None, "w " * (i * 13 % 50 + 1)) for i in range(900)], "doc_id long, source string, text string")
    times, where = brute(points(docs), shards=5, blocks=64)
    got = M.mix(docs, shards=5, blocks=64).collect()
    assert {r.doc_id: r.times for r in got} == {r.doc_id: n for r, n in times.items()}
    assert {r.doc_id: [d.shard for d in r.draws] for r in got} == {r.doc_id: x for r, x in where.items()}
    assert len({tuple(x) for x in where.values()}) > 5


def test_the_tree_decides(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"s{i % 4}", "w " * (i % 9 + 1)) for i in range(300)], "doc_id long, source string, text string")
    split = M.split_quotas
    shards = lambda: {r.doc_id: [d.shard for d in r.draws] for r in M.mix(docs, shards=6, blocks=64).collect()}
    first = shards()
    monkeypatch.setattr(M, "split_quotas", lambda *a: split(*a)[::-1])
    other = shards()
    assert first != other and {i: len(x) for i, x in first.items()} == {i: len(x) for i, x in other.items()}
    monkeypatch.setattr(M, "split_quotas", lambda *a: split(*a) * (np.arange(6) < 3)[:, None])
    assert 0 < sum(map(len, shards().values())) < sum(map(len, first.values()))
    monkeypatch.setattr(M, "split_quotas", lambda *a: split(*a) * 0)
    assert not any(shards().values())


def test_rows_alike_and_many_sources(spark, monkeypatch):
    rows = [(None, "s", "a b c d")] * 40 + [(None, "t", "a b")] * 40 + [(1, "u", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for most in (M.BROADCAST, 0):
        monkeypatch.setattr(M, "BROADCAST", most)
        got = M.mix(docs, shards=3, blocks=8).collect()
        taken = Counter()
        for r in got:
            taken[r.source] += r.taken
        assert all(abs(taken[r.source] - r.target) <= r.size for r in got)


def test_layout_keeps_parts_together(spark, monkeypatch):
    monkeypatch.setattr(M, "PART_WORDS", 100)
    docs = spark.createDataFrame([(i, f"s{i % 4}", "w " * (i % 9 + 1)) for i in range(600)], "doc_id long, source string, text string")
    mixed = M.mix(docs, shards=6, blocks=64)
    out = M.laid_out(mixed).withColumn("task", F.spark_partition_id()).collect()
    assert Counter((r.doc_id, r.shard) for r in out) == Counter((r.doc_id, d.shard) for r in mixed.collect() for d in r.draws)
    tasks = defaultdict(set)
    for r in out:
        tasks[r.shard, r.part].add(r.task)
    assert all(len(t) == 1 for t in tasks.values()) and len(tasks) > 12
    for task in {r.task for r in out}:
        own = [(r.shard, r.part, (r.place % 2**64) >> 1) for r in out if r.task == task]
        assert own == sorted(own)

import math
import random

import numpy as np
import pytest

from tessera.llm import ann as A
from tessera.llm.common import load


def brute(rows, every, top):
    """Exact answers: {query id: [(score, id), ...]} over distinct (id, vector), best first."""
    fine = [(i, tuple(np.float32(v))) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    size = max({len(v) for _, v in fine}, key=lambda d: sum(len(v) == d for _, v in fine)) if fine else 0
    fine = sorted({r for r in fine if len(r[1]) == size})
    x = np.array([v for _, v in fine], float).reshape(len(fine), -1)
    out = {}
    for k, (i, _) in enumerate(fine):
        if i % every == 0:
            best = {}
            score = (x * x[k]).sum(axis=1) / np.sqrt((x * x).sum(axis=1)) / math.sqrt((x[k] * x[k]).sum())
            for (j, _), s in zip(fine, score, strict=True):
                if j != i:
                    best[j] = max(best.get(j, -2), s)
            out[i] = sorted(best.items(), key=lambda p: (-round(p[1], 9), p[0]))[:top]
    return out


def check(got, want, recall, top):
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert by.keys() == {q for q, w in want.items() if w}
    hits = total = 0
    for q, near in want.items():
        mine = sorted(by.get(q, ()), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, len(near) + 1))
        assert [(-round(r.score, 9), r.vec_id) for r in mine] == sorted((-round(r.score, 9), r.vec_id) for r in mine)
        hits += len({r.vec_id for r in mine} & {i for i, _ in near})
        total += len(near)
    assert hits >= recall * total


def test_odd_vectors_ties_and_copies(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(120)]
    rows += [(200 + i, [1.0, 2.0, 0.0, 0.0, 0.0, 1.0]) for i in range(30)]
    rows += [(300, None), (310, [0.0] * 6), (320, [None, 1.0, 0.0, 0.0, 0.0, 0.0]), (330, [float("nan")] + [1.0] * 5), (340, [float("inf")] * 6), (350, [1.0, 2.0]), (None, [1.0] * 6)]
    rows += [rows[0], rows[0], (360, [1e-30, 0.0, 0.0, 0.0, 0.0, 0.0])]
    vectors = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    got = A.nearest(vectors.repartition(3), every=10).collect()
    check(got, brute(rows, 10, 5), 1.0, 5)
    copies = sorted(r.vec_id for r in got if r.query_id == 210)
    assert copies == [200, 201, 202, 203, 204]


def test_few_and_no_candidates(spark):
    schema = "vec_id long, embedding array<float>"
    three = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])]
    got = A.nearest(spark.createDataFrame(three, schema)).collect()
    assert [(r.rank, r.vec_id) for r in sorted(got, key=lambda r: r.rank)] == [(1, 2), (2, 1)]
    assert A.nearest(spark.createDataFrame(three[:1], schema)).count() == 0
    assert A.nearest(spark.createDataFrame([], schema)).count() == 0


def test_tight_groups_larger_than_the_lists(spark):
    rng = np.random.default_rng(5)
    size = A.NEIGHBOURS + 18
    rows = [(i, (c + 0.05 * rng.normal(size=16)).tolist()) for i, c in enumerate(np.repeat(rng.normal(size=(30, 16)), size, axis=0))]
    got = A.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), every=10, entries=8).collect()
    check(got, brute(rows, 10, 5), 0.95, 5)
    assert all(r.query_id // size == r.vec_id // size for r in got)


def test_near_copies_are_told_apart(spark):
    rng = np.random.default_rng(6)
    x = (rng.normal(size=64) + 0.002 * rng.normal(size=(1200, 64))).astype(np.float32)
    got = A.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), every=20).collect()
    u = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(axis=1, keepdims=True))
    score = u @ u.T
    np.fill_diagonal(score, -2)  # near ties are closer than check() rounds to
    want = {(q, int(i)) for q in range(0, 1200, 20) for i in np.argsort(-score[q])[:5]}
    assert len(got) == len(want) and len(want & {(r.query_id, r.vec_id) for r in got}) >= 0.95 * len(want)


@pytest.mark.parametrize("sf", ["sf0.1"])
def test_recall_of_the_query(spark, sf):
    at = f"/root/testdata/{sf}"
    rows = [(r.vec_id, r.embedding) for r in load(spark, at, "embeddings").collect()]
    check(A.op6_ann(spark, at).collect(), brute(rows, 50, 5), 0.95, 5)

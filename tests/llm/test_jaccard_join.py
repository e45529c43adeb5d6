import random
import re

import numpy as np
import pytest

from tessera.llm import jaccard_join as J
from tessera.llm.common import load


def brute(rows, gram=5, threshold=0.8):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets.append({tuple(w[i : i + gram]) for i in range(len(w) - gram + 1)} or ({tuple(w)} if w else set()))
    n = len(rows)
    parent, links = list(range(n)), [0] * n

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i + 1, n):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                parent[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((str(d), str(least.get(find(i))), links[i]) for i, (d, _) in enumerate(rows))


def result(df):
    return sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in df.collect())


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(8, 150))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows += [" ".join(copy)] * rng.choice([1, 1, 1, 3])
    rows += ["", None, " \n", "a b", "a  b", "a b c d e", "x " * 3000, "x " * 3001, "é日 " * 9]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    return [*zip(ids, rows, strict=True), (None, "a b"), (None, "only null"), (None, "only null"), (0, "a b")]


@pytest.mark.parametrize("block", [256, 4])
def test_equals_brute_force(spark, block):
    rows = corpus(block)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, node int")
    assert result(J.join(docs.repartition(3), block=block)) == brute(rows)
    if block == 4:
        assert J.join(docs.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in load(spark, sf, "documents").collect()]
    assert result(J.op2_jaccard_join(spark, sf)) == brute(rows)


def test_pruning_keeps_pairs_at_the_threshold():
    fewest = J.fewest_matches()
    rng = np.random.default_rng(2)
    for n, least in fewest.items():
        assert least < 0.8 * n
    kept = 0
    for _ in range(300):
        a, b = set(rng.integers(0, 1 << 60, 90).tolist()), set()
        common = set(list(a)[:80])
        b = common | set(rng.integers(0, 1 << 60, 10).tolist())  # 80 of 100
        grams = np.array([*a, *b], np.uint64)
        sig = J.signatures(J.mix(grams), np.array([0, len(a), len(a) + len(b)]))
        kept += len(J.survivors(sig, np.array([0]), np.array([1]), fewest))
        bands = (sig[0] == sig[1]).reshape(J.BANDS, J.ROWS).all(axis=1)
        assert bands.any()
    assert kept == 300


def test_minhash_estimates_similarity():
    rng = np.random.default_rng(3)
    grams = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    sig = J.signatures(np.concatenate([grams[:300], grams[100:]]), np.array([0, 300, 600]))
    assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.17


def test_each_pair_is_verified_once_and_only_if_it_is_left():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 6, (30, J.VALUES), dtype=np.uint16)
    sig = base[rng.integers(0, 30, 90)]
    sig[rng.random(sig.shape) < 0.2] = 9
    bands = sig.view(np.uint64)
    seen = []
    for band in range(J.BANDS):
        a, b = np.triu_indices(90, 1)
        same = bands[a, band] == bands[b, band]
        a, b = a[same], b[same]
        on = J.first_shared(sig, a, b, np.full(90, band))
        seen += list(zip(a[on].tolist(), b[on].tolist(), strict=True))
    a, b = np.triu_indices(90, 1)
    meet = (bands[a] == bands[b]).any(axis=1)
    assert len(seen) == len(set(seen)) and set(seen) == set(zip(a[meet].tolist(), b[meet].tolist(), strict=True))
    left = J.survivors(sig, a, b, J.fewest_matches())
    same = (sig[a] == sig[b]).sum(axis=1)
    assert set(np.flatnonzero(same >= 90)) <= set(left) and len(left) < meet.sum()


def test_similar_equals_sets():
    rng = np.random.default_rng(6)
    sets = [set(rng.choice(40, rng.integers(1, 30), replace=False).tolist()) for _ in range(40)]
    sets += [set(list(s)[:-1]) or s for s in sets]
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    grams = np.concatenate([sorted(s) for s in sets])
    a, b = np.triu_indices(len(sets), 1)
    order = rng.permutation(len(a))
    a, b = a[order], b[order]
    for most in (7, 1 << 20):
        got = J.similar(grams, at, a, b, 0.8, most)
        assert got.tolist() == [k for k, (x, y) in enumerate(zip(a, b, strict=True)) if 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y])]

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import substring_dedup as D
from tessera.llm.common import Block, by_shard, flags_of, load, packed, unzip
from tessera.llm.fm_index import FMIndex


def brute(rows, threshold):
    """(n_words, n_removed, sha256) of each row; rows are (id, text)."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    seen = {}
    for rank, i in enumerate(order):
        for j in range(len(words[i]) - threshold + 1):
            seen.setdefault(tuple(words[i][j : j + threshold]), (i, j))
    out = []
    for i, w in enumerate(words):
        gone = set()
        for j in range(len(w) - threshold + 1):
            if seen[tuple(w[j : j + threshold])] != (i, j):
                gone.update(range(j, j + threshold))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def digest(rows):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    passages = [" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 3)) for _ in range(rng.randint(3, 60))) for _ in range(12)]
    rows = []
    for i in range(80):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 6))]
        rows.append((i * 3 % 80, rng.choice([" ", "\n", "\t\x0b  "]).join(parts)))
    rows += [(200, None), (201, ""), (202, "a " * 500), (203, "a " * 100), (204, " \n "), (205, "é日 " * 30), (None, passages[0] + " tail"), (-5, passages[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for threshold, size in ((20, 2000), (5, 500), (20, 1 << 22), (1, 3000)):
        got = D.dedup(docs.repartition(3), threshold=threshold, block_bytes=size, hot=3 if size < 3000 else D.HOT).collect()
        want = sorted((str(i), *w) for (i, _), w in zip(rows, brute(rows, threshold), strict=True))
        assert digest(got) == want
        for r in got:
            assert sum(s.end - s.first for s in r.spans) == r.n_removed


def test_repeated_rows_are_one_document(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (1, text), (1, text + " x"), (2, text), (None, text), (None, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = D.dedup(docs, block_bytes=100).collect()
    assert len(got) == 6
    by = {}
    for r in got:
        by.setdefault((r.doc_id, r.n_words), set()).add(r.n_removed)
    assert all(len(v) == 1 for v in by.values())
    assert by[2, 30] == by[None, 30] == {30}
    assert sorted([by[1, 30], by[1, 31]], key=min) in ([{0}, {30}], [{0}, {31}])


def test_query_on_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in load(spark, sf, "documents").collect()]
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in D.op1_substring_dedup(spark, sf).collect())
    assert got == sorted((i, *w) for (i, _), w in zip(rows, brute(rows, 20), strict=True))


def test_empty_table(spark):
    assert D.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_index_finds_all_matches():
    rng = np.random.default_rng(3)
    for _ in range(30):
        lengths = rng.integers(1, 40, rng.integers(1, 12))
        words = rng.integers(0, rng.choice([2, 4, 20]), lengths.sum()).astype(np.uint64)
        depth = int(rng.integers(1, 9))
        index = FMIndex(words, lengths, depth)
        asked = rng.integers(0, 30, rng.integers(0, 12))
        query = rng.integers(0, 5, asked.sum()).astype(np.uint64)
        have = {}
        for s in np.split(words, np.cumsum(lengths)[:-1]):
            for i in range(len(s) - depth + 1):
                have[tuple(s[i : i + depth])] = have.get(tuple(s[i : i + depth]), 0) + 1
        want = {}
        for j, s in enumerate(np.split(query, np.cumsum(asked)[:-1]) if len(asked) else []):
            for i in range(len(s) - depth + 1):
                if tuple(s[i : i + depth]) in have:
                    want[j, i] = have[tuple(s[i : i + depth])]
        got = {(a, b): index.group_start[c + 1] - index.group_start[c] for a, b, c in zip(*index.matches(query, asked), strict=True)}
        assert got == want


def test_a_common_phrase_loads_no_shard(spark):
    """Texts that differ but for a phrase shorter than a window: their segments have one minimizer."""
    rng, phrase, shards = random.Random(5), " ".join(f"p{i}" for i in range(15)), 200
    texts = [" ".join(f"u{rng.randint(0, 10**6)}" for _ in range(30)) + f" {phrase} " + " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(30)) for _ in range(3000)]
    blocks = [Block(p) for a in range(0, 3000, 500) for _, p in packed(pa.array(range(a, a + 500)), pa.array(texts[a : a + 500]), 1 << 22)]
    segments = [D.Segments(b, 20, shards) for b in blocks]
    asks = {}
    for k, seg in enumerate(segments):
        for shard, keys, twice, different in seg.asks():
            keys = np.frombuffer(keys, np.uint64)
            asks.setdefault(shard, []).append((k, keys, flags_of(twice, len(keys)), np.frombuffer(unzip(different), np.uint16)))
    answers = [{} for _ in blocks]
    for shard, rows in asks.items():
        for (k, *_), bits in zip(rows, D._known(*zip(*[r[1:] for r in rows], strict=True), 32), strict=True):
            answers[k][shard] = bits
    load_of = np.zeros(shards, int)
    for seg, got in zip(segments, answers, strict=True):
        seg.choose(got, shards)
        for shard, part in by_shard(seg.home):
            load_of[shard] += part.stop - part.start
    assert load_of.sum() > 6000 and load_of.max() < 2 * load_of.mean()

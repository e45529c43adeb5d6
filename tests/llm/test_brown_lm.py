import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import brown_lm as B
from tessera.llm.common import load, word_bounds, word_hashes


def brute(rows):
    tokens = []
    for i, t in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        tokens.append(([*re.findall(r"[^\x20\x09-\x0D]+", lower), None], zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1))
    count = Counter(w for words, out in tokens if not out for w in words)
    n, v = sum(count.values()), len(count)
    res = []
    for (i, _), (words, out) in zip(rows, tokens, strict=True):
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        res.append((i, out, len(words), sum(count[w] > 0 for w in words), n, base))
    return res


def compare(got, rows):
    key = lambda r: tuple(map(str, r[:5])) + (round(r[5], 6),)
    got, want = sorted(map(tuple, got), key=key), sorted(brute(rows), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want, strict=True):
        assert a[5] == pytest.approx(b[5], abs=1e-6)
        assert a[6] < 0 and math.isfinite(a[6])


def test_counts_equal_brute_force_and_odd_rows(spark):
    rows = [(i, " ".join(f"W{(i * j) % 17}" for j in range(i % 9))) for i in range(60)]
    rows += [(None, "a B c"), (None, None), (3, ""), (3, ""), (99, "É é Z\x0bz"), (100, "x " * 3000), (101, "only-here-%d " % 1)]
    docs = spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id long, text string, score double")
    compare(B.score(docs.repartition(3), block_bytes=300, head=8, classes=3).collect(), rows)
    assert B.score(docs.limit(0)).count() == 0
    compare(B.score(docs.filter("doc_id = 6")).collect(), [r for r in rows if r[0] == 6])


def test_held_out_perplexity_is_below_the_base(spark):
    sf = "/root/testdata/sf0.01"
    got = B.op7_brown_lm(spark, sf).cache()
    compare(got.collect(), [(r.doc_id, r.text) for r in load(spark, sf, "documents").collect()])
    assert B.perplexity(got) < 0.9 * B.perplexity(got, "base_score")


def test_probabilities_sum_to_one(spark):
    words = ["a", "b", "c", "d"]
    train = [(i, " ".join(np.random.default_rng(i).choice(words, 12))) for i in range(200)]
    probe = [(10_000 + i, " ".join(p)) for i, p in enumerate([[*x] for x in ("a", "b", "c", "d", "zz")])]
    probe = [(next(j for j in range(i * 50, i * 50 + 50) if zlib.crc32(str(j).encode()) % 5 == 1), t) for i, t in probe]
    docs = spark.createDataFrame(train + [(i, t) for i, t in probe] + [(next(j for j in range(900_000, 900_050) if zlib.crc32(str(j).encode()) % 5 == 1), "")], "doc_id long, text string")
    # P(first token = w) * P(end | w), and of the end at once: the first factors sum to one, so the sum is below it
    got = {r.doc_id: r.score for r in B.score(docs, classes=2, head=4).collect()}
    total = sum(10 ** got[i] for i, _ in probe) + 10 ** next(s for i, s in got.items() if 900_000 <= i < 900_050)
    assert total < 1


def test_exchange_finds_alternating_classes():
    rng = np.random.default_rng(1)
    units, group = 20, np.arange(20) % 2
    group = rng.permutation(group)
    counts = np.where(group[:, None] != group[None, :], 50, 0) + rng.integers(0, 3, (units, units))
    of = B.exchange(np.pad(counts, (0, 1)), units, classes=2)
    assert of[-1] == 2 and len({(g, c) for g, c in zip(group, of[:units], strict=True)}) == 2


def brute_scores(rows, head, classes, gain=B.GAIN, share=B.SHARE):
    """(id, score) by dictionaries of words: the start, rounds over all bigrams, and the classes' model."""
    texts = [("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split(), zlib.crc32(str(i).encode()) % 5 == 1) for i, t in rows]
    count = Counter(w for words, out in texts if not out for w in words)
    raw = np.frombuffer(" ".join(count).encode(), np.uint8)
    key = dict(zip(count, word_hashes(raw, *word_bounds(raw, np.array([0, len(raw)]))).tolist(), strict=True))
    heads = sorted(sorted(count, key=lambda w: (-count[w], key[w]))[:head], key=key.get)
    m, end = len(heads), None
    grams = [(a, b) for words, out in texts if not out for a, b in zip([end, *words], [*words, end], strict=True)]
    unit = {w: i for i, w in enumerate(heads)} | {end: m + 1}
    table = np.zeros((m + 2, m + 2), np.int64)
    for a, b in grams:
        table[unit.get(a, m), unit.get(b, m)] += 1
    of = B.exchange(table, m, classes)
    now = {w: int(of[unit[w]]) if w in unit else classes for w in count} | {end: classes + 1}

    def pairs(now):
        t = np.zeros((classes + 2, classes + 2))
        for a, b in grams:
            t[now[a], now[b]] += 1
        return t

    def moved(now, t, first):
        p = t + 0.5
        size = t.sum(axis=0)[:classes] + 1
        start, likely = np.log(size / size.sum()), {}
        near = {w: Counter() for w in count}
        for a, b in grams:
            if b is not end and now[a] != classes:
                near[b][0, now[a]] += 1
            if a is not end and now[b] != classes:
                near[a][1, now[b]] += 1
        for w in count:
            if first and now[w] != classes:
                likely[w] = now[w]
                continue
            total = start.copy()
            for (side, c), n in sorted(near[w].items()):
                of_class = p[c, :classes] / p.sum(axis=0)[:classes] if side == 0 else p[:classes, c] / p.sum(axis=1)[:classes]
                total += n * np.log(of_class)
            likely[w] = int(np.argmax(total))
        return likely | {end: classes + 1}

    now = moved(now, pairs(now), True)
    rounds = 0
    while True:
        new = moved(now, pairs(now), False)
        had, has = B.information(pairs(now)), B.information(pairs(new))
        rounds += 1
        if has > had:
            now = new
        if has <= had * (1 + gain):
            break
    t = pairs(now)
    n_in, kinds = t.sum(axis=0), Counter(now[w] for w in count)
    n_in[classes + 1] = sum(not out for _, out in texts)
    total, v = len(grams), len(count) + 1
    shares = {c: (n_in[c] + 0.5) / sum(n_in[x] + 0.5 for x in [*range(classes), classes + 1]) for c in [*range(classes), classes + 1]}
    mass = {c: n_in[c] + 0.5 * (kinds[c] + 1) for c in range(classes)}
    out = []
    for (i, _), (words, _) in zip(rows, texts, strict=True):
        score, before = 0.0, classes + 1
        for w in [*words, end]:
            move = lambda c, b=before: shares[c] if b is None else (t[b, c] + shares[c]) / (t[b].sum() + 1)
            if w is end:
                p, n, c = move(classes + 1), n_in[classes + 1], classes + 1
            elif w in count:
                c, n = now[w], count[w]
                p = move(c) * (n + 0.5) / mass[c]
            else:
                c, n, p = None, 0, sum(move(c) * 0.5 / mass[c] for c in range(classes))
            score += math.log10(share * p + (1 - share) * (n + 0.5) / (total + 0.5 * (v + 1)))
            before = c
        out.append((i, score))
    return out, rounds


def test_scores_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    kinds = [[f"{x}{i}" for i in range(40)] for x in "nvad"]
    rows = [(i, " ".join(rng.choice(kinds[(j + i) % 4], p=np.arange(1, 41) ** -1.2 / (np.arange(1, 41) ** -1.2).sum()) for j in range(4 + i % 13))) for i in range(250)]
    rows[17] = (17, "Only here A0")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, rounds = brute_scores(rows, head=12, classes=6)
    assert rounds > 1  # words outside the start, and bigrams of two such, were exchanged more than once
    got = {r.doc_id: r.score for r in B.score(docs.repartition(3), head=12, classes=6, block_bytes=700).collect()}
    for i, s in want:
        assert got[i] == pytest.approx(s, abs=1e-6), i


def test_number_of_classes_is_checked(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    with pytest.raises(ValueError):
        B.score(docs, classes=0)
    assert B.score(docs, classes=300).count() == 1

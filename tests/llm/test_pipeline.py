import hashlib
import re
from collections import Counter

import pytest

import corpus_pipeline as C
from tessera.llm import jaccard_join, mixing, piece_codec, quality_rules
from tessera.llm.common import load

from .test_jaccard_join import brute as links_of
from .test_quality_rules import brute as stats_of
from .test_substring_dedup import brute as dedup_of

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return [tuple(r) for r in df.select(*C.COLUMNS).collect()]


def test_stages_against_brute_force(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    docs = load(spark, SF, "documents")
    given = {r.doc_id: r for r in docs.collect()}

    good = C.quality(spark, docs, SF).cache()
    rules = quality_rules.fit(docs, load(spark, SF, "labels"))
    kept = {r[0] for r in rows_of(good)}
    for i, r in given.items():
        n, chars, symbols, dup, repeats = stats_of(r.text)
        base = n < 50 or 100 * repeats > 50 * n
        row = {"words": n, "word_length": chars / n if n else 0, "symbols_per_word": symbols / n if n else 0, "repeat_share": repeats / n if n else 0}
        if {c.feature for rule in rules.rules for c in rule} <= row.keys():
            assert (i in kept) == (not base and rules.accepts_row(row)), i
        else:
            assert not (base and i in kept)
    assert all(given[r[0]].text == r[1] for r in rows_of(good))

    one = C.near_duplicates(spark, good, SF).cache()
    want = {d for d, c, _ in links_of([(r[0], r[1]) for r in rows_of(good)]) if d == c}
    assert {str(r[0]) for r in rows_of(one)} == want and one.count() == len(want)

    cut = C.passages(spark, one, SF).cache()
    before = rows_of(one)
    after = {r[0]: r for r in rows_of(cut)}
    for (i, text, lang, source, _), (n, gone, digest) in zip(before, dedup_of([(r[0], r[1]) for r in before], 20), strict=True):
        if gone == n:
            assert i not in after
        else:
            got = after[i][1]
            assert (got == text) if not gone else hashlib.sha256(got.encode()).hexdigest() == digest
            assert after[i][2:] == (lang, source, len(got))

    mix = C.mixed(spark, cut, SF).cache()
    times = {r.doc_id: r.times for r in mixing.mix(cut).collect()}
    assert Counter(r[0] for r in rows_of(mix)) == Counter({i: n for i, n in times.items() if n})
    assert max(times.values()) <= 2

    out = C.tokens(spark, mix, SF).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model())
    text = {r[0]: r[1] for r in rows_of(mix)}
    assert len(out) == mix.count()
    for r in out:
        ids = sp.encode(text[r.doc_id], add_eos=True)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(1, long, "en", "s", 9), (1, long, "en", "s", 9), (2, long, None, None, None), (None, long + " x", "en", "s", 1), (3, None, "en", "s", 0), (4, "", "de", None, 0), (5, re.sub("w", "v", long), "en", "t", 1), (1, re.sub("w", "u", long), "en", "t", 1)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    good = C.quality(spark, docs, SF)
    assert len(rows_of(good)) == 6
    one = rows_of(C.near_duplicates(spark, docs, SF))
    assert sorted((str(r[0]), str(r[1])[:2]) for r in one) == [("1", "u0"), ("1", "w0"), ("3", "No"), ("4", ""), ("5", "v0")]
    assert sorted(str(r[0]) for r in rows_of(C.passages(spark, docs, SF))) == ["1", "1", "1", "3", "4", "5", "None"]
    for stage in (C.quality, C.near_duplicates, C.passages, C.mixed):
        assert stage(spark, docs.limit(0), SF).columns == list(C.COLUMNS)
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert C.tokens(spark, docs.limit(0), SF).count() == 0


def test_run(spark):
    assert C.run(spark, SF).count() > 0
    assert jaccard_join.THRESHOLD == 0.8

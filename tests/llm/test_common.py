import numpy as np

from tessera.llm import common as C


def hashes(words):
    data = np.frombuffer(b" ".join(words), np.uint8)
    s, e = C.word_bounds(data, np.array([0, len(data)]))
    return C.word_hashes(data, s, e)


def test_equal_words_have_equal_hashes_wherever_they_stand():
    words = [b"a" * n + bytes([98 + n % 7]) for n in range(1, 60)] + ["é水".encode() * n for n in range(1, 9)]
    first = hashes(words)
    assert len(set(first.tolist())) == len(words)
    for lead in range(1, 17):
        assert (hashes([b"x" * lead, *words])[1:] == first).all()
    assert hashes([b"a", b"a\0"])[0] != hashes([b"a", b"a\0"])[1]
    assert (C.word_hashes(np.frombuffer(b" ".join(words), np.uint8), *C.word_bounds(np.frombuffer(b" ".join(words), np.uint8), np.array([0, len(b" ".join(words))])), step=5) == first).all()


def test_alternating_words_and_spans_do_not_collide():
    """Sequences of two values in the order of the parity of ones, and their complement: equal modulo 2**64 under any
    polynomial with an odd base."""
    for n in (256, 1024, 4096):
        parity = np.array([i.bit_count() & 1 for i in range(n)])
        a, b = hashes([bytes((97 + parity).astype(np.uint8)), bytes((98 - parity).astype(np.uint8))])
        assert a != b
        two = hashes([b"one", b"two"])
        both = np.concatenate([two[parity], two[1 - parity]])
        x, y = C.span_hash(both, np.array([0, n]), np.array([n, 2 * n]))
        assert x != y


def test_spans_of_equal_contents_are_equal():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 2**63, 500, dtype=np.uint64)
    both = np.concatenate([v, rng.integers(0, 9, 13, dtype=np.uint64), v])
    for n in (0, 1, 15, 16, 17, 32, 33, 100):
        at = np.arange(0, 500 - n)
        h = C.span_hash(both, np.concatenate([at, at + 513]), np.concatenate([at + n, at + 513 + n]))
        assert (h[: len(at)] == h[len(at) :]).all()
        assert n == 0 or len(np.unique(h)) == len(at)
        assert (C.span_hash(both, at[:1], at[:1] + n) == h[:1]).all()


def test_cuts_of_a_scope_can_be_dropped(spark):
    import os

    with C.scope() as made:
        one = C.cut(spark.range(3).toDF("id"))
        two = C.cut_bucketed(spark.range(3).toDF("id"), "id", 2, "scoped")
    three = C.cut(spark.range(3).toDF("id"))
    assert made == [one, two]
    places = [x.cut_at.removeprefix("file://") for x in (one, two, three)]
    C.drop(*made)
    assert [os.path.exists(p) for p in places] == [False, False, True]
    assert not spark.catalog.listTables(pattern="scoped*")

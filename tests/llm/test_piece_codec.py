import hashlib
import random

import pytest

sentencepiece = pytest.importorskip("sentencepiece")
pytest.importorskip("public_tokenizers")

from tessera.llm import piece_codec as P  # noqa: E402


def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.default_model())


def texts():
    rng = random.Random(5)
    letters = "ab  \n\tzé日𠮷▁th eing<0x41></s>"
    out = ["", " ", "   ", "▁", "▁▁x", " \t", "a  b ", "aaaa" * 30, "abab" * 50, " " * 300 + "x", "<s>", "</s>", "<unk>", "<0x0A>", "a\r\n\tb"]
    out += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    out += ["".join(rng.choice("aeiourstnl") for _ in range(rng.randint(1, 400))) for _ in range(200)]
    return out


def test_ids_and_decoding_equal_the_library():
    sp, model = library(), P.PieceModel(open(P.default_model(), "rb").read())
    codec, digest = P.Codec(model), P.DigestCodec(model)
    given = texts()
    for text, words, short in zip(given, codec.encode(given), digest.encode(given), strict=True):
        ids = [i for w in words for i in w] + [2]
        assert ids == sp.encode(text, add_eos=True)
        assert model.decode(ids) == sp.decode(ids)
        joined = "".join(w[2] for w in short)
        assert (joined[1:] if joined[:1] == " " else joined) == sp.decode(ids)


def test_long_repetition_ends_and_is_exact():
    sp, model = library(), P.PieceModel(open(P.default_model(), "rb").read())
    for text in ("ab" * 20_000, "x" * 30_001, "the" * 9000):
        assert [i for w in P.Codec(model).encode([text])[0] for i in w] == sp.encode(text)


def test_query_has_a_row_for_each_document(spark, tmp_path):
    rows = [(1, "Hello  world", "x"), (None, None, "y"), (1, "Hello  world", "x"), (2, "", None), (3, "日本 𠮷", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = P.encode_decode(docs.select("doc_id", "text"), P.default_model(), digests=True).collect()
    sp = library()
    want = []
    for i, t, _ in rows:
        ids = sp.encode(t or "", add_eos=True)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    full = P.encode_decode(docs, P.default_model())
    assert full.columns == ["doc_id", "n_tokens", "text", "ids", "decoded"]
    assert {r.decoded for r in full.collect()} == {t or "" for _, t, _ in rows}
    assert P.encode_decode(docs.limit(0), P.default_model(), digests=True).count() == 0

"""SentencePiece BPE encoding and decoding without the library, in vectorised merge rounds.

The model file is read directly. A text is cut before every run of spaces; no piece of the supported models holds a
space mark after another character, so no merge crosses such a cut. Distinct words of a batch are laid out as one flat
array of symbols. In each round every word finds its smallest pair rank (segmented minimum), all leftmost
non-overlapping places with that rank merge at once, and the array is compacted, until no word has a pair left. A
place waits for the next round if a merge to the left of it makes a pair of the same or a smaller rank, so the outcome
is that of one merge at a time.

Nulls are read as empty texts; an empty text has the end id only. Each row is answered alone: repeated rows, ties and
extra columns change nothing, and an empty table gives an empty table. Memory holds one Arrow batch and a bounded
table of words.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MOST_WORDS = 200_000
NEVER = np.int32(2**31 - 1)


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        x = b[i]
        i += 1
        value |= (x & 127) << shift
        shift += 7
        if x < 128:
            return value, i


def _fields(b: bytes):
    """(number, value) of each field of a protocol-buffer message."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 0:
            value, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            value, i = b[i : i + n], i + n
        else:
            n = 4 if kind == 5 else 8
            value, i = b[i : i + n], i + n
        yield tag >> 3, value


class PieceModel:
    """A BPE model with the identity normaliser: vocabulary, ranks of pairs, and both directions."""

    def __init__(self, raw: bytes):
        self.pieces, self.kinds, scores = [], [], []
        prefix, extra, escape, charsmap, model = 1, 1, 1, b"", 1
        for number, value in _fields(raw):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append(f[1].decode())
                scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                self.kinds.append(f.get(3, NORMAL))
            elif number == 2:
                model = dict(_fields(value)).get(3, 1)
            elif number == 3:
                f = dict(_fields(value))
                charsmap, prefix, extra, escape = f.get(2, b""), f.get(3, 1), f.get(4, 1), f.get(5, 1)
        merging = [i for i, k in enumerate(self.kinds) if k in (NORMAL, USER, UNUSED)]
        if model != 2 or charsmap or extra or not escape or any(self.kinds[i] != NORMAL for i in merging):
            raise ValueError("only BPE models with the identity normaliser and plain pieces are supported")
        if any(MARK in self.pieces[i].lstrip(MARK) for i in merging):
            raise ValueError("a piece has a space mark after another character")
        self.prefix = bool(prefix)
        self.end = next((i for i, p in enumerate(self.pieces) if p == "</s>" and self.kinds[i] == CONTROL), -1)
        self.unknown = self.kinds.index(UNKNOWN)
        byte = {self.pieces[i]: i for i, k in enumerate(self.kinds) if k == BYTE}
        self.bytes = [byte[f"<0x{b:02X}>"] for b in range(256)] if byte else None
        self.byte_of = {i: b for b, i in enumerate(self.bytes or ())}
        # symbols: the pieces, then characters that occur in pieces only
        symbol = {self.pieces[i]: i for i in merging}
        n = len(self.pieces)
        for c in sorted(set("".join(symbol)) - symbol.keys()):
            symbol[c] = n
            n += 1
        self.alone = {c: s for c, s in symbol.items() if len(c) == 1}
        self.width = n + 1  # n: a character that no piece has
        order = {s: r for r, s in enumerate(sorted({-scores[i] for i in merging}))}
        pairs = {}
        for i in merging:
            p = self.pieces[i]
            for k in range(1, len(p)):
                a, b = symbol.get(p[:k]), symbol.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * self.width + b] = (order[-scores[i]], i)
        self.size = 1 << max(4, (4 * len(pairs) - 1).bit_length())
        self.keys = np.full(self.size, -1, np.int64)
        self.ranks = np.full(self.size, NEVER, np.int32)
        self.makes = np.zeros(self.size, np.int32)
        keys = np.fromiter(pairs, np.int64, len(pairs))
        slots = self._slot(keys)
        self.probes = 1
        for key, slot, (rank, makes) in zip(keys.tolist(), slots.tolist(), pairs.values(), strict=True):
            probes = 1
            while self.keys[slot] >= 0:
                slot = (slot + 1) % self.size
                probes += 1
            self.probes = max(self.probes, probes)
            self.keys[slot], self.ranks[slot], self.makes[slot] = key, rank, makes
        alone = np.full(0x110000, n, np.int32)
        for c, s in self.alone.items():
            alone[ord(c)] = s
        self.symbol_of = alone

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(64 - (self.size.bit_length() - 1))).astype(np.int64)

    def pair_slots(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where each pair is in the table, or -1."""
        keys = left.astype(np.int64) * self.width + right
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, slot, -1)
        open_ = np.flatnonzero((out < 0) & (self.keys[slot] >= 0))
        for _ in range(1, self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) % self.size
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = slot[open_[hit]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = self.pair_slots(left, right)
        hit = slot >= 0
        slot[~hit] = 0
        return np.where(hit, self.ranks[slot], NEVER), self.makes[slot]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of each word; a word is text between two cuts, with its space marks."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.symbol_of[points]
        word = np.repeat(np.arange(len(words)), lens)
        at = np.arange(len(points))  # the first code point of each symbol
        done = []
        rank, makes = self._ranks(sym, word)
        while len(sym):
            # words without a pair are finished
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, first)
            run = np.diff(np.append(first, len(sym)))
            over = np.repeat(least == NEVER, run)
            if over.any():
                done.append((at[over], sym[over], word[over]))
                keep = ~over
                sym, word, at, rank, makes = sym[keep], word[keep], at[keep], rank[keep], makes[keep]
                continue
            low = np.repeat(least, run)
            hit = np.flatnonzero(rank == low)
            # leftmost of overlapping places: every other one of a row of neighbours
            row = np.concatenate([[True], hit[1:] != hit[:-1] + 1])
            begin = np.maximum.accumulate(np.where(row, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - begin) % 2 == 0]
            # a merge that makes a pair of the same or a smaller rank ends the word's round
            made = makes[hit]
            n = len(sym)
            w = word[hit]
            before = hit - 1
            near = np.concatenate([[False], hit[1:] == hit[:-1] + 2])
            left = np.where(near, np.concatenate([[0], made[:-1]]), sym[np.maximum(before, 0)])
            has_left = (before >= 0) & (word[np.maximum(before, 0)] == w)
            after = hit + 2
            has_right = (after < n) & (word[np.minimum(after, n - 1)] == w)
            new_left = np.where(has_left, self.rank(left, made)[0], NEVER)
            new_right = np.where(has_right, self.rank(made, sym[np.minimum(after, n - 1)])[0], NEVER)
            stop = np.minimum(new_left, new_right) <= rank[hit]
            if stop.any():
                count = np.cumsum(stop)
                head = np.concatenate([[True], w[1:] != w[:-1]])
                base = np.maximum.accumulate(np.where(head, count - stop, 0))
                hit_keep = count - stop - base == 0
                hit, made = hit[hit_keep], made[hit_keep]
            sym[hit] = made
            keep = np.ones(n, bool)
            keep[hit + 1] = False
            fresh = np.zeros(n, bool)
            fresh[hit] = True
            fresh[np.maximum(hit - 1, 0)] = True
            # the symbol before hit may itself have just been merged away
            gone = np.flatnonzero(fresh & ~keep)
            fresh[np.maximum(gone - 1, 0)] = True
            sym, word, at, rank, makes, fresh = sym[keep], word[keep], at[keep], rank[keep], makes[keep], fresh[keep]
            again = np.flatnonzero(fresh)
            rank[again], makes[again] = self._ranks_at(sym, word, again)
        if not done:
            return [[] for _ in words]
        at, sym, word = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(at, kind="stable")
        at, sym, word = at[order], sym[order], word[order]
        cuts = np.searchsorted(word, np.arange(len(words) + 1))
        flat = sym.tolist()
        out = [flat[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        for i in np.flatnonzero(np.bincount(word[sym >= len(self.pieces)], minlength=len(words))):
            ids, places = [], at[cuts[i] : cuts[i + 1]].tolist()
            for s, p in zip(out[i], places, strict=True):
                if s < len(self.pieces):
                    ids.append(s)
                elif self.bytes:
                    ids += [self.bytes[b] for b in chr(int(points[p])).encode()]
                else:
                    ids.append(self.unknown)
            out[i] = ids
        return out

    def _ranks(self, sym, word):
        return self._ranks_at(sym, word, np.arange(len(sym)))

    def _ranks_at(self, sym, word, at):
        """Rank and product of the pair that starts at each of these places."""
        if not len(sym):
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        nxt = np.minimum(at + 1, len(sym) - 1)
        rank, makes = self.rank(sym[at], sym[nxt])
        return np.where((at + 1 < len(sym)) & (word[at] == word[nxt]), rank, NEVER).astype(np.int32), makes

    def cut(self, text: str) -> list[str]:
        """The words of a text, each with the space marks before it."""
        if not text:
            return []
        text = text.replace(MARK, " ")
        parts = text.split(" ")
        if "" not in parts:
            return [MARK + p if k or self.prefix else p for k, p in enumerate(parts)]
        words, marks = [], MARK if self.prefix else ""
        for k, p in enumerate(parts):
            if k:
                marks += MARK
            if p:
                words.append(marks + p)
                marks = ""
        if marks:
            words.append(marks)
        return words

    def decode(self, ids) -> str:
        out, run, first = [], bytearray(), True
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                run.append(b)
                continue
            if run:
                out.append(run.decode(errors="replace"))
                run.clear()
            kind = self.kinds[i]
            if kind == CONTROL:
                continue
            piece = " ⁇ " if kind == UNKNOWN else self.pieces[i]
            if first and self.prefix and piece.startswith(MARK):
                piece = piece[1:]
            first = False
            out.append(piece)
        if run:
            out.append(run.decode(errors="replace"))
        return "".join(out).replace(MARK, " ")


class Codec:
    """Encodes texts by way of their distinct words, of which it keeps MOST_WORDS at most between batches."""

    def __init__(self, model: PieceModel):
        self.model, self.known = model, {}

    def encode(self, texts: list[str]) -> list[list[list[int]]]:
        """For each text its words' ids."""
        if len(self.known) > MOST_WORDS:
            self.known = {}
        cuts = [self.model.cut(t) for t in texts]
        new = [w for w in set().union(*cuts) if w not in self.known] if cuts else []
        self.learn(new)
        return [[self.known[w] for w in words] for words in cuts]

    def learn(self, words: list[str], step: int = 1 << 16) -> None:
        """Encodes words in rounds over at most about `step` characters at once."""
        i = 0
        while i < len(words):
            n, j = 0, i
            while j < len(words) and (j == i or n + len(words[j]) <= step):
                n += len(words[j])
                j += 1
            for w, ids in zip(words[i:j], self.model.encode_words(words[i:j]), strict=True):
                self.known[w] = self.entry(w, ids)
            i = j

    def entry(self, word: str, ids: list[int]):
        return ids


class DigestCodec(Codec):
    """Keeps of a word how many ids it has, these as text, and what they decode to."""

    def __init__(self, model: PieceModel):
        super().__init__(model)
        self.number = [str(i) for i in range(len(model.pieces))]
        self.plain = [p.replace(MARK, " ") if k == NORMAL else None for p, k in zip(model.pieces, model.kinds, strict=True)]

    def entry(self, word, ids):
        parts = [self.plain[i] for i in ids]
        text = self.model.decode([self.model.unknown, *ids])[3:] if None in parts else "".join(parts)
        return len(ids), " ".join([self.number[i] for i in ids]), text


def encode_decode(docs: DataFrame, model_path: str, text_col: str = "text", *, digests: bool = False, end: bool = True) -> DataFrame:
    """docs' columns and `ids` array<int> and `decoded` string; with digests, instead of these `n_tokens`,
    `ids_sha256` and `decoded_sha256`. The columns that are added replace columns of the same name.

    The model file must be at model_path on every executor (the driver reads it and sends it along: 0.5 MB).
    """
    with open(model_path, "rb") as f:
        raw = f.read()
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]
    kinds = ["long", "string", "string"] if digests else ["array<int>", "string"]
    kept = [c for c in docs.columns if c not in names and c != text_col]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").cast("string").alias("\u0001text"))
    if not digests:
        source = source.withColumn(text_col, F.col("\u0001text"))

    def run(batches):
        model = PieceModel(raw)
        codec = (DigestCodec if digests else Codec)(model)
        tail = [model.end] if end else []
        for batch in batches:
            texts = [t or "" for t in batch.column("\u0001text").to_pylist()]
            rest = [batch.column(i) for i, c in enumerate(batch.schema.names) if c != "\u0001text"]
            if digests:
                n, one, two = [], [], []
                for a in range(0, len(texts), 64):
                    for words in codec.encode(texts[a : a + 64]):
                        n.append(sum(w[0] for w in words) + len(tail))
                        ids = " ".join([w[1] for w in words] + [str(x) for x in tail])
                        one.append(hashlib.sha256(ids.encode()).hexdigest())
                        text = "".join([w[2] for w in words])
                        two.append(hashlib.sha256((text[1:] if model.prefix and text[:1] == " " else text).encode()).hexdigest())
                made = [pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())]
            else:
                ids = [[i for w in words for i in w] + tail for words in codec.encode(texts)]
                made = [pa.array(ids, pa.list_(pa.int32())), pa.array([model.decode(x) for x in ids], pa.string())]
            yield pa.RecordBatch.from_arrays([*rest, *made], names=[*(c for c in batch.schema.names if c != "\u0001text"), *names])

    fields = [f for f in source.schema.fields if f.name != "\u0001text"]
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    schema = StructType([*fields, *(StructField(n, _parse_datatype_string(k)) for n, k in zip(names, kinds, strict=True))])
    return source.mapInArrow(run, schema)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_decode(docs, default_model(), digests=True)


QUERIES = {"op9_sentencepiece": op9_sentencepiece}
SQL: dict[str, str] = {}

"""Language-model scores from Brown classes: exchange clustering, class transitions, word emissions.

1. Documents are cut into blocks of words' numbers, once. Each block asks the shards for the training counts of its
   distinct words. The shards add up what the blocks send, so counts cover the whole corpus and no shard sees more than
   one item of a word from a block.
2. A start: the HEAD most frequent words are clustered by exchange on the driver: each word moves to the class that
   raises the likelihood of the class bigrams most. Their bigram counts are gathered over all training tokens, with all
   other words as one unit. There are as many classes as the cube root of the number of distinct training words, and at
   most CLASSES (a bound on the tables of class pairs, which every task holds).
3. Exchange of all words, in rounds over all training bigrams: class pairs are counted; the blocks send how often each class
   stands to the left and to the right of each of their words; the word's shard adds that up and moves the word to the class
   of greatest likelihood. In the first round the words outside the start get their first class. Rounds go on as
   long as the mutual information of neighbouring classes rises by a share of GAIN of itself; a round that lowers it is
   undone. As it is bounded, the rounds end.
4. Texts are scored: P(w | v) = L * P(class(w) | class(v)) * P(w | class(w)) + (1 - L) * P(w). A class emits one
   unseen word besides its own; an unseen word sums these over classes, and after it classes have their overall
   shares. A text's end is a token and a class of its own, and stands before its first word.

Words are split at space and U+0009..U+000D, A-Z are lower-cased; they are told apart by 64-bit hashes. Null texts are
empty, and have the end only. A null id counts as an empty string where documents are held out. Repeated rows count and
are scored each for itself. Extra columns are dropped; an empty table gives an empty table. Without training documents
every token is unseen. Of words and classes alike, the smaller hash and the smaller number come first.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import answers_of, by_shard, cut, cut_bucketed, drop, load, shards_for, text_column, unzip, with_answers, word_bounds, word_hashes, zipped

HEAD, CLASSES, ROUNDS, SHARE, GAIN = 1024, 256, 6, 0.9, 0.005
BLOCK = 4 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TRAINED = 1 << 15


def held_out(ids: np.ndarray, null: np.ndarray, folds: int = 5, fold: int = 1) -> np.ndarray:
    """crc32 of the id as text, modulo folds, is fold."""
    return np.fromiter((zlib.crc32(b"" if n else b"%d" % i) % folds == fold for i, n in zip(ids.tolist(), null.tolist(), strict=True)), bool, len(ids))


# ---------------------------------------------------------------- blocks of words


def _kind(n: int):
    return np.uint16 if n <= 1 << 16 else np.uint32


def tokenised(docs: DataFrame, id_col: str, text_col: str, most: int = BLOCK) -> DataFrame:
    """Blocks of documents: (block, train, docs, keys, counts, codes).

    keys: the hashes of a block's distinct words, ascending; counts: how often each stands in its training documents, whose
    number is train; codes: the words' numbers among these, one after another; docs: ids, flags and lengths.
    """

    def pack(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, off = text_column(batch.column(1))
            null = np.asarray(batch.column(0).is_null())
            ids = np.asarray(pc.fill_null(batch.column(0), 0).cast(pa.int64()))
            a = 0
            while a < len(ids):
                b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
                part, at = _LOWER[data[off[a] : off[b]]], off[a : b + 1] - off[a]
                s, e = word_bounds(part, at)
                lens = np.diff(np.searchsorted(s, at))
                keys, codes = np.unique(word_hashes(part, s, e), return_inverse=True)
                out = held_out(ids[a:b], null[a:b])
                counts = np.bincount(codes[np.repeat(~out, lens)], minlength=len(keys)).astype(np.uint32)
                flags = (null[a:b] | out << 1).astype(np.uint8)
                row = {
                    "block": number,
                    "train": int((~out).sum()),
                    "docs": zipped(np.int64(b - a).tobytes() + ids[a:b].tobytes() + lens.astype(np.int64).tobytes() + flags.tobytes()),
                    "keys": keys.tobytes(),
                    "counts": zipped(counts.tobytes()),
                    "codes": zipped(codes.astype(_kind(len(keys))).tobytes()),
                }
                yield pa.RecordBatch.from_pylist([row], schema=schema)
                number, a = number + 1, b

    schema = pa.schema([("block", pa.int64()), ("train", pa.int64()), *((x, pa.binary()) for x in ("docs", "keys", "counts", "codes"))])
    some = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    made = some.mapInArrow(pack, "block long, train long, docs binary, keys binary, counts binary, codes binary")
    return cut_bucketed(made, "block", int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "brown")


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Ascending, as keys are: the shards' answers one after another are those to a block's keys."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


class Tokens:
    """A block's documents and their words' numbers."""

    def __init__(self, docs: bytes, codes: bytes):
        raw = memoryview(unzip(docs))
        n = int(np.frombuffer(raw[:8], np.int64)[0])
        self.ids = np.frombuffer(raw[8 : 8 + 8 * n], np.int64)
        self.lens = np.frombuffer(raw[8 + 8 * n : 8 + 16 * n], np.int64)
        flags = np.frombuffer(raw[8 + 16 * n :], np.uint8)
        self.null, self.out = (flags & 1).astype(bool), (flags & 2).astype(bool)
        self.first = np.concatenate([[0], np.cumsum(self.lens)])
        raw = unzip(codes)
        total = int(self.first[-1])
        self.word = np.frombuffer(raw, np.uint16 if len(raw) == 2 * total else np.uint32) if total else np.zeros(0, np.uint16)

    def with_ends(self, values: np.ndarray, end) -> tuple[np.ndarray, np.ndarray]:
        """Values of all words with an end after each text, and where texts begin in this."""
        n = len(self.lens)
        full = np.full(len(self.word) + n, end, values.dtype)
        full[np.arange(len(self.word)) + np.repeat(np.arange(n), self.lens)] = values[self.word]
        return full, self.first + np.arange(n + 1)

    def bigrams(self, values: np.ndarray, end) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What stands before each token, the tokens, and which are of training documents."""
        full, first = self.with_ends(values, end)
        return np.concatenate([[end], full[:-1]]).astype(np.int64), full.astype(np.int64), np.repeat(~self.out, np.diff(first))


def gathered(answers, kind) -> np.ndarray:
    """The shards' answers, one value for each of a block's distinct words."""
    got = answers_of(answers)
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(unzip(got[shard]), kind) for shard in sorted(got))])


# ---------------------------------------------------------------- clustering


def _h(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(counts: np.ndarray, movable: int, classes: int, rounds: int = ROUNDS) -> np.ndarray:
    """Classes of units from their bigram counts [before, after]. The first `movable` units move among `classes`
    classes; each other unit stays in a class of its own, numbered on from there."""
    units = len(counts)
    of = np.concatenate([np.arange(movable) % classes, classes + np.arange(units - movable)])
    k = classes + units - movable
    counts = counts.astype(np.float64)
    one = np.zeros((units, k))
    one[np.arange(units), of] = 1
    left, right = counts.T @ one, counts @ one  # classes before and after each unit
    table = one.T @ right
    for _ in range(rounds):
        moved = 0
        for w in range(movable):
            a, own = of[w], counts[w, w]
            r, c = right[w].copy(), left[w].copy()
            r[a] -= own
            c[a] -= own
            table[a] -= r
            table[:, a] -= c
            table[a, a] -= own
            rows, cols = table.sum(axis=1) + c, table.sum(axis=0) + r  # with the unit's bigrams, wherever it goes
            gain = (_h(table + r) - _h(table)).sum(axis=1) + (_h(table.T + c) - _h(table.T)).sum(axis=1)
            d = table.diagonal()
            gain += _h(d + r + c + own) - _h(d + r) - _h(d + c) + _h(d)
            gain -= _h(rows + r.sum() + own) - _h(rows) + _h(cols + c.sum() + own) - _h(cols)
            b = int(np.argmax(gain[:classes]))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            table[b] += r
            table[:, b] += c
            table[b, b] += own
            if b != a:
                moved += 1
                of[w] = b
                left[:, a] -= counts[w]
                left[:, b] += counts[w]
                right[:, a] -= counts[:, w]
                right[:, b] += counts[:, w]
        if moved * 200 < movable:
            break
    return of


def information(table: np.ndarray) -> float:
    """Mutual information of neighbouring classes, from the counts of class pairs."""
    n = table.sum()
    if not n:
        return 0.0
    return float((_h(table).sum() - _h(table.sum(axis=0)).sum() - _h(table.sum(axis=1)).sum() + _h(n)) / n)


def weights_of(table: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood of what stands before and after a word ([feature, class]), and of a class itself, from class pairs."""
    prior = table + 0.5
    after = np.log(prior / prior.sum(axis=1, keepdims=True))[:classes]  # [class, what follows]
    ahead = np.log(prior / prior.sum(axis=0, keepdims=True)).T[:classes]  # [class, what precedes]
    size = table.sum(axis=0)[:classes] + 1
    return np.ascontiguousarray(np.concatenate([ahead, after], axis=1).T), np.log(size / size.sum())


def best_classes(word: np.ndarray, feature: np.ndarray, times: np.ndarray, weights: np.ndarray, start: np.ndarray, step: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """The words (ascending) that have features, and the class of greatest likelihood of each; rows are ordered by word."""
    head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
    edge, best = np.append(head, len(word)), np.empty(len(head), np.uint16)
    rows, a = max(1, step // weights.shape[1]), 0
    while a < len(head):
        b = max(a + 1, int(np.searchsorted(edge, edge[a] + rows, "right")) - 1)
        lo, hi = edge[a], edge[b]
        gain = np.add.reduceat(weights[feature[lo:hi]] * times[lo:hi, None], head[a:b] - lo, axis=0)
        best[a:b] = np.argmax(gain + start, axis=1)
        a = b
    return word[head], best


# ---------------------------------------------------------------- the operator


def _rows(batches, run, names, kinds):
    for batch in batches:
        for row in zip(*(batch.column(i) for i in range(batch.num_columns)), strict=True):
            got = list(run(*row))
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], kind) for i, kind in enumerate(kinds)], names=names)


def _votes(t: Tokens, keys: np.ndarray, of: np.ndarray, classes: int, first_round: bool, shards: int):
    """(shard, message): for each of a block's words its class now, and how often classes stand before and after it."""
    k = classes + 2
    before, own, on = t.bigrams(of.astype(np.uint16), classes + 1)
    word, _ = t.with_ends(np.arange(len(keys)), -1)
    moves = (own == classes) if first_round else (own < classes)
    here = np.flatnonzero(on & (word >= 0) & moves)
    near = np.concatenate([before[here], k + own[here + 1]])  # an end stands after each last word
    feature = np.concatenate([word[here], word[here]]) * (2 * k) + near
    feature = feature[near % k != classes]  # a word without a class says nothing
    feature.sort()
    head = np.flatnonzero(np.concatenate([[True], feature[1:] != feature[:-1]])) if len(feature) else np.zeros(0, np.int64)
    n = np.diff(np.append(head, len(feature)))
    feature = feature[head]
    at, feature = feature // (2 * k), feature % (2 * k)
    now = of.astype(np.uint16)
    now[np.bincount(t.word[np.repeat(~t.out, t.lens)], minlength=len(keys)) > 0] |= _TRAINED
    edge = np.searchsorted(at, np.arange(len(keys) + 1))
    each = np.diff(edge)
    for shard, part in by_shard(shard_of(keys, shards)):
        a, b = edge[part.start], edge[part.stop]
        size = np.array([part.stop - part.start, b - a], np.int64)
        sent = (size, now[part], each[part].astype(np.uint16), feature[a:b].astype(np.uint16), n[a:b].astype(np.uint32))
        yield shard, zipped(b"".join(x.tobytes() for x in sent))


def _parsed(message: bytes):
    raw = memoryview(unzip(message))
    n, v = (int(x) for x in np.frombuffer(raw[:16], np.int64))
    at, out = 16, []
    for count, kind in ((n, np.uint16), (n, np.uint16), (v, np.uint16), (v, np.uint32)):
        step = count * np.dtype(kind).itemsize
        out.append(np.frombuffer(raw[at : at + step], kind))
        at += step
    return out


def _moved(messages: list[bytes], local: list[np.ndarray], words: int, classes: int, weights: np.ndarray, start: np.ndarray):
    """A shard's words' new classes, those it had (classes: none), and which words training documents have."""
    k = classes + 2
    now, trained, keys, times = np.full(words, classes, np.uint16), np.zeros(words, bool), [], []
    for message, at in zip(messages, local, strict=True):
        had, each, feature, n = _parsed(message)
        now[at] = had & (_TRAINED - 1)
        trained[at] |= had >= _TRAINED
        keys.append(np.repeat(at, each) * (2 * k) + feature)
        times.append(n)
    key, n = np.concatenate([np.zeros(0, np.int64), *keys]), np.concatenate([np.zeros(0, np.uint32), *times])
    order = np.argsort(key)
    key, n = key[order], n[order].astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    n = np.add.reduceat(n, head) if len(head) else n
    key = key[head]
    word, best = best_classes(key // (2 * k), key % (2 * k), n.astype(np.float64), weights, start)
    new = now.copy()
    new[new == classes] = int(np.argmax(start))
    new[word] = best
    return new, now, trained


def score(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    head: int = HEAD,
    classes: int | None = None,
    share: float = SHARE,
    gain: float = GAIN,
    block_bytes: int = BLOCK,
) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score): one row for each of docs'.

    classes: their number, up to 4096, else by the number of distinct words.
    """
    if classes is not None and not 0 < classes <= 4096:
        raise ValueError("classes must be between 1 and 4096")
    spark = docs.sparkSession
    table = tokenised(docs, id_col, text_col, block_bytes)
    shards = shards_for(table, block_bytes)
    ends = int(table.agg(F.sum("train")).first()[0] or 0)
    long, binary, integer = pa.int64(), pa.binary(), pa.int32()

    # 1. counts, and each shard's numbers of its words
    def ask(number, keys, counts):
        keys, n = np.frombuffer(keys.as_py(), np.uint64), np.frombuffer(unzip(counts.as_py()), np.uint32)
        for shard, part in by_shard(shard_of(keys, shards)):
            yield number.as_py(), shard, keys[part].tobytes(), zipped(n[part].tobytes())

    def add(rows: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x.as_py(), np.uint64) for x in rows.column("keys")]
        n = np.concatenate([np.frombuffer(unzip(x.as_py()), np.uint32) for x in rows.column("n")]).astype(np.int64)
        every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(every), np.int64)
        np.add.at(total, inverse, n)
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        bits = [zipped(x.tobytes()) for x in np.split(total[inverse], cuts)]
        local = [zipped(np.diff(x, prepend=0).astype(np.uint32).tobytes()) for x in np.split(inverse, cuts)]
        top = np.lexsort((every, -total))[:head]
        top = top[total[top] > 0]
        shard, none = rows.column("shard")[0].as_py(), [0] * len(bits)
        return pa.table(
            {
                "block": pa.array([*rows.column("block").to_pylist(), -1], long),
                "shard": pa.array([shard] * (len(bits) + 1), integer),
                "bits": pa.array([*bits, None], binary),
                "local": pa.array([*local, None], binary),
                "words": pa.array([len(every)] * (len(bits) + 1), long),
                "distinct": pa.array([*none, int((total > 0).sum())], long),
                "tokens": pa.array([*none, int(total.sum())], long),
                "top": pa.array([[]] * len(bits) + [[{"key": int(k), "n": int(c)} for k, c in zip(every[top].view(np.int64), total[top], strict=True)]], pa.list_(pa.struct({"key": long, "n": long}))),
            }
        )

    asked = table.select("block", "keys", "counts").mapInArrow(lambda b: _rows(b, ask, ["block", "shard", "keys", "n"], [long, integer, binary, binary]), "block long, shard int, keys binary, n binary")
    told = "block long, shard int, bits binary, local binary, words long, distinct long, tokens long, top array<struct<key:bigint,n:bigint>>"
    added = cut_bucketed(asked.repartition(shards, "shard").groupBy("shard").applyInArrow(add, told), "shard", shards, "brown_counts")
    sums = added.filter("block < 0").agg(F.sum("distinct"), F.sum("tokens")).first()
    kinds, tokens = int(sums[0] or 0) + (ends > 0), int(sums[1] or 0) + ends
    if classes is None:
        classes = min(CLASSES, max(2, math.ceil(kinds ** (1 / 3))))
    tops = added.filter("block < 0").select(F.explode("top").alias("t")).select("t.key", "t.n").orderBy(F.desc("n"), "key").limit(head).collect()
    heads = np.sort(np.array([r["key"] for r in tops], np.int64).view(np.uint64))
    m = len(heads)
    rest, end, units = m, m + 1, m + 2

    def unit_of(keys: np.ndarray) -> np.ndarray:
        if not m:
            return np.full(len(keys), rest)
        at = np.minimum(np.searchsorted(heads, keys), m - 1)
        return np.where(heads[at] == keys, at, rest)

    # 2. bigrams of units, in slices of rows; exchange
    wide = 32

    def pairs(batches):
        have = np.zeros((units, units), np.int64)
        for batch in batches:
            for own, keys, codes in zip(*batch.columns, strict=True):
                t = Tokens(own.as_py(), codes.as_py())
                before, u, on = t.bigrams(unit_of(np.frombuffer(keys.as_py(), np.uint64)), end)
                have += np.bincount(before[on] * units + u[on], minlength=units * units).reshape(units, units)
        rows = [(i, zipped(have[i : i + wide].tobytes())) for i in range(0, units, wide) if have[i : i + wide].any()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], integer), pa.array([r[1] for r in rows], binary)], names=["slice", "bits"])

    def total(rows: pa.Table) -> pa.Table:
        have = sum(np.frombuffer(unzip(x.as_py()), np.int64) for x in rows.column("bits"))
        return pa.table({"slice": pa.array([rows.column("slice")[0].as_py()], integer), "bits": pa.array([have.tobytes()], binary)})

    counts = np.zeros((units, units), np.int64)
    slices = table.select("docs", "keys", "codes").mapInArrow(pairs, "slice int, bits binary").groupBy("slice").applyInArrow(total, "slice int, bits binary")
    for r in slices.collect():  # units ** 2 numbers, whatever the input's size
        part = np.frombuffer(r["bits"], np.int64).reshape(-1, units)
        counts[r["slice"] : r["slice"] + len(part)] = part
    of_unit = exchange(counts, m, classes)

    # 3. exchange of all words
    k = classes + 2  # without a class; the end

    def classes_now(keys, got) -> np.ndarray:
        return of_unit[unit_of(np.frombuffer(keys.as_py(), np.uint64))] if got is None else gathered(got, np.uint16).astype(np.int64)

    def class_pairs(now: DataFrame | None) -> np.ndarray:
        """Counts of class pairs in training documents, with the classes that now tells."""

        def count(batches):
            have = np.zeros(k * k, np.int64)
            for batch in batches:
                columns = dict(zip(batch.schema.names, batch.columns, strict=True))
                got = columns.get("classes", [None] * batch.num_rows)
                for own, keys, codes, c in zip(columns["docs"], columns.get("keys", got), columns["codes"], got, strict=True):
                    before, u, on = Tokens(own.as_py(), codes.as_py()).bigrams(classes_now(keys, c), classes + 1)
                    have += np.bincount(before[on] * k + u[on], minlength=k * k)
            at = np.flatnonzero(have)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(have[at])], names=["pair", "n"])

        source = table.select("docs", "keys", "codes") if now is None else now.select("docs", "codes", "classes")
        out = np.zeros(k * k)
        for r in source.mapInArrow(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # k ** 2 rows
            out[r["pair"]] = r["n"]
        return out.reshape(k, k)

    def exchanged(now: DataFrame | None, seen: np.ndarray) -> DataFrame:
        """(block, shard, bits, types): the words' classes after one round; types: of block -1, distinct words by class."""
        weights, start = weights_of(seen, classes)
        names = ["block", "docs", "keys", "codes"] + ([] if now is None else ["classes"])

        def vote(number, own, keys, codes, got=None):
            t = Tokens(own.as_py(), codes.as_py())
            for shard, message in _votes(t, np.frombuffer(keys.as_py(), np.uint64), classes_now(keys, got), classes, got is None, shards):
                yield number.as_py(), shard, message

        def choose(left: pa.Table, right: pa.Table) -> pa.Table:
            local = {b.as_py(): np.cumsum(np.frombuffer(unzip(x.as_py()), np.uint32), dtype=np.int64) for b, x in zip(right.column("block"), right.column("local"), strict=True)}
            blocks = left.column("block").to_pylist()
            new, _, trained = _moved([x.as_py() for x in left.column("votes")], [local[b] for b in blocks], right.column("words")[0].as_py(), classes, weights, start)
            types = np.bincount(new[trained], minlength=classes)
            n = len(local)
            return pa.table(
                {
                    "block": pa.array([*local, -1], long),
                    "shard": pa.array([left.column("shard")[0].as_py()] * (n + 1), integer),
                    "bits": pa.array([*(zipped(new[at].tobytes()) for at in local.values()), None], binary),
                    "types": pa.array([*[None] * n, types.tolist()], pa.list_(long)),
                }
            )

        sent = (table if now is None else now).select(*names)
        sent = sent.mapInArrow(lambda b: _rows(b, vote, ["block", "shard", "votes"], [long, integer, binary]), "block long, shard int, votes binary")
        to = added.filter("block >= 0").select("block", "shard", "local", "words").groupBy("shard")
        new = sent.groupBy("shard").cogroup(to).applyInArrow(choose, "block long, shard int, bits binary, types array<long>")
        return cut(new, "brown-classes")

    def told_by(chosen: DataFrame) -> DataFrame:
        return with_answers(table, chosen.filter("block >= 0").select("block", "shard", "bits"), "classes")

    chosen = exchanged(None, class_pairs(None))
    both = told_by(chosen)
    table_now = class_pairs(both)
    while tokens:
        after = exchanged(both, table_now)
        table_after = class_pairs(told_by(after))
        had, has = information(table_now), information(table_after)
        if has > had:
            drop(chosen)
            chosen, both, table_now = after, told_by(after), table_after
        if has <= had * (1 + gain):
            break

    # 4. scores
    stop = classes  # the end is the last class
    bigram = np.delete(np.delete(table_now, classes, 0), classes, 1)
    kinds_of = np.zeros(classes + 1)
    types = chosen.filter("block < 0").select(F.posexplode("types").alias("c", "n")).groupBy("c").agg(F.sum("n").alias("n"))
    for r in types.collect():
        kinds_of[r["c"]] = r["n"]
    k = classes + 1
    in_class = bigram.sum(axis=0)
    shares = (in_class + 0.5) / (in_class + 0.5).sum()
    move = (bigram + shares) / (bigram.sum(axis=1, keepdims=True) + 1)
    move = np.concatenate([move, shares[None]])  # after an unseen word
    mass = in_class + 0.5 * (kinds_of + 1)  # of a class: its words, and one unseen
    unseen = move[:, :stop] @ (0.5 / mass[:stop])
    floor = tokens + 0.5 * (kinds + 1)

    def results(batches):
        for batch in batches:
            for own, codes, n_bits, c_bits in zip(*batch.columns, strict=True):
                t = Tokens(own.as_py(), codes.as_py())
                n, first = t.with_ends(gathered(n_bits, np.int64), ends)
                c, _ = t.with_ends(gathered(c_bits, np.uint16).astype(np.int64), stop)
                c = np.where(n > 0, c, k)  # k: unseen
                flat = (n + 0.5) / floor
                is_end = np.zeros(len(n), bool)
                is_end[first[1:] - 1] = True
                c = np.where(is_end, stop, c)
                before = np.concatenate([[stop], c[:-1]])
                safe = np.minimum(c, stop)
                emit = np.where(c == stop, 1.0, (n + 0.5) / mass[safe])
                p = np.where(c == k, unseen[before], move[before, safe] * emit)
                logs = np.log10(share * p + (1 - share) * flat)
                known_ = (n > 0).astype(np.int64)
                at = first[:-1]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(t.ids, long, mask=t.null),
                        pa.array(t.out),
                        pa.array(np.diff(first), long),
                        pa.array(np.add.reduceat(known_, at), long),
                        pa.array(np.full(len(t.ids), tokens), long),
                        pa.array(np.add.reduceat(np.log10(flat), at)),
                        pa.array(np.add.reduceat(logs, at)),
                    ],
                    names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    known = with_answers(table.select("block", "docs", "codes"), added.filter("block >= 0").select("block", "shard", "bits"), "known")
    known = with_answers(known, chosen.filter("block >= 0").select("block", "shard", "bits"), "classes")
    out = known.select("docs", "codes", "known", "classes")
    out = out.mapInArrow(results, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)


def perplexity(scores: DataFrame, column: str = "score") -> float:
    """Of the held-out texts."""
    s, n = scores.filter("held_out").agg(F.sum(column), F.sum("n_tokens")).first()
    return math.pow(10, -s / n)


def op7_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(load(spark, sf_dir, "documents"))


QUERIES = {"op7_brown_lm": op7_brown_lm}
SQL: dict[str, str] = {}

"""Removal of passages that occur earlier in the corpus, by FM-indexes over content-addressed shards.

A window is `threshold` consecutive words. Every window has a minimizer, the smallest hash of its short word
sequences; consecutive windows with one minimizer form a segment. Equal windows have equal minimizers, so they meet in
the shard that the minimizer names.

1. Each block of documents asks, for its distinct minimizers, whether another segment of the corpus has them, and whether
   they are hot: more than HOT different segments have them, as those around a common phrase do.
2. For those that do, it sends its distinct segments (words and earliest place) to their shards. Segments of hot
   minimizers are cut into their windows, each of which goes to the shard that its own hash names, so that none but equal
   windows meet by force.
3. Each shard builds a compressed FM-index over its distinct segments, streams them through it by backward search, and
   so gets the suffix interval of every window; the earliest start within that interval says which windows start
   earlier elsewhere. It answers one bit a window.
4. Each block applies the bits to all its occurrences and joins the words that are kept.

A segment that a third of all documents have comes once from each block, so no shard sees its copies. The number of shards
grows with the number of blocks.

Documents are ordered by id (null ids last), then by a hash of the text. Rows with the same id and text are one
document, and all get its result. Null texts count as empty; nothing is removed from texts with fewer words than the
threshold. Columns that are added replace columns of the same name; an empty table gives an empty table. Words are
compared by 64-bit hashes: a wrong removal takes two windows whose words differ while all their hashes agree in order.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Block, answers_of, bits_of, blocks, by_shard, cut, flags_of, load, mix, shards_for, span_hash, unzip, with_answers, zipped
from .fm_index import FMIndex

THRESHOLD = 20
#: different segments of one minimizer that a shard takes whole: about 260,000 words, a twentieth of what a shard holds
HOT = 8192
_GRAM = 8


def _sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        a = np.minimum(a[:-have], a[have:])
        have *= 2
    return np.minimum(a[: len(a) - (width - have)], a[width - have :]) if width > have else a


class Segments:
    """A block's segments: first window, number of windows, minimizer, and the asks for the minimizers."""

    def __init__(self, block: Block, threshold: int, shards: int):
        self.threshold = threshold
        self.words, self.s, self.e, self.first = block.words()
        n, gram = len(self.words), min(_GRAM, threshold)
        if n < threshold:
            empty = np.zeros(0, np.int64)
            self.start, self.count, self.key = empty, empty, np.zeros(0, np.uint64)
            again = np.zeros(0, bool)
        else:
            at = np.arange(n - gram + 1)
            grams, width = span_hash(self.words, at, at + gram), threshold - gram + 1
            least = _sliding_min(grams, width)
            inside = np.zeros(n + 1, np.int32)  # windows that lie within one document
            lens = np.diff(self.first)
            has = lens >= threshold
            np.add.at(inside, self.first[:-1][has], 1)
            np.add.at(inside, self.first[1:][has] - threshold + 1, -1)
            at = np.flatnonzero(np.cumsum(inside[: len(least)]))
            least = least[at]
            opens = np.ones(len(at), bool)
            opens[1:] = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)
            # documents follow one another without a gap only if the first has no window behind its last one
            opens |= np.isin(at, self.first[:-1])
            begin = np.flatnonzero(opens)
            self.start, self.count, self.key = at[begin], np.diff(np.append(begin, len(at))), least[begin]
            # a segment may hold equal windows itself: then a word sequence recurs in it
            recurs = np.zeros(len(grams) + 1, np.int64)
            for d in range(1, min(width, len(grams))):
                recurs[1:-d] |= grams[:-d] == grams[d:]
            np.cumsum(recurs, out=recurs)
            again = (self.count > width) | (recurs[self.start + self.count + width - 1] > recurs[self.start])
        self.content = span_hash(self.words, self.start, self.start + self.count + threshold - 1)
        keys, self.inverse, times = np.unique(self.key, return_inverse=True, return_counts=True)
        times[self.inverse[again]] += 1
        different = np.bincount(self.inverse[np.unique(self.content, return_index=True)[1]], minlength=len(keys))
        shard = self._shard(keys, shards)
        order = np.argsort(shard, kind="stable")
        self.keys, self.twice, self.shard = keys[order], times[order] > 1, shard[order]
        self.different = np.minimum(different[order], 0xFFFF).astype(np.uint16)
        self.where = np.empty(len(order), np.int64)
        self.where[order] = np.arange(len(order))

    @staticmethod
    def _shard(keys, shards):
        return (mix(keys ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(shards)).astype(np.int64)

    def asks(self):
        for shard, part in by_shard(self.shard):
            yield shard, self.keys[part].tobytes(), bits_of(self.twice[part]), zipped(self.different[part].tobytes())

    def choose(self, answers: dict[int, bytes], shards: int) -> None:
        """Keeps the segments whose minimizers are had elsewhere, those of hot ones window by window, and finds the
        distinct ones."""
        known, hot = np.zeros(len(self.keys), bool), np.zeros(len(self.keys), bool)
        for shard, part in by_shard(self.shard):
            if shard in answers:
                n = part.stop - part.start
                known[part], hot[part] = flags_of(answers[shard], 2 * n).reshape(2, n)
        at = self.where[self.inverse] if len(self.key) else np.zeros(0, np.int64)
        on, cut_ = known[at] & ~hot[at], known[at] & hot[at]
        w = self.count[cut_]
        window = np.repeat(self.start[cut_], w) + np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
        name = span_hash(self.words, window, window + self.threshold)
        key, content = np.concatenate([self.key[on], name]), np.concatenate([self.content[on], name])
        self.start = np.concatenate([self.start[on], window])
        self.count = np.concatenate([self.count[on], np.ones(len(window), np.int64)])
        self.content, first, self.of = np.unique(content, return_index=True, return_inverse=True)
        shard = self._shard(key[first], shards)
        order = np.argsort(shard, kind="stable")
        self.content, self.home, self.head = self.content[order], shard[order], first[order]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.of = back[self.of]

    def place(self, block: Block, at: np.ndarray):
        """Document and position of a word index."""
        doc = np.searchsorted(self.first, at, "right") - 1
        return doc, at - self.first[doc]


def _known(keys: list[np.ndarray], twice: list[np.ndarray], different: list[np.ndarray], most: int) -> list[bytes]:
    """For each block's minimizers, a bit whether another segment has them, and then a bit whether they are hot."""
    every, of = np.unique(np.concatenate(keys), return_inverse=True)
    asks, sums = np.bincount(of, minlength=len(every)), np.zeros(len(every), np.int64)
    np.add.at(sums, of, np.concatenate(different).astype(np.int64))
    hit = (asks[of] > 1) | np.concatenate(twice)
    hot = sums[of] > most
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    return [bits_of(np.concatenate(x)) for x in zip(np.split(hit, cuts), np.split(hot, cuts), strict=True)]


def _send(block: Block, seg: Segments, number: int):
    """Rows for the shards: a block's distinct segments."""
    doc, pos = seg.place(block, seg.start[seg.head])
    length = (seg.count + seg.threshold - 1)[seg.head]
    for shard, part in by_shard(seg.home):
        n = part.stop - part.start
        a, k = seg.start[seg.head][part], length[part]
        at = np.repeat(a - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum())
        own, inverse = np.unique(seg.words[at], return_inverse=True)
        d = doc[part]
        code = inverse.astype(np.uint16 if len(own) <= 1 << 16 else np.uint32)
        head = np.array([n, len(own), code.itemsize], np.int64)
        parts = (head, seg.content[part], block.ids[d], block.tie[d], pos[part].astype(np.uint32), k.astype(np.uint32), own, code)
        yield number, shard, zipped(b"".join(p.tobytes() for p in parts))


def _received(blob: bytes):
    raw = memoryview(unzip(blob))
    n, v, size = (int(x) for x in np.frombuffer(raw[:24], np.int64))
    out, at = [], 24
    for kind, count in ((np.uint64, n), (np.int64, n), (np.uint64, n), (np.uint32, n), (np.uint32, n), (np.uint64, v)):
        step = count * np.dtype(kind).itemsize
        out.append(np.frombuffer(raw[at : at + step], kind))
        at += step
    code = np.frombuffer(raw[at:], np.uint16 if size == 2 else np.uint32)
    content, ids, tie, pos, length, own = out
    return content, ids, tie, pos.astype(np.int64), length.astype(np.int64), own[code]


def _earlier(blobs: list[bytes], threshold: int) -> list[bytes]:
    """For each block's segments, a bit for each window: it starts earlier elsewhere."""
    got = [_received(b) for b in blobs]
    content, ids, tie, pos, length = (np.concatenate([g[i] for g in got]) for i in range(5))
    first_word = np.cumsum(length) - length
    words = np.concatenate([g[5] for g in got])
    # documents in order, as numbers
    order = np.lexsort((tie, ids, tie >> np.uint64(32)))
    change = np.concatenate([[False], (ids[order][1:] != ids[order][:-1]) | (tie[order][1:] != tie[order][:-1])])
    doc = np.empty(len(ids), np.int64)
    doc[order] = np.cumsum(change)
    place = doc << 32 | pos
    by = np.lexsort((place, content))
    head = np.concatenate([[True], content[by][1:] != content[by][:-1]])
    segment = np.empty(len(by), np.int64)
    segment[by] = np.cumsum(head) - 1
    one = by[head]  # each distinct segment's earliest
    k = length[one]
    at = np.repeat(first_word[one] - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum())
    index = FMIndex(words[at], k, threshold)
    found, offset, group = index.matches(words[at], k)
    # earliest start of each group of windows
    least = np.full(len(index.group_start) - 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, place[one][found] + offset)
    windows = k - threshold + 1
    base = np.concatenate([[0], np.cumsum(windows)])
    earliest = np.empty(base[-1], np.int64)
    earliest[base[found] + offset] = least[group]
    out, i = [], 0
    for g in got:
        n = len(g[0])
        s = segment[i : i + n]
        w = windows[s]
        shift = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
        out.append(bits_of(np.repeat(place[i : i + n], w) + shift > earliest[np.repeat(base[s], w) + shift]))
        i += n
    return out


def _removed(block: Block, seg: Segments, answers: dict[int, bytes]) -> np.ndarray:
    """Which words of the block go."""
    n = len(seg.words)
    gone = np.zeros(n + 1, np.int32)
    if len(seg.head):
        windows = seg.count[seg.head]
        base = np.concatenate([[0], np.cumsum(windows)])
        bits = np.zeros(base[-1], bool)
        for shard, part in by_shard(seg.home):
            a, b = base[part.start], base[part.stop]
            bits[a:b] = flags_of(answers[shard], b - a)
        doc, pos = seg.place(block, seg.start)
        row = np.concatenate([[0], np.cumsum((block.ids[1:] != block.ids[:-1]) | (block.tie[1:] != block.tie[:-1]))])
        same = (row[doc] == row[doc[seg.head]][seg.of]) & (pos == pos[seg.head][seg.of])  # repeated rows are one document
        w = seg.count
        shift = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
        go = bits[np.repeat(base[seg.of], w) + shift] | np.repeat(~same, w)
        at = (np.repeat(seg.start, w) + shift)[go]
        np.add.at(gone, at, 1)
        np.add.at(gone, at + seg.threshold, -1)
    return np.cumsum(gone[:n]) > 0


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, hot: int = HOT, block_bytes: int = 4 << 20, untouched: bool = False) -> DataFrame:
    """(id_col, tie, n_words, n_removed, kept_text, spans): one row for each of docs'.

    tie is the text's crc32. spans are the removed stretches, as word positions [first, last + 1); kept_text is the other
    words joined by one space. With untouched, texts of which nothing is removed are returned as they are.
    """
    spark = docs.sparkSession
    table = blocks(docs, id_col, text_col, block_bytes, "substring")
    shards = shards_for(table, block_bytes)
    binary = lambda values: pa.array(values, pa.binary())

    def ask(batches):
        for batch in batches:
            for number, payload in zip(batch.column("block").to_pylist(), batch.column("payload"), strict=True):
                rows = list(Segments(Block(payload.as_py()), threshold, shards).asks())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int32()), pa.array([number] * len(rows), pa.int64()), *(binary([r[i] for r in rows]) for i in (1, 2, 3))],
                    names=["shard", "block", "keys", "twice", "different"],
                )

    def known(rows: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x.as_py(), np.uint64) for x in rows.column("keys")]
        twice = [flags_of(x.as_py(), len(k)) for x, k in zip(rows.column("twice"), keys, strict=True)]
        different = [np.frombuffer(unzip(x.as_py()), np.uint16) for x in rows.column("different")]
        return pa.table({"block": rows.column("block"), "shard": rows.column("shard"), "bits": binary(_known(keys, twice, different, hot))})

    asked = table.select("block", "payload").mapInArrow(ask, "shard int, block long, keys binary, twice binary, different binary")
    answer = "block long, shard int, bits binary"
    chosen = cut(asked.repartition(shards, "shard").groupBy("shard").applyInArrow(known, answer), "substring-known")

    def send(batches):
        for batch in batches:
            for number, payload, got in zip(batch.column("block").to_pylist(), batch.column("payload"), batch.column("known"), strict=True):
                block = Block(payload.as_py())
                seg = Segments(block, threshold, shards)
                seg.choose(answers_of(got), shards)
                rows = list(_send(block, seg, number))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), binary([r[2] for r in rows])],
                    names=["block", "shard", "segments"],
                )

    def search(rows: pa.Table) -> pa.Table:
        bits = _earlier([x.as_py() for x in rows.column("segments")], threshold)
        return pa.table({"block": rows.column("block"), "shard": rows.column("shard"), "bits": binary(bits)})

    first = with_answers(table.select("block", "payload"), chosen, "known")
    sent = first.mapInArrow(send, "block long, shard int, segments binary")
    found = cut(sent.repartition(shards, "shard").groupBy("shard").applyInArrow(search, answer), "substring-found")
    both = with_answers(first, found, "found")

    def apply(batches):
        for batch in batches:
            cols = (batch.column(x) for x in ("payload", "known", "found"))
            for payload, got, bits in zip(*cols, strict=True):
                block = Block(payload.as_py())
                seg = Segments(block, threshold, shards)
                seg.choose(answers_of(got), shards)
                yield from _results(block, seg, _removed(block, seg, answers_of(bits)), untouched)

    out = both.mapInArrow(apply, "id long, tie long, n_words long, n_removed long, kept_text string, spans array<struct<first:int,end:int>>")
    return out.withColumnRenamed("id", id_col)


def _results(block: Block, seg: Segments, gone: np.ndarray, untouched: bool, step: int = 1024):
    keep = ~gone
    total = np.concatenate([[0], np.cumsum(gone)])
    for a in range(0, block.n, step):
        b = min(block.n, a + step)
        texts, spans, offsets = [], [], [0]
        lens = np.diff(seg.first[a : b + 1])
        removed = total[seg.first[a + 1 : b + 1]] - total[seg.first[a:b]]
        for i in range(a, b):
            text = block.text(i)
            words = text.split()
            if removed[i - a]:
                lo, hi = seg.first[i], seg.first[i + 1]
                words = compress(words, keep[lo:hi].tolist())
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[lo:hi].view(np.int8), [0]])))
                spans.append(edge.astype(np.int32))
                offsets.append(offsets[-1] + len(edge) // 2)
            else:
                offsets.append(offsets[-1])
            texts.append(text if untouched and not removed[i - a] else b" ".join(words))
        edges = np.concatenate(spans) if spans else np.zeros(0, np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(edges[::2]), pa.array(edges[1::2])], names=["first", "end"])
        ids = pa.array(block.ids[a:b], pa.int64(), mask=block.null_id()[a:b])
        tie = pa.array((block.tie[a:b] & np.uint64(0xFFFFFFFF)).astype(np.int64))
        yield pa.RecordBatch.from_arrays(
            [ids, tie, pa.array(lens, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)],
            names=["id", "tie", "n_words", "n_removed", "kept_text", "spans"],
        )


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


QUERIES = {"op1_substring_dedup": op1_substring_dedup}
SQL = {
    "op1_substring_dedup": """
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
v AS (SELECT doc_id, i, array_to_string(words[i:i + 19], ' ') AS k FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM v),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS place FROM f WHERE r > 1),
each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS text, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, place) GROUP BY 1)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""
}

"""What several operators share: words as numpy arrays, blocks of documents, and written cuts.

Words are the maximal runs of characters other than space and U+0009..U+000D. A word is handled as a 64-bit hash of its
UTF-8 bytes, so that a batch of texts becomes one flat array without a Python loop over words.

A *block* is a few MB of documents, packed by zstd into one binary value. Operators that need answers from the
whole corpus (is this fingerprint known elsewhere? how often does this word occur?) let each block ask every shard
once, for its distinct items only. A group of copies, however large, thus sends one item per block to its shard, and
what is shuffled is compact binary columns.
"""

from __future__ import annotations

import tempfile
import uuid
import zlib
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
NULL_ID = np.int64(2**63 - 1)
SPAN = 16
_FULL = np.uint64((1 << 64) - 1)
_ODD, _STEP_ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_KEEP = 1 << 21
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


# ---------------------------------------------------------------- cuts

_made: ContextVar[list | None] = ContextVar("made", default=None)


@contextmanager
def scope():
    """Lists what cut() and cut_bucketed() write within it, in this thread: drop(*made) removes it, once results that read
    it are written."""
    made: list[DataFrame] = []
    token = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(token)


def _noted(df: DataFrame) -> DataFrame:
    if (made := _made.get()) is not None:
        made.append(df)
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in local mode a temporary one where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """df written as a Parquet table in the shared folder and read again: later stages do not recompute it."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out.cut_at = at
    return _noted(out)


def cut_bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """Like cut, as a table bucketed by key: joins and groupings by key then leave this side where it is."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    at = f"{shared_dir(spark)}/{table}"
    df.write.bucketBy(buckets, key).option("path", at).format("parquet").saveAsTable(table)
    out = spark.table(table)
    out.cut_at, out.cut_table = at, table
    return _noted(out)


def drop(*cuts: DataFrame) -> None:
    """Deletes what cut() or cut_bucketed() wrote, once nothing reads it any more."""
    for df in cuts:
        spark = df.sparkSession
        if table := vars(df).pop("cut_table", None):
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        if at := vars(df).pop("cut_at", None):
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shards_of(spark: SparkSession) -> int:
    """How many shards answer: spark.sql.shuffle.partitions, which a cluster sets by the size of its input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shards_for(table: DataFrame, block_bytes: int, most: int = 32 << 20) -> int:
    """How many shards answer the blocks of a written table: spark.sql.shuffle.partitions, or more, so that a shard's part
    comes from about `most` bytes of text."""
    return max(shards_of(table.sparkSession), -(-table.count() * block_bytes // most))


# ---------------------------------------------------------------- words


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 12), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= _KEEP:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """A 64-bit hash of values[s:e] for every span; equal contents give equal hashes wherever they stand.

    Polynomials modulo 2**64 are only used over SPAN values, as long sequences of two values collide whatever the base: a
    longer span is the sum of its stretches' hashes, each mixed with its number.
    """
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(base, n), out=sums[1:])
    inverse = powers(pow(base, -1, 1 << 64), n + 1)

    def short(s, e):
        return mix((sums[e] - sums[s]) * inverse[s])

    lens = ends - starts
    out = short(starts, np.minimum(ends, starts + SPAN))
    long = np.flatnonzero(lens > SPAN)
    if len(long):
        times = -(-lens[long] // SPAN)
        first = np.cumsum(times) - times
        k = np.arange(times.sum()) - np.repeat(first, times)
        s = np.repeat(starts[long], times) + k * SPAN
        parts = mix(short(s, np.minimum(s + SPAN, np.repeat(ends[long], times))) + k.astype(np.uint64) * _ODD)
        out[long] = mix(np.add.reduceat(parts, first) ^ lens[long].astype(np.uint64) * _ODD)
    return out


def text_column(col) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = col.buffers()
    off = np.frombuffer(buffers[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(buffers[2], np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word; documents do not run together."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    letter = ~_SPACE[data]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    start = letter.copy()
    start[1:] &= ~letter[:-1]
    start[inner] = letter[inner]
    end = letter.copy()
    end[:-1] &= ~letter[1:]
    end[inner - 1] = letter[inner - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 15) -> np.ndarray:
    """64-bit hash of each word: of its bytes, eight at a time, each eight mixed with their number, and of its length."""
    eights = np.zeros(len(data) // 8 + 2, np.uint64)
    eights.view(np.uint8)[: len(data)] = data
    out = np.empty(len(starts), np.uint64)
    for a in range(0, len(out), step):  # portions that stay in the processor's cache
        out[a : a + step] = _hash_words(eights, starts[a : a + step], ends[a : a + step])
    return out


def _load(eights: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n bytes (1 to 8) from each place, the rest zero."""
    low, bit = at >> 3, (at & 7).astype(np.uint64) << np.uint64(3)
    # a shift by 64 is one by 63 and one more
    got = (eights[low] >> bit) | (eights[low + 1] << (np.uint64(63) - bit) << np.uint64(1))
    return got & (_FULL >> ((8 - n).astype(np.uint64) << np.uint64(3)))


def _hash_words(eights: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    lens = ends - starts
    out = mix(_load(eights, starts, np.minimum(lens, 8)) * _ODD + np.uint64(1))
    long = np.flatnonzero(lens > 8)
    if len(long):
        times = (lens[long] - 1) >> 3
        first = np.cumsum(times) - times
        k = np.arange(times.sum()) - np.repeat(first, times) + 1
        at = np.repeat(starts[long], times) + (k << 3)
        more = _load(eights, at, np.minimum(np.repeat(ends[long], times) - at, 8))
        out[long] += np.add.reduceat(mix(more * _ODD + (k << 1 | 1).astype(np.uint64) * _STEP_ODD), first)
    return mix(out ^ lens.astype(np.uint64) * _STEP_ODD)


# ---------------------------------------------------------------- blocks


class Block:
    """Documents of one block, in the order of (null ids last, id, hash of the text)."""

    def __init__(self, payload: bytes):
        raw = memoryview(unzip(payload))
        n = int(np.frombuffer(raw[:8], np.int64)[0])
        at = 8
        self.ids = np.frombuffer(raw[at : at + 8 * n], np.int64)
        at += 8 * n
        self.tie = np.frombuffer(raw[at : at + 8 * n], np.uint64)  # 2**32 set: the id is null; below: hash of the text
        at += 8 * n
        self.off = np.frombuffer(raw[at : at + 8 * (n + 1)], np.int64)
        at += 8 * (n + 1)
        self.data = np.frombuffer(raw[at:], np.uint8)
        self.n = n

    def null_id(self) -> np.ndarray:
        return self.tie >> np.uint64(32) != 0

    def text(self, i: int) -> bytes:
        return self.data[self.off[i] : self.off[i + 1]].tobytes()

    def words(self, data: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash, start and end of each word, and for each document the index of its first word (one more at the end)."""
        s, e = word_bounds(self.data, self.off)
        return word_hashes(self.data if data is None else data, s, e), s, e, np.searchsorted(s, self.off)


def zipped(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unzip(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)


def packed(ids, col, most: int):
    """(documents, payload) of blocks of about `most` bytes of text, from an id and a string column."""
    data, off = text_column(col)
    null = np.asarray(ids.is_null())
    key = np.asarray(pc.fill_null(ids, int(NULL_ID)).cast(pa.int64()))
    a, n = 0, len(key)
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        tie = np.fromiter((zlib.crc32(data[off[i] : off[i + 1]]) for i in range(a, b)), np.uint64, b - a)
        tie |= null[a:b].astype(np.uint64) << np.uint64(32)
        order = np.lexsort((tie, key[a:b], null[a:b]))
        lens = (off[a + 1 : b + 1] - off[a:b])[order]
        head = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
        body = b"".join(data[off[a + i] : off[a + i + 1]].tobytes() for i in order)
        yield b - a, zipped(np.int64(b - a).tobytes() + key[a:b][order].tobytes() + tie[order].tobytes() + head.tobytes() + body)
        a = b


def blocks(docs: DataFrame, id_col: str, text_col: str, most: int = 4 << 20, name: str = "blocks") -> DataFrame:
    """docs as blocks (block, n, payload), written to the shared folder and bucketed by block.

    A block's number is made of the task and a count within it; as the table is written once, later stages see
    the same numbers whatever executors are lost.
    """

    def pack(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for n, payload in packed(batch.column(0), batch.column(1), most):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.array([n], pa.int32()), pa.array([payload], pa.binary())],
                    names=["block", "n", "payload"],
                )
                number += 1

    spark = docs.sparkSession
    df = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return cut_bucketed(df.mapInArrow(pack, "block long, n int, payload binary"), "block", max(1, shards_of(spark)), name)


def with_answers(table: DataFrame, answers: DataFrame, name: str) -> DataFrame:
    """The blocks, each with its answers: array<struct<shard, bits>>, at most one of each shard. The blocks stay in place."""
    got = answers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("shard", "bits"))).alias(name))
    return table.join(got, "block", "left")


def answers_of(scalar) -> dict[int, bytes]:
    """One row's answers: shard to bits."""
    return {x["shard"]: x["bits"] for x in scalar.as_py() or ()}


def table_of(batches_or_table, *names):
    """The named columns of every row, as Arrow scalars."""
    cols = [batches_or_table.column(x) for x in names]
    return zip(*cols, strict=True)


def bits_of(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def flags_of(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)


def by_shard(shard: np.ndarray):
    """(shard, slice) for each run of an array that is sorted by shard."""
    if len(shard):
        cuts = np.flatnonzero(np.diff(shard)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(shard)], strict=True):
            yield int(shard[a]), slice(int(a), int(b))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""Files read by offset: images and archives of any size, on local disks or shared stores, a few MiB at a time.

`spark.read.format("ranges")` gives a file's bytes as rows (image, off, data) of CHUNK bytes; a task reads a run of them, so
a file is as many tasks as it has runs, and a lost executor costs its runs only. Metadata is read by small kernels through
Pages, a cache of few pages. Paths are URIs that pyarrow.fs opens (file, s3, gs, hdfs) or absolute ones. Null paths and
empty tables give no rows; an empty file has no chunks.
"""

from __future__ import annotations

import zlib
from collections import OrderedDict
from collections.abc import Iterator
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import filesystems, images
from .images import CHUNK, need

RUN = 128 * CHUNK
RANGES = "image string, off long, data binary"


def opened(path: str) -> pa.NativeFile:
    store, at = fs.FileSystem.from_uri(path)
    return store.open_input_file(at)


def listed(path: str) -> list[tuple[str, int]]:
    """(URI, size) of a file, of a folder's files, or of those that fit a glob in the last part, in order."""
    scheme = path.split("://", 1)[0] + "://" if "://" in path else ""
    folder, _, last = path.rpartition("/")
    if any(c in last for c in "*?["):
        store, at = fs.FileSystem.from_uri(folder)
        found = [i for i in store.get_file_info(fs.FileSelector(at)) if fnmatchcase(i.base_name, last)]
    else:
        store, at = fs.FileSystem.from_uri(path)
        info = store.get_file_info(at)
        found = store.get_file_info(fs.FileSelector(at)) if info.type == fs.FileType.Directory else [info]
    files = sorted((scheme + i.path if scheme else i.path, i.size) for i in found if i.type == fs.FileType.File and not i.base_name.startswith(("_", ".")))
    need(files, f"no file at {path}")
    return files


class Pages:
    """read(offset, size) of an open file through its last used pages; bytes behind its end are missing."""

    def __init__(self, file: pa.NativeFile, page: int = 1 << 16, most: int = 16):
        self.file, self.page, self.most, self.size = file, page, most, file.size()
        self.have: OrderedDict[int, bytes] = OrderedDict()

    def _page(self, k: int) -> bytes:
        if k not in self.have:
            self.have[k] = self.file.read_at(min(self.page, max(0, self.size - k * self.page)), k * self.page)
            if len(self.have) > self.most:
                self.have.popitem(last=False)
        self.have.move_to_end(k)
        return self.have[k]

    def __call__(self, at: int, size: int) -> bytes:
        size = min(size, max(0, self.size - at))
        if size > self.page * self.most:
            return self.file.read_at(size, at)
        whole = b"".join(self._page(k) for k in range(at // self.page, -(-(at + size) // self.page)))
        return whole[at % self.page : at % self.page + size]


class _Run(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__(path)
        self.path, self.start, self.end = path, start, end


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        runs = [_Run(p, a, min(size, a + RUN)) for p, size in listed(self.path) for a in range(0, size, RUN)]
        return runs or [_Run("", 0, 0)]

    def read(self, partition):
        if partition.start == partition.end:
            return
        with opened(partition.path) as f:
            for at in range(partition.start, partition.end, CHUNK):
                data = f.read_at(min(CHUNK, partition.end - at), at)
                need(len(data) == min(CHUNK, partition.end - at), f"{partition.path}: file is cut short")
                yield pa.RecordBatch.from_arrays([pa.array([partition.path]), pa.array([at], pa.int64()), pa.array([data], pa.binary())], names=["image", "off", "data"])


class Ranges(DataSource):
    @classmethod
    def name(cls):
        return "ranges"

    def schema(self):
        return RANGES

    def reader(self, schema):
        return _Reader(self.options["path"])


def ranges(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(Ranges)
    return spark.read.format("ranges").load(path)


def _rows(paths: DataFrame, schema: str, rows_of, most: int = 4096) -> DataFrame:
    """What rows_of(path, open file) yields for each path, as dicts, in batches of at most `most` rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                if path is None:
                    continue
                with opened(path) as f:
                    some: list[dict] = []
                    for row in rows_of(path, f):
                        some.append(row)
                        if len(some) == most:
                            yield pa.RecordBatch.from_pylist(some, schema=arrow)
                            some = []
                    yield pa.RecordBatch.from_pylist(some, schema=arrow)

    return paths.select(F.col("path").cast("string")).mapInArrow(run, schema)


# ---------------------------------------------------------------- images


def sparse_map(paths: DataFrame) -> DataFrame:
    """(image, target, size, kind, source, fill): the pieces of sparse images by their headers alone; source is where a raw
    piece's bytes are in the file. Structure is checked, checksums are not: they need all bytes."""

    def pieces(path, f):
        read = Pages(f)
        for target, size, kind, source, n in images.sparse_headers(read, read.size):
            if kind in (images.RAW, images.FILL):
                yield {"image": path, "target": target, "size": size, "kind": kind, "source": source, "fill": read(source, n) if kind == images.FILL else None}

    return _rows(paths, "image string, target long, size long, kind int, source long, fill binary", pieces)


def sparse_chunks(paths: DataFrame, chunks: DataFrame) -> DataFrame:
    """(image, off, data): content of sparse images whose files' bytes are `chunks`; pieces of at most CHUNK bytes, holes left out."""
    pieces = sparse_map(paths)
    raw = pieces.filter(F.col("kind") == images.RAW).withColumn("hole", F.lit(False))
    copied = images.copy_extents(raw, chunks, ["image"], ["image"])
    fills = pieces.filter((F.col("kind") == images.FILL) & (F.hex("fill") != "00000000") & (F.col("size") > 0))
    starts = fills.select("image", "target", "size", "fill", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(CHUNK).cast("long"))).alias("a"))
    words = F.least(F.lit(CHUNK).cast("long"), F.col("size") - F.col("a")) / 4
    filled = starts.select("image", (F.col("target") + F.col("a")).alias("off"), F.unhex(F.repeat(F.hex("fill"), words.cast("int"))).alias("data"))
    return copied.unionByName(filled)


def filesystem_tables(paths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """filesystems.tables() of images that are read by offset, in batches, so that an image's rows are never all at hand."""
    every = _rows(paths, filesystems.ROW, lambda path, f: filesystems.walk(path, Pages(f)), 256)
    return filesystems.split_rows(every)


# ---------------------------------------------------------------- ZIP members


def _inflated(f: pa.NativeFile, at: int, size: int) -> Iterator[bytes]:
    """Pieces of at most CHUNK bytes of a raw DEFLATE stream."""
    decoder, end, left, held = zlib.decompressobj(-15), at + size, b"", bytearray()
    while not decoder.eof:
        if not left and at < end:
            left = f.read_at(min(CHUNK, end - at), at)
            at += len(left)
        before = len(held)
        held += decoder.decompress(left, CHUNK - len(held))
        left = decoder.unconsumed_tail
        if len(held) == CHUNK:
            yield bytes(held)
            held.clear()
        else:
            need(left or at < end or decoder.eof or len(held) > before, "DEFLATE stream is cut short")
    if held:
        yield bytes(held)


def member_ranges(entries: DataFrame, size: int = RUN) -> DataFrame:
    """What tasks read of ZIP entries (archive, name, size, compressed_size, crc32, method, header_offset): ranges
    (start, end) of stored ones, deflated ones whole."""
    stored = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(size).cast("long"))
    starts = F.when(F.col("method") == 0, stored).otherwise(F.array(F.lit(0).cast("long")))
    cut = entries.withColumn("start", F.explode(starts))
    return cut.withColumn("end", F.when(F.col("method") == 0, F.least("size", F.col("start") + size)).otherwise(F.col("size")))


def member_chunks(entries: DataFrame, size: int = RUN) -> DataFrame:
    """(archive, name, off, data): the bytes of ZIP entries, as the format `zip` lists them, in pieces of at most CHUNK. A deflated
    entry is one task, whose CRC is checked at its end; a stored one is as many as it has ranges, without CRC: member_crcs()
    has theirs."""
    need_ = ["archive", "name", "size", "compressed_size", "crc32", "method", "header_offset", "start", "end"]

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                with opened(r["archive"]) as f:
                    head = f.read_at(30, r["header_offset"])
                    need(len(head) == 30 and head[:4] == b"PK\3\4", f"{r['name']}: no local header")
                    need(not head[6] & 1 and r["method"] in (0, 8), f"{r['name']}: encrypted or unknown compression")
                    at = r["header_offset"] + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")
                    need(at + r["compressed_size"] <= f.size(), f"{r['name']}: entry is cut short")
                    off, crc = r["start"], 0
                    if r["method"] == 8:
                        parts = _inflated(f, at, r["compressed_size"])
                    else:
                        parts = (f.read_at(min(CHUNK, r["end"] - a), at + a) for a in range(r["start"], r["end"], CHUNK))
                    for data in parts:
                        crc = zlib.crc32(data, crc)
                        yield pa.RecordBatch.from_arrays([pa.array([r["archive"]]), pa.array([r["name"]]), pa.array([off], pa.int64()), pa.array([data], pa.binary())], names=["archive", "name", "off", "data"])
                        off += len(data)
                    need(off == r["end"], f"{r['name']}: entry has another size")
                    need(crc == r["crc32"] or (r["start"], r["end"]) != (0, r["size"]), f"{r['name']}: CRC differs")

    tasks = member_ranges(entries, size).select(*need_)
    return tasks.mapInArrow(run, "archive string, name string, off long, data binary")


def member_crcs(chunks: DataFrame) -> DataFrame:
    """(archive, name, size, crc32) of members' chunks, merged from theirs in Catalyst."""
    from ..operators import integrity

    parts = F.array_sort(F.collect_list(F.struct("off", F.crc32("data").alias("crc"), F.octet_length("data").cast("long").alias("len"))))
    return chunks.groupBy("archive", "name").agg(F.sum(F.octet_length("data")).cast("long").alias("size"), integrity.crc32_fold(parts).alias("crc32"))

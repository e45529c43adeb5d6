"""ZIP and TAR archives as tables, encrypted packages as ranges, and file verification.

Archives are rows (path, content), as binaryFile gives them; `register(spark)` adds the formats `zip` and `tar` to
spark.read for local or shared paths.
"""

from __future__ import annotations

import io
import tarfile
import zipfile
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import batches
from ..errors import FormatError
from ..functions import crypto
from .images import SPARSE_MAGIC, need, sparse_pieces

ZIP = "archive string, name string, size long, compressed_size long, crc32 long, method int, header_offset long"
TAR = "archive string, name string, size long, offset_data long"


def zip_entries(label: str, raw) -> list[tuple]:
    """Entries of a ZIP file (a file object), without directories."""
    try:
        with zipfile.ZipFile(raw) as z:
            return [(label, i.filename, i.file_size, i.compress_size, i.CRC, i.compress_type, i.header_offset) for i in z.infolist() if not i.is_dir()]
    except zipfile.BadZipFile as e:
        raise FormatError(f"{label}: {e}") from e


def tar_entries(label: str, raw) -> list[tuple]:
    """Regular files of a TAR file."""
    try:
        with tarfile.open(fileobj=raw, mode="r:") as t:
            return [(label, m.name, m.size, m.offset_data) for m in t if m.isfile()]
    except tarfile.TarError as e:
        raise FormatError(f"{label}: {e}") from e


def _listed(files: DataFrame, entries, schema: str) -> DataFrame:
    def run(rows):
        for label, raw in rows:
            yield from entries(label, io.BytesIO(raw or b""))

    return batches.mapped(files.select(F.col("path").cast("string"), "content"), run, schema)


def zip_list(files: DataFrame) -> DataFrame:
    return _listed(files, zip_entries, ZIP)


def tar_list(files: DataFrame) -> DataFrame:
    return _listed(files, tar_entries, TAR)


def zip_extract(files: DataFrame) -> DataFrame:
    """(archive, name, content, ok, method): entries with their bytes; ok: they have the CRC that the archive says."""

    def run(rows):
        for label, raw in rows:
            try:
                z = zipfile.ZipFile(io.BytesIO(raw or b""))
            except zipfile.BadZipFile as e:
                raise FormatError(f"{label}: {e}") from e
            for i in z.infolist():
                if i.is_dir():
                    continue
                need(not i.flag_bits & 1 and i.compress_type in (0, 8), f"{i.filename}: encrypted or unknown compression")
                need(raw[i.header_offset : i.header_offset + 4] == b"PK\3\4", f"{i.filename}: no local header")
                start = i.header_offset + 30 + sum(int.from_bytes(raw[i.header_offset + k : i.header_offset + k + 2], "little") for k in (26, 28))
                data = raw[start : start + i.compress_size]
                data = zlib.decompress(data, -15) if i.compress_type == 8 else data
                yield label, i.filename, data, zlib.crc32(data) == i.CRC, i.compress_type

    return batches.mapped(files.select(F.col("path").cast("string"), "content"), run, "archive string, name string, content binary, ok boolean, method int")


def tar_extract(files: DataFrame) -> DataFrame:
    """(archive, name, content): regular files with their bytes."""

    def run(rows):
        for label, raw in rows:
            for _, name, size, at in tar_entries(label, io.BytesIO(raw or b"")):
                yield label, name, (raw or b"")[at : at + size]

    return batches.mapped(files.select(F.col("path").cast("string"), "content"), run, "archive string, name string, content binary")


def package_ranges(packages: DataFrame, size: int = 1 << 20) -> DataFrame:
    """(path, key, off, data, last): encrypted packages (path, key, content) in aligned ranges."""
    checked = F.when(F.octet_length("content") % 16 != 0, F.raise_error(F.lit("package isn't whole blocks"))).otherwise(F.col("content"))
    rows = packages.withColumn("content", checked.cast("binary"))
    return rows.select("path", "key", F.explode(crypto.chunks(F.col("content"), size)).alias("c")).select("path", "key", "c.off", "c.data", "c.last")


def decrypted(ranges: DataFrame) -> DataFrame:
    """(path, off, data): plain bytes of the ranges, in parallel."""
    return ranges.select("path", "off", crypto.decrypt_chunk(F.col("data"), F.col("key"), F.col("last")).alias("data"))


def verify(files: DataFrame) -> DataFrame:
    """(path, format, entries, valid, error, sha256, md5): what each file is and whether its structure holds: sparse, zip
    (with its CRCs), tar, encrypted (by suffix), else binary, which is valid whatever it holds."""

    def look(path: str, raw: bytes) -> tuple[str, int | None, str | None]:
        if raw[:4] == SPARSE_MAGIC.to_bytes(4, "little"):
            return "sparse", sum(1 for p in sparse_pieces(raw) if p[2]), None
        if zipfile.is_zipfile(io.BytesIO(raw)):
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                bad = z.testzip()
                need(bad is None, f"entry {bad} is damaged")
                return "zip", len(z.infolist()), None
        if len(raw) >= 512 and raw[257:262] == b"ustar":
            return "tar", len(tar_entries(path, io.BytesIO(raw))), None
        if path.lower().endswith((".enc2", ".enc4")):
            need(len(raw) and len(raw) % 16 == 0, "package isn't whole blocks")
            return "encrypted", None, None
        return "binary", None, None

    def run(rows):
        for path, raw in rows:
            try:
                form, entries, error = look(path, raw or b"")
            except (FormatError, zipfile.BadZipFile, zlib.error, EOFError) as e:
                form, entries, error = "damaged", None, str(e)
            yield path, form, entries, error is None, error

    slim = files.select(F.col("path").cast("string"), "content")
    found = batches.mapped(slim, run, "path string, format string, entries long, valid boolean, error string")
    return found.join(slim.select("path", F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5")), "path")


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    """A task for each file, which reads by offset what its index needs, from any store."""

    def __init__(self, path: str, entries):
        self.path, self.entries = path, entries

    def partitions(self):
        from .ranged import listed

        return [_File(p) for p, _ in listed(self.path)]

    def read(self, partition):
        from .ranged import opened

        with opened(partition.path) as f:
            yield from self.entries(partition.path, f)


class ZipSource(DataSource):
    @classmethod
    def name(cls):
        return "zip"

    def schema(self):
        return ZIP

    def reader(self, schema):
        return _Reader(self.options["path"], zip_entries)


class TarSource(DataSource):
    @classmethod
    def name(cls):
        return "tar"

    def schema(self):
        return TAR

    def reader(self, schema):
        return _Reader(self.options["path"], tar_entries)


def register(spark: SparkSession) -> None:
    for source in (ZipSource, TarSource):
        spark.dataSource.register(source)

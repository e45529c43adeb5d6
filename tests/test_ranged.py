"""Files read by offset: more than a value holds, in bounded pieces."""

import random
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.sources import archives, images, ranged

from .test_filesystems import erofs

MIB = 1 << 20


def noise(n, seed=1):
    return random.Random(seed).randbytes(n)


def paths(spark, *names):
    return spark.createDataFrame([(str(n),) for n in names], "path string")


def joined(rows, key="off"):
    return b"".join(bytes(r.data) for r in sorted(rows, key=lambda r: r[key]))


def test_ranges(spark, tmp_path):
    for name, data in (("a.img", noise(2 * MIB + 5)), ("b.img", b""), ("c.bin", b"x")):
        (tmp_path / name).write_bytes(data)
    got = ranged.ranges(spark, str(tmp_path)).collect()
    assert {r.image.rsplit("/", 1)[1] for r in got} == {"a.img", "c.bin"} and max(len(r.data) for r in got) == MIB
    assert joined(ranged.ranges(spark, f"file://{tmp_path}/a*").collect()) == noise(2 * MIB + 5)
    assert ranged.ranges(spark, str(tmp_path / "b.img")).count() == 0
    with pytest.raises(Exception, match="no file"):
        ranged.ranges(spark, str(tmp_path / "*.none")).collect()


def test_pages(tmp_path):
    data = noise(5000)
    (tmp_path / "f").write_bytes(data)
    with ranged.opened(str(tmp_path / "f")) as f:
        read = ranged.Pages(f, page=64, most=3)
        for at, n in ((0, 10), (60, 10), (4990, 100), (100, 4000), (6000, 5), (63, 65), (10, 0)):
            assert read(at, n) == data[at : at + n]
        assert len(read.have) <= 3


def test_sparse_beyond_a_value(spark, tmp_path):
    """An image of 3 GiB in a small file: two raw pieces, a fill, and a hole between; no task holds more than chunks."""
    block, hole = 4096, 3 * 1024 * MIB
    raw = [noise(MIB + block, 2), noise(block, 3)]
    pieces = [(images.RAW, raw[0]), (images.DONT_CARE, hole // block), (images.FILL, b"\x01\x02\x03\x04"), (images.RAW, raw[1])]
    out, blocks = b"", 0
    for kind, body in pieces:
        n = body if kind == images.DONT_CARE else 300 if kind == images.FILL else len(body) // block
        data = b"" if kind == images.DONT_CARE else body
        out += struct.pack("<HHII", kind, 0, n, 12 + len(data)) + data
        blocks += n
    head = struct.pack("<IHHHHIIII", images.SPARSE_MAGIC, 1, 0, 28, 12, block, blocks, len(pieces), 0)
    at = tmp_path / "s.img"
    at.write_bytes(head + out)
    chunks = ranged.sparse_chunks(paths(spark, at), ranged.ranges(spark, str(at))).collect()
    assert max(len(r.data) for r in chunks) <= MIB
    behind = len(raw[0]) + hole
    assert joined([r for r in chunks if r.off < hole]) == raw[0]
    assert joined([r for r in chunks if r.off >= hole]) == b"\x01\x02\x03\x04" * (300 * block // 4) + raw[1]
    assert min(r.off for r in chunks if r.off >= hole) == behind
    at.write_bytes(head + out[:-1])
    with pytest.raises(Exception, match="wrong size"):
        ranged.sparse_map(paths(spark, at)).collect()


def test_filesystems_by_offset(spark, tmp_path):
    data = noise(9000, 4)
    (tmp_path / "e.img").write_bytes(erofs({"f": ("plain", data), "g": ("lz4", b"ab" * 4096)}))
    entries, extents, kept = ranged.filesystem_tables(paths(spark, tmp_path / "e.img"))
    assert {r.name: r["size"] for r in entries.collect()} == {"f": 9000, "g": 8192}
    parts = extents.withColumn("hole", F.lit(False))
    pieces = images.copy_extents(parts, ranged.ranges(spark, str(tmp_path / "e.img")), ["image"], ["image", "node"])
    assert joined(pieces.collect())[:9000] == data and joined(kept.collect()) == b"ab" * 4096


def test_zip_members(spark, tmp_path):
    files = {"stored": (noise(3 * MIB + 7), 0), "deflated": (b"abc" * MIB + noise(99), 8), "empty": (b"", 0), "none": (b"", 8)}
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        for name, (data, method) in files.items():
            z.writestr(zipfile.ZipInfo(name), data, method)
    archives.register(spark)
    entries = spark.read.format("zip").load(str(tmp_path / "z.zip"))
    chunks = ranged.member_chunks(entries, MIB)
    got = chunks.collect()
    assert max(len(r.data) for r in got) <= MIB
    for name, (data, _) in files.items():
        assert joined([r for r in got if r.name == name]) == data
    assert {r.name: r.crc32 for r in ranged.member_crcs(chunks).collect()} == {n: zlib.crc32(d) for n, (d, _) in files.items() if d}
    wrong = entries.withColumn("crc32", F.col("crc32") + 1)
    with pytest.raises(Exception, match="CRC differs"):
        ranged.member_chunks(wrong.filter("name = 'deflated'")).collect()


def test_no_paths(spark):
    none = spark.createDataFrame([(None,)], "path string")
    assert ranged.sparse_map(none).collect() == [] and ranged.filesystem_tables(none)[0].collect() == []

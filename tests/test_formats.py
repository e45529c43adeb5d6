"""Byte formats: round trips, independent images, and damage that must be refused."""

import bz2
import hashlib
import io
import os
import random
import shutil
import struct
import subprocess
import tarfile
import zipfile
import zlib

import pyarrow as pa
import pytest

from tessera.errors import FormatError
from tessera.functions import crypto
from tessera.operators import hierarchy, integrity
from tessera.plans import kernels
from tessera.sources import archives, ext4, images, patches, payload, transfers

B = 4096


def noise(n, seed=1):
    return random.Random(seed).randbytes(n)


# ---------------------------------------------------------------- sparse


def sparse(*pieces, blocks, checksum=0, block=B):
    body = b"".join(struct.pack("<HHII", k, 0, n, 12 + len(d)) + d for k, n, d in pieces)
    return struct.pack("<IHHHHIIII", images.SPARSE_MAGIC, 1, 0, 28, 12, block, blocks, len(pieces), checksum) + body


def whole(raw, size):
    out = bytearray(size)
    for off, data in images.expand(raw):
        out[off : off + len(data)] = data
    return bytes(out)


def test_sparse_kinds_and_checksums():
    data = noise(B)
    want = data + b"\x01\x02\x03\x04" * 2048 + bytes(B)
    crc = struct.pack("<I", zlib.crc32(want))
    pieces = [(images.RAW, 1, data), (images.FILL, 2, b"\x01\x02\x03\x04"), (images.RAW, 0, b""), (images.DONT_CARE, 1, b""), (images.CRC32, 0, crc)]
    assert whole(sparse(*pieces, blocks=4, checksum=zlib.crc32(want)) + b"trailing", 4 * B) == want
    assert whole(images.make_sparse(want), 4 * B) == want
    with pytest.raises(FormatError):
        list(images.sparse_pieces(sparse(*pieces, blocks=4), empty_allowed=False))


@pytest.mark.parametrize(
    "raw",
    [
        b"short",
        sparse((images.RAW, 1, noise(B)), blocks=2),
        sparse((images.RAW, 2, noise(2 * B)), blocks=1),
        sparse((images.RAW, 1, noise(B - 1)), blocks=1),
        sparse((images.FILL, 1, b"\0"), blocks=1),
        sparse((0xCAC9, 1, b""), blocks=1),
        sparse((images.RAW, 1, noise(B)), (images.CRC32, 0, b"\0\0\0\0"), blocks=1),
        sparse((images.RAW, 1, noise(B)), blocks=1, checksum=5),
        sparse((images.RAW, 1, noise(B)), blocks=1, block=4098),
        sparse((images.RAW, 1, noise(B)), blocks=1)[:-1],
    ],
)
def test_damaged_sparse_images_are_refused(raw):
    with pytest.raises(FormatError):
        list(images.expand(raw))


# ---------------------------------------------------------------- logical partitions


def test_extraction_from_four_encodings(spark):
    parts = {"system_a": b"s" * (9 * B), "system_ext_a": b"e" * (3 * B), "empty_b": b"", "vendor_a": noise(700_000)}
    raw = images.make_super(parts)
    files = {"a.img": raw, "b.img.lz4": pa.compress(raw, codec="lz4", asbytes=True), "c.img": images.make_sparse(raw), "d.img.lz4": pa.compress(images.make_sparse(raw), codec="lz4", asbytes=True)}
    chunks = images.chunk_table(spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "path string, content binary"))
    sizes = images.lp_sizes(images.lp_extents(chunks))
    got = {(r.image, r.partition): bytes(r.content) for r in images.assembled(images.extract_partitions(chunks), ["image", "partition"], sizes).collect()}
    assert got == {(f, p): c + bytes(-len(c) % B) for f in files for p, c in parts.items()}
    only = images.extract_partitions(chunks, ["system_a"]).select("partition").distinct().collect()
    assert [r.partition for r in only] == ["system_a"]


def test_second_copy_counts_and_damage_is_refused():
    raw = images.make_super({"system_a": b"s" * B})
    read = lambda data: lambda at, n: data[at : at + n].ljust(n, b"\0")
    want = images.lp_metadata(read(raw))
    for at in (4096 + 5, 4096 * 3 + 200):
        hurt = bytearray(raw)
        hurt[at] ^= 1
        assert images.lp_metadata(read(bytes(hurt))) == want
        hurt[at + 4096] ^= 1
        with pytest.raises(FormatError):
            images.lp_metadata(read(bytes(hurt)))


# ---------------------------------------------------------------- LZ4, patches


def test_lz4():
    data = noise(5000) + b"a" * 100_000 + noise(300, 2)
    assert images.unlz4(pa.compress(data, codec="lz4", asbytes=True)) == data
    raw = pa.compress(data, codec="lz4_raw", asbytes=True)
    assert images.unlz4(b"\x02\x21\x4c\x18" + len(raw).to_bytes(4, "little") + raw) == data
    for bad in (b"", b"abcd", pa.compress(data, codec="lz4", asbytes=True)[:-9], b"\x02\x21\x4c\x18\xff\0\0\0x"):
        with pytest.raises(FormatError):
            images.unlz4(bad)


def test_patches():
    old, new = noise(50_000), noise(20_000, 3) + noise(50_000)[100:40_000] + b"tail"
    for kinds in (None, (0, 0, 0), (2, 2, 2), (0, 1, 2)):
        patch = patches.make_patch(old, new, kinds)
        assert patches.apply_patch(old, patch) == new == patches.apply_patch(old, patch, len(new))
        for bad in (patch[:20], b"X" + patch[1:], patch[:24] + b"\1" + patch[25:], patch[:15] + b"\x80" + patch[16:]):
            with pytest.raises(FormatError):
                patches.apply_patch(old, bad)
        with pytest.raises(FormatError):
            patches.apply_patch(old, patch, 5)
    # reads outside the old bytes give zeros; moves go back and forth
    control = b"".join(patches._packed(x) for x in (4, 1, -6, 4, 0, 100, 2, 0, 0))
    head = b"BSDF2\0\0\0" + patches._packed(len(control)) + patches._packed(10) + patches._packed(11)
    assert patches.apply_patch(b"\1\2\3", head + control + bytes([1] * 10) + b"Z") == bytes([2, 3, 4, 1]) + b"Z" + bytes([1, 1, 2, 3, 1, 1])


# ---------------------------------------------------------------- payload and block OTAs


def test_payload(spark):
    new = bytes(range(256)) * 16
    raw = payload.make([{"name": "vendor", "new": new, "ops": [(0, new, [], [(0, 1)])]}])
    files = spark.createDataFrame([("ota", bytearray(raw))], "payload string, content binary")
    ops = payload.manifest(files)
    assert payload.violations(ops).count() == 0
    old = spark.createDataFrame([], "partition string, block long, data binary")
    assert [bytes(r.data) for r in payload.apply(ops, old).collect()] == [new]
    for bad in (raw[:-1], b"XrAU" + raw[4:], raw[:30] + b"\xff" * 12 + raw[42:]):
        with pytest.raises(FormatError):
            payload.parse("x", bad)


def test_operations_check_hashes_sizes_and_signatures():
    data = noise(B)
    sha = hashlib.sha256(data).digest()
    assert payload.target(0, b"", data, B, data_sha256=sha) == data
    with pytest.raises(FormatError):
        payload.target(0, b"", data, B, data_sha256=bytes(32))
    with pytest.raises(FormatError):
        payload.target(1, b"", bz2.compress(data), 2 * B)
    with pytest.raises(FormatError):
        payload.target(4, data, b"", B, src_sha256=bytes(32), first_at=0)
    signed = data[:768] + b"SignerVer02" + data[779:]
    plain = bytes(256) + signed[256:]
    assert payload.target(4, signed, b"", B, src_sha256=hashlib.sha256(plain).digest(), first_at=0) == plain
    assert payload.target(6, b"", b"", B) == bytes(B)


def test_block_commands():
    new = noise(B)
    head = "4\n2\n0\n0\n"
    rows = transfers.parse("p", head + "new 2,0,1\nzero 2,1,2\n")
    assert transfers.run_all(rows, b"", new, b"") == new + bytes(B)
    with pytest.raises(FormatError):
        transfers.run_all(rows, b"", new[:-1], b"")
    image = noise(4 * B, 5)
    sha = lambda x: hashlib.sha1(x).hexdigest()
    a, b, c = image[:B], image[B : 2 * B], image[2 * B : 3 * B]
    swap = f"stash {sha(a)} 2,0,1\nstash {sha(a)} 2,3,4\nmove {sha(b)} 2,0,1 1 2,1,2\nmove {sha(a)} 2,1,2 1 - {sha(a)}:2,0,1\nfree {sha(a)}\n"
    assert transfers.run_all(transfers.parse("p", head + swap), image, b"", b"")[: 2 * B] == b + a
    mixed = f"stash {sha(c)} 2,2,3\nmove {sha(c + a)} 2,2,4 2 2,0,1 2,1,2 {sha(c)}:2,0,1\n"
    assert transfers.run_all(transfers.parse("p", head + mixed), image, b"", b"")[2 * B :] == c + a
    assert transfers.run_all(transfers.parse("p", head + "zero 2,0,1"), image, b"", b"", expected=B) == bytes(B)
    assert transfers.run_all(transfers.parse("p", head + "zero 2,0,1"), image, b"", b"", expected=5 * B) == bytes(B) + image[B:] + bytes(B)
    for bad in (f"move {sha(a)} 2,1,2 1 - {sha(a)}:2,0,1", f"move {sha(b)} 2,1,2 1 2,0,1", "imgdiff 0 1 x x 2,0,1 1 2,0,1", f"move {sha(a)} 2,1,3 1 2,0,1", f"move {sha(a)} 2,1,2 2 2,0,1", "new 2,0,1"):
        with pytest.raises(FormatError):
            transfers.run_all(transfers.parse("p", head + bad), image, b"", b"")
    for bad in ("1\n2", "5\n1\n0\n0\n", head + "new 3,0,1", head + "zero 4,0,2,1,3", head + "new 2,0,1 x", head + "zero 2,3,3"):
        with pytest.raises(FormatError):
            transfers.parse("p", bad)


# ---------------------------------------------------------------- filesystems


def extracted(spark, raw, paths):
    files = spark.createDataFrame([("img", bytearray(raw))], "path string, content binary")
    entries, extents = ext4.tables(files)
    found = hierarchy.resolve(spark.createDataFrame([(p,) for p in paths], "path string"), entries.select("parent", "name", "node", "link"), links=6)
    sizes = entries.filter("link is null").select("node", "size").distinct()
    found = found.join(sizes, "node", "left").withColumn("image", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("img"))
    parts = found.join(extents.withColumnRenamed("size", "length"), ["image", "node"]).selectExpr("image", "path", "target", "source", "least(length, size - target) as size", "false as hole")
    data = images.copy_extents(parts, images.chunk_table(files), ["image"], ["image", "path"])
    whole = images.assembled(data, ["image", "path"], found.filter("size is not null").select("image", "path", "size"))
    return {r.path: bytes(r.content) for r in whole.collect()}, {r.path: r.node for r in found.collect()}


def test_own_ext4_image(spark):
    files = {"etc/hello.txt": b"hello", "big.bin": noise(B) + bytes(3 * B) + noise(B + 77, 4)}
    got, nodes = extracted(spark, ext4.make(files, {"etc/abs": "/big.bin", "etc/rel": "hello.txt", "loop": "loop"}), ["/etc/hello.txt", "/big.bin", "/etc/abs", "etc/rel", "/none", "/loop"])
    assert got == {"/etc/hello.txt": b"hello", "/big.bin": files["big.bin"], "/etc/abs": files["big.bin"], "etc/rel": b"hello"}
    assert nodes["/none"] is None and nodes["/loop"] is None
    with pytest.raises(FormatError):
        ext4.Reader(lambda at, n: bytes(n))


@pytest.mark.skipif(not shutil.which("mkfs.ext4"), reason="no mkfs.ext4")
@pytest.mark.parametrize("options", [["-b", "4096"], ["-b", "1024"], ["-b", "4096", "-O", "^extent,^64bit"], ["-b", "1024", "-O", "^extents,^64bit"]])
def test_ext4_images_of_mkfs(spark, tmp_path, options):
    tree = tmp_path / "tree"
    (tree / "etc" / "deep").mkdir(parents=True)
    want = {"/etc/hello.txt": noise(37), "/large.bin": noise(1_300_073, 2), "/etc/deep/empty": b""}
    for path, data in want.items():
        (tree / path[1:]).write_bytes(data)
    os.symlink("../etc/hello.txt", tree / "etc" / "link")
    os.symlink("/etc/deep/empty", tree / "abs")
    image = tmp_path / "fs.img"
    done = subprocess.run(["mkfs.ext4", "-q", "-F", "-d", str(tree), *options, str(image), "8M"], capture_output=True, timeout=60)
    if done.returncode:
        pytest.skip(done.stderr.decode()[:200])
    got, _ = extracted(spark, image.read_bytes(), list(want))
    assert got == want
    assert spark.createDataFrame([(bytearray(image.read_bytes()[:2048]),)], "i binary").select(ext4.kind_of("i")).first()[0] == "ext4"


# ---------------------------------------------------------------- archives, crypto, checksums


def test_archives_and_sources(spark, tmp_path):
    z, t = tmp_path / "a.zip", tmp_path / "b.tar"
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("boot.img", noise(B), zipfile.ZIP_DEFLATED)
        f.writestr("vbmeta.img", b"v" * 100, zipfile.ZIP_STORED)
    with tarfile.open(t, "w") as f:
        info = tarfile.TarInfo("super.img.lz4")
        info.size = 5000
        f.addfile(info, io.BytesIO(noise(5000)))
    archives.register(spark)
    got = spark.read.format("zip").load(str(z)).collect()
    assert {(r.name, r.size, r.method) for r in got} == {("boot.img", B, 8), ("vbmeta.img", 100, 0)}
    assert [(r.name, r.size, r.offset_data) for r in spark.read.format("tar").load(str(t)).collect()] == [("super.img.lz4", 5000, 512)]
    files = spark.read.format("binaryFile").load(str(tmp_path))
    zips, tars = files.filter("path like '%.zip'"), files.filter("path like '%.tar'")
    assert {r.name: bytes(r.content) for r in archives.zip_extract(zips).collect()} == {"boot.img": noise(B), "vbmeta.img": b"v" * 100}
    assert [bytes(r.content) for r in archives.tar_extract(tars).collect()] == [noise(5000)]
    kinds = {r.path.rsplit("/", 1)[1]: (r.format, r.valid, r.entries) for r in archives.verify(files).collect()}
    assert kinds == {"a.zip": ("zip", True, 2), "b.tar": ("tar", True, 1)}
    hurt = bytearray(z.read_bytes())
    hurt[60] ^= 1
    bad = archives.verify(spark.createDataFrame([("x.zip", hurt), ("y.enc4", bytearray(17)), ("z", bytearray(3))], "path string, content binary")).collect()
    assert {r.path: r.valid for r in bad} == {"x.zip": False, "y.enc4": False, "z": True}


def test_encrypted_packages_decrypt_in_ranges(spark):
    from pyspark.sql import functions as F

    plain = noise(100_003)
    key = bytearray(range(16))
    rows = spark.createDataFrame([("p", key, bytearray(plain))], "path string, key binary, plain binary")
    package = rows.select("path", "key", crypto.encrypt(F.col("plain"), F.col("key")).alias("content"))
    parts = archives.decrypted(archives.package_ranges(package, 4096)).orderBy("off").collect()
    assert b"".join(bytes(r.data) for r in parts) == plain and len(parts) == 25


def test_crc32_combines(spark):
    from pyspark.sql import functions as F

    a, b = noise(1000), noise(12_345, 2)
    df = spark.createDataFrame([(zlib.crc32(a), zlib.crc32(b), len(b))], "a long, b long, n long")
    assert df.select(integrity.crc32_combine(F.col("a"), F.col("b"), F.col("n"))).first()[0] == zlib.crc32(a + b)


def test_lz4_query_hashes_whole_texts(spark, tmp_path):
    texts = {1: "odd é " * 400_000, 2: "even\0 " * 400_000, 3: "", 4: "", 5: None, 6: None, 7: "short", 8: "short"}
    assert len(texts[1].encode()) > 2 * images.CHUNK < len(texts[2])
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.sha256 for r in kernels.lz4_decode(spark, str(tmp_path)).collect()}
    assert got == {k: None if t is None else hashlib.sha256(t.encode()).hexdigest() for k, t in texts.items()}

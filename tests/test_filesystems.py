"""F2FS and EROFS images built here from the formats."""

import random
import stat
import struct
import zlib

import pyarrow as pa
import pytest

from tessera.errors import FormatError
from tessera.sources import filesystems as S

B = 4096


def noise(n, seed=1):
    return random.Random(seed).randbytes(n)


# ---------------------------------------------------------------- EROFS


def dirent_block(entries, size=B):
    """entries: (name, nid, type), names in order."""
    head, names, at = b"", b"", 12 * len(entries)
    for name, nid, kind in entries:
        head += struct.pack("<QHBB", nid, at + len(names), kind, 0)
        names += name.encode()
    return head + names


def erofs(files, features=4):
    """Inodes in slots of 512 bytes from block 1; data from block 8."""
    image = bytearray(8 * B)
    struct.pack_into("<I", image, 1024, S.EROFS.MAGIC)
    image[1024 + 12] = 12
    struct.pack_into("<H", image, 1024 + 14, 0)
    struct.pack_into("<I", image, 1024 + 40, 1)
    struct.pack_into("<I", image, 1024 + 80, features)
    listing = [(".", 0, 2), ("..", 0, 2)]

    def put(data):
        start = len(image) // B
        image.extend(data + bytes(-len(data) % B))
        return start

    def inode(slot, mode, size, layout, start, after=b"", wide=False):
        at = B + slot * 512
        head = struct.pack("<HHHH", layout << 1 | wide, 0, mode, 1)
        head += (struct.pack("<QI", size, start) if wide else struct.pack("<III", size, 0, start)).ljust((64 if wide else 32) - 8, b"\0")
        image[at : at + len(head) + len(after)] = head + after

    for slot, (name, (layout, data)) in enumerate(sorted(files.items()), 1):
        wide = slot % 2 == 1
        whole = len(data) // B * B
        if layout == "plain":
            inode(slot, stat.S_IFREG | 0o644, len(data), 0, put(data), wide=wide)
        elif layout == "inline":
            inode(slot, stat.S_IFREG | 0o644, len(data), 2, put(data[:whole]) if whole else 0, data[whole:], wide)
        elif layout == "chunks":
            parts = [data[k : k + B] for k in range(0, len(data), B)]
            table = struct.pack(f"<{len(parts)}I", *[put(p) if any(p) else 0xFFFFFFFF for p in parts])
            inode(slot, stat.S_IFREG | 0o644, len(data), 4, 0, table, wide)
        else:  # one LZ4 cluster for each block of output, full indexes
            parts = [data[k : k + B] for k in range(0, len(data), B)]
            marks = b"".join(struct.pack("<HHI", 1, 0, put(pa.compress(p, codec="lz4_raw", asbytes=True))) for p in parts)
            inode(slot, stat.S_IFREG | 0o644, len(data), 1, 0, bytes(8) + bytes(8) + marks, wide)
        listing.append((name, slot * 16, 1))
    root = dirent_block(sorted(listing))
    inode(0, stat.S_IFDIR | 0o755, len(root), 0, put(root))
    return bytes(image)


def test_erofs_layouts(spark):
    files = {
        "plain": ("plain", noise(2 * B + 5)),
        "tail": ("inline", noise(B + 123, 2)),
        "small": ("inline", b"hello"),
        "chunked": ("chunks", noise(B, 3) + bytes(B) + noise(77, 4)),
        "packed": ("lz4", b"".join(bytes([k]) * 3000 + noise(1096, k) for k in range(3)) + b"end" * 50),
    }
    raw = erofs(files)
    for name, (_, data) in files.items():
        assert S.file_content(raw, name) == data, name
    entries, extents, data = S.tables(spark.createDataFrame([("i", bytearray(raw))], "path string, content binary"))
    assert {r.name: r.size for r in entries.collect()} == {k: len(v) for k, (_, v) in files.items()}
    assert extents.count() == 1 + 2 + 1 + 2 and data.count() == 4
    with pytest.raises(FormatError):
        S.file_content(raw, "none")
    with pytest.raises(FormatError):
        S.EROFS(lambda at, n: erofs({}, features=0x88)[at : at + n])


# ---------------------------------------------------------------- F2FS


def checkpoint(version, nat_bytes=64):
    raw = bytearray(B)
    struct.pack_into("<Q", raw, 0, version)
    struct.pack_into("<I", raw, 136, 3)
    struct.pack_into("<I", raw, 156, 64)
    struct.pack_into("<I", raw, 160, nat_bytes)
    struct.pack_into("<I", raw, 164, B - 4)
    struct.pack_into("<I", raw, B - 4, zlib.crc32(raw[: B - 4], S.F2FS.MAGIC ^ 0xFFFFFFFF) ^ 0xFFFFFFFF)
    return bytes(raw)


def f2fs(files, *, versions=(1, 2), second=False):
    """Superblock, two checkpoint packs at block 512, the address table at block 2048, data from block 4096."""
    blocks = {}
    sb = bytearray(B)
    for at, value in ((0, S.F2FS.MAGIC), (16, 12), (20, 9), (76, 512), (84, 2048), (96, 3)):
        struct.pack_into("<I", sb, 1024 + at, value)
    blocks[0] = bytes(sb)
    for k, version in enumerate(versions):
        if version:
            pack = bytearray(checkpoint(version))
            if second:
                pack[256] = 0x80
                struct.pack_into("<I", pack, B - 4, zlib.crc32(pack[: B - 4], S.F2FS.MAGIC ^ 0xFFFFFFFF) ^ 0xFFFFFFFF)
            blocks[512 + 512 * k], blocks[514 + 512 * k] = bytes(pack), bytes(pack)
    nat, nxt = bytearray(B), [4096, 4]

    def put(data):
        blocks[nxt[0]] = data.ljust(B, b"\0")
        nxt[0] += 1
        return nxt[0] - 1

    def node(nid, ino, body):
        raw = bytearray(body.ljust(B, b"\0"))
        struct.pack_into("<II", raw, B - 24, nid, ino)
        struct.pack_into("<I", nat, 9 * nid + 5, put(bytes(raw)))

    def number():
        nxt[1] += 1
        return nxt[1] - 1

    def inode(nid, mode, data, inline=0):
        raw = bytearray(B)
        struct.pack_into("<H", raw, 0, mode)
        raw[3] = inline
        struct.pack_into("<Q", raw, 16, len(data))
        if inline:
            raw[364 : 364 + len(data)] = data
        else:
            parts = [data[k : k + B] for k in range(0, len(data), B)]
            addresses = [put(p) if any(p) else 0 for p in parts]
            struct.pack_into(f"<{len(addresses[:923])}I", raw, 360, *addresses[:923])
            rest, slot = addresses[923:], 0
            while rest and slot < 2:
                child = number()
                node(child, nid, struct.pack(f"<{len(rest[:1018])}I", *rest[:1018]))
                struct.pack_into("<I", raw, 4052 + 4 * slot, child)
                rest, slot = rest[1018:], slot + 1
            if rest:
                branch = number()
                children = []
                for k in range(0, len(rest), 1018):
                    child = number()
                    node(child, nid, struct.pack(f"<{len(rest[k : k + 1018])}I", *rest[k : k + 1018]))
                    children.append(child)
                node(branch, nid, struct.pack(f"<{len(children)}I", *children))
                struct.pack_into("<I", raw, 4052 + 8, branch)
        node(nid, nid, bytes(raw))

    def dentries(entries):
        raw = bytearray(B)
        slot = 0
        for name, nid in entries:
            n = name.encode()
            raw[slot // 8] |= 1 << slot % 8
            struct.pack_into("<IIHB", raw, 30 + 11 * slot, 0, nid, len(n), 1)
            raw[30 + 214 * 11 + 8 * slot : 30 + 214 * 11 + 8 * slot + len(n)] = n
            slot += -(-len(n) // 8)
        return bytes(raw)

    listing = []
    for name, data in files.items():
        nid = number()
        inode(nid, stat.S_IFREG | 0o644, data, 2 if len(data) <= 100 else 0)
        listing.append((name, nid))
    inode(3, stat.S_IFDIR | 0o755, dentries([(".", 3), *listing]))
    blocks[2048 + (512 if second else 0)] = bytes(nat)
    return blocks


@pytest.mark.parametrize("second", [False, True])
def test_f2fs(second):
    files = {"small.txt": b"inline", "a-longer-name.bin": noise(3 * B + 9) + bytes(B) + noise(7, 2), "deep": b"".join(bytes([k % 251 + 1]) * B for k in range(923 + 2 * 1018 + 1018 + 5))}
    blocks = f2fs(files, second=second)
    read = lambda at, n: b"".join(blocks.get(k, bytes(B)) for k in range(at // B, -(-(at + n) // B)))[at % B : at % B + n]
    fs = S.F2FS(read)
    listing = dict(fs.entries(fs.root))
    assert listing.keys() == files.keys()
    for name, data in files.items():
        out = bytearray(len(data))
        for logical, physical, what in fs.extents(listing[name]):
            part = what if physical is None else read(physical, what)
            out[logical : logical + len(part)] = part
        assert bytes(out) == data, name


def test_f2fs_checkpoints():
    def root(versions, hurt=None):
        blocks = f2fs({"x": b"y"}, versions=versions)
        if hurt:
            raw = bytearray(blocks[hurt])
            raw[200] ^= 1
            blocks[hurt] = bytes(raw)
        return S.F2FS(lambda at, n: b"".join(blocks.get(k, bytes(B)) for k in range(at // B, -(-(at + n) // B)))[at % B : at % B + n])

    assert root((1, 2)).root == 3 and root((5, 0)).root == 3 and root((1, 2), hurt=1024).root == 3
    for versions, hurt in (((0, 0), None), ((1, 0), 512), ((1, 0), 514)):
        with pytest.raises(FormatError):
            root(versions, hurt)


def test_lz4_with_padding():
    data = b"abc" * 500 + noise(700)
    raw = pa.compress(data, codec="lz4_raw", asbytes=True)
    assert S.lz4_prefix(raw + bytes(99), len(data)) == data == S.lz4_prefix(raw, len(data))
    for bad in (raw[:-20], b"", b"\x10a\x09\x00"):
        with pytest.raises(FormatError):
            S.lz4_prefix(bad, len(data))

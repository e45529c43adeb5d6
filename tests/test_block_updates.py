"""Block updates: lists with declared sizes, patches of whole partitions, direct files, selection and resuming."""

import hashlib
import io
import random
import zipfile
import zlib

import pytest

from tessera.errors import SelectionError
from tessera.plans import block_updates as U
from tessera.sources import archives, patches

B = 4096
BASE = "partition string, content binary"


def noise(n, seed=1):
    return random.Random(seed).randbytes(n)


def sha(x):
    return hashlib.sha1(x).hexdigest()


def package(spark, entries, path="u.zip"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries.items():
            z.writestr(zipfile.ZipInfo(name), data)
    return spark.createDataFrame([(path, bytearray(out.getvalue()))], "path string, content binary")


OLD, BOOT = noise(3 * B), noise(B + 77, 2)
NEW_BOOT = noise(B, 3) + BOOT
LIST = f"4\n3\n0\n0\nstash {sha(OLD[:B])} 2,0,1\nmove {sha(OLD[B : 2 * B])} 2,0,1 1 2,1,2\nmove {sha(OLD[:B])} 2,1,2 1 - {sha(OLD[:B])}:2,0,1\nnew 2,2,3\n"
SCRIPT = (
    f'range_scan("/dev/by-name/vendor", "2,0,7");\npatch_partition("EMMC:/dev/by-name/boot:{len(NEW_BOOT)}:{sha(NEW_BOOT)}",\n'
    f'  "EMMC:/dev/by-name/boot:{len(BOOT)}:{sha(BOOT)}", package_extract_file("boot.img.p"));\n'
)


def entries():
    return {
        "system.transfer.list": LIST,
        "system.new.dat": noise(B, 5),
        "vendor.transfer.list": "4\n1\n0\n0\nnew 2,0,1\n",
        "vendor.new.dat": noise(B, 6),
        "dynamic_partitions_op_list": f"# sizes\nresize system {5 * B}\nresize system 1\n",
        U.SCRIPT: SCRIPT,
        "boot.img.p": patches.make_patch(BOOT, NEW_BOOT),
        "modem.BIN": b"radio",
        "sub/none.img": b"",
    }


WANT = {
    "system.img": (OLD[B : 2 * B] + OLD[:B] + noise(B, 5)).ljust(5 * B, b"\0"),
    "vendor.img": noise(B, 6).ljust(7 * B, b"\0"),
    "boot.img": NEW_BOOT,
    "modem.BIN": b"radio",
}


@pytest.fixture
def base(spark):
    return spark.createDataFrame([("system", bytearray(OLD)), ("boot", bytearray(BOOT))], BASE)


def test_everything(spark, base):
    files = package(spark, entries())
    got = U.merge(files, base).collect()
    assert {r.output: bytes(r.content) for r in got} == WANT and len(got) == 4
    assert all(r.sha256 == hashlib.sha256(WANT[r.output]).hexdigest() for r in got)
    parts = {r.partition: r for r in U.partitions(archives.zip_extract(files)).collect()}
    assert {k: (r.output, r["size"], r.source_required) for k, r in parts.items()} == {"system": ("system.img", 5 * B, True), "vendor": ("vendor.img", 7 * B, False), "boot": ("boot.img", len(NEW_BOOT), True)}
    assert parts["system"].histogram == {"STASH": 1, "MOVE": 2, "NEW": 1}


def test_selection_and_records(spark, base):
    files = package(spark, entries())
    only = U.merge(files, spark.createDataFrame([], BASE), ["vend*"], None).collect()
    assert [r.output for r in only] == ["vendor.img"]
    assert [r.output for r in U.merge(files, spark.createDataFrame([], BASE), None, ["modem"]).collect()] == ["modem.BIN"]
    done = spark.createDataFrame([("u.zip", "vendor.img", "", True), ("u.zip", "boot.img", "", False)], "ota string, name string, sha256 string, verified boolean")
    assert {r.output for r in U.merge(files, base, done=done).collect()} == set(WANT) - {"vendor.img"}
    with pytest.raises(SelectionError):
        U.merge(files, base, ["odm"])
    # an empty selection of a kind is an error, as is one that matches nothing
    with pytest.raises(SelectionError):
        U.merge(files, base, [" , "])


@pytest.mark.parametrize(
    ("change", "what"),
    [
        ({"dynamic_partitions_op_list": f"resize system {2 * B}"}, "behind the resized system"),
        ({"vendor.new.dat": noise(2 * B)}, "another size"),
        ({"system.transfer.list": LIST.replace("\nstash", "\nfree", 1).replace(" 2,0,1\nmove", "\nmove", 1)}, "no stash"),
        ({U.SCRIPT: ""}, "no declaration"),
        ({"boot.img.p": None}, "no patch entry"),
        ({"boot.img": b"twice"}, "two targets"),
    ],
)
def test_refused(spark, base, change, what):
    made = {k: v for k, v in (entries() | change).items() if v is not None}
    with pytest.raises(Exception, match=what):
        U.merge(package(spark, made), base).collect()


def test_wrong_bases(spark):
    for boot in (BOOT[:-1], noise(len(BOOT), 9), None):
        rows = [("system", bytearray(OLD))] + ([("boot", bytearray(boot))] if boot else [])
        with pytest.raises(Exception, match="base image"):
            U.merge(package(spark, entries()), spark.createDataFrame(rows, BASE), ["boot"]).collect()


def test_direct_files_resume_by_crc(spark):
    data = {"a.img": b"one", "b.bin": b"two"}
    files = archives.zip_extract(package(spark, data))
    have = spark.createDataFrame([("a.img", 3, zlib.crc32(b"one")), ("b.bin", 3, 1)], "output string, size long, crc32 long")
    got = {r.output: (r.reused, r.content) for r in U.copied(files, have).collect()}
    assert got == {"a.img": (True, None), "b.bin": (False, bytearray(b"two"))}


def test_existing_outputs(spark):
    wanted = spark.createDataFrame([("u", "a.img"), ("u", "b.img")], "archive string, output string")
    done, there = wanted.limit(1), wanted.select("output")
    with pytest.raises(Exception, match="without a completion record: b.img"):
        U.guarded(wanted, there, done).collect()
    assert [r.output for r in U.guarded(wanted, there, done, force=True).collect()] == ["b.img"]
    assert [r.output for r in U.guarded(wanted, there.limit(1), done).collect()] == ["b.img"]


def test_empty(spark, base):
    files = spark.createDataFrame([], "path string, content binary")
    assert U.merge(files, base).collect() == [] and U.partitions(archives.zip_extract(files)).collect() == []

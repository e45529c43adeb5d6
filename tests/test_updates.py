"""An A/B update from its archive to a verified image and a completion record."""

import hashlib
import io
import random
import zipfile

import pytest

from tessera.errors import FormatError, SelectionError
from tessera.plans import updates
from tessera.sources import payload

B = 4096


def noise(n, seed=1):
    return random.Random(seed).randbytes(n)


def archive(body, meta="ota-type=AB\npre-build-incremental=base1\nsource-ap-name=AP_XYZ1_9.tar.md5\n", extra=()):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("payload.bin", body)
        z.writestr(updates.METADATA, meta)
        z.writestr(updates.SCRIPT, 'ui_print("source binary QB info\\nBL_1.tar");')
        for name in extra:
            z.writestr(name, b"")
    return bytearray(out.getvalue())


@pytest.fixture
def update(spark):
    old, tail = noise(3 * B), noise(B + 100, 2)
    new = old[B : 2 * B] + old[:B] + tail.ljust(2 * B, b"\0")
    parts = [
        {"name": "system", "old": old, "new": new, "ops": [(4, b"", [(1, 1), (0, 1)], [(0, 2)]), (0, tail.ljust(2 * B, b"\0"), [], [(2, 2)])]},
        {"name": "vendor", "new": bytes(2 * B), "ops": [(6, b"", [], [(0, 2)])]},
    ]
    files = spark.createDataFrame([("u.zip", archive(payload.make(parts)))], "path string, content binary")
    base = updates.blocks_of(spark.createDataFrame([("system", bytearray(old))], "partition string, content binary"))
    return files, base, {"system": new, "vendor": bytes(2 * B)}


def test_inspect_plan_merge_record(spark, update):
    files, base, want = update
    seen = updates.inspect(files).first()
    assert (seen.kind, seen.problem, seen.base_ap) == ("ab", None, "XYZ1")
    assert seen.hints == ["AP_XYZ1_9.tar.md5", "BL_1.tar"]
    images = updates.merge(updates.plan(files), base).cache()
    assert {r.partition: bytes(r.content) for r in images.collect()} == want
    assert {r.partition: r.sha256 for r in images.collect()} == {k: hashlib.sha256(v).hexdigest() for k, v in want.items()}
    done = updates.records(images.filter("partition = 'vendor'"), 1)
    left = updates.plan(files, done=done).select("partition").distinct().collect()
    assert [r.partition for r in left] == ["system"]
    only = updates.plan(files, ["ven*"]).select("partition").distinct().collect()
    assert [r.partition for r in only] == ["vendor"]
    with pytest.raises(SelectionError):
        updates.plan(files, ["boot"])


def test_wrong_bases_and_archives_are_refused(spark, update):
    files, base, _ = update
    wrong = base.withColumn("data", base["data"].substr(2, 5000))
    with pytest.raises(Exception, match="hash differs|another size"):
        updates.merge(updates.plan(files), wrong).collect()
    body = payload.make([{"name": "p", "new": bytes(B), "ops": [(6, b"", [], [(0, 2)])]}])
    with pytest.raises(FormatError, match="outside"):
        updates.plan(spark.createDataFrame([("u", archive(body))], files.schema))
    with pytest.raises(FormatError, match="another kind"):
        updates.plan(spark.createDataFrame([("u", archive(body, "ota-type=BLOCK\n"))], files.schema))


def test_base_images(spark):
    listing = spark.createDataFrame([("/d/system_a.img",), ("/d/system_b.img",), ("/d/vendor.img.lz4",), ("/d/VENDOR.raw",), ("/e/boot.img",), ("/f/boot.img",)], "path string")
    want = spark.createDataFrame([("system",), ("vendor",), ("odm",)], "partition string")
    got = {r.partition: r.path for r in updates.base_images(listing, want).collect()}
    assert got == {"system": "/d/system_a.img", "vendor": "/d/vendor.img.lz4", "odm": None}
    with pytest.raises(Exception, match="several base images"):
        updates.base_images(listing, spark.createDataFrame([("boot",)], want.schema)).collect()

"""Resuming, choosing bases and versions, batches, and what archives say of themselves."""

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.operators import catalog, hierarchy, metadata, resume
from tessera.plans import updates
from tessera.sources import payload

from .test_updates import B, archive


def test_valid_ranges(spark):
    make = lambda k, *parts, total=32, recorded=32, have=20: [(k, s, e, o, total, recorded, have) for s, e, o in parts]
    rows = make("ok", (0, 15, 16), (16, 31, 24)) + make("gap", (0, 7, 0), (16, 31, 16)) + make("short", (0, 15, 0)) + make("size", (0, 31, 0), recorded=31)
    rows += make("offset", (0, 31, 40)) + make("grid", (0, 15, 8), (16, 31, 17)) + make("null", (0, 31, None))
    df = spark.createDataFrame(rows, "k string, start long, end long, offset long, total long, recorded long, file_size long")
    got = [(r.k, r.start, r.offset) for r in resume.valid_ranges(df, ["k"], alignment=8).orderBy("k", "start").collect()]
    assert got == [("ok", 0, 16), ("ok", 16, 16)]
    assert resume.valid_ranges(df.limit(0), ["k"]).count() == 0


def test_indexes(spark):
    schema = "k string, identity string, version int, complete boolean, name string, size long, offset_data long, at int"
    rows = [("a", "x", 1, True, "m", 10, 0, 1), ("a", "x", 1, True, "n", 10, 91, 1), ("b", "x", 1, False, "m", 10, 90, 1), ("c", "y", 1, True, "m", 1, 0, 1), ("d", "x", 2, True, "m", 1, 0, 1), ("e", "x", 1, None, "m", 1, 0, 1)]
    now = spark.createDataFrame([(k, "x", 100) for k in "abcde"], "k string, identity string, length long")
    df = spark.createDataFrame(rows, schema)
    assert [r.k for r in resume.valid_indexes(df, now, ["k"]).collect()] == ["b"]
    saved = spark.createDataFrame([("a", 1, False, 10, 90), ("a", 2, True, 1, 0), ("b", 1, False, 10, 90), ("b", 2, False, 5, 5)], "k string, at int, complete boolean, size long, offset_data long")
    assert sorted(tuple(r) for r in resume.best_index(saved, ["k"], "at").collect()) == [("a", True, 1, 2), ("b", False, 100, 1)]
    far = spark.createDataFrame([(1, 8 << 20, False), (1, (8 << 20) + 1, True), (64 << 20, 30 << 20, False)], "size long, at long, want boolean")
    assert all(r.got == r.want for r in far.select(resume.prefers_index(F.col("size"), F.col("at")).alias("got"), "want").collect())


def test_batches(spark):
    df = spark.createDataFrame([("a", 1, "complete"), ("a", 2, "failed"), ("a", 3, "failed"), ("b", 1, "planned")], "k string, i int, status string")
    assert sorted(tuple(r) for r in resume.batch_summary(df, ["k"], "i").collect()) == [("a", 3, 2, 1), ("b", 1, 0, 0)]
    assert sorted(tuple(r) for r in resume.batch_summary(df, ["k"], "i", fail_fast=True).collect()) == [("a", 2, 1, 1), ("b", 1, 0, 0)]
    files = spark.createDataFrame([("a.json", '[{"model": "X", "threads": 3}]'), ("b.toml", '[[downloads]]\nmodel = "Y"\nresume = true')], "path string, text string")
    got = {r.path: r.job for r in metadata.batch_jobs(files).collect()}
    assert got == {"a.json": {"model": "X", "threads": "3"}, "b.toml": {"model": "Y", "resume": "true"}}
    for bad in (("a.json", "{"), ("a.json", "[1]"), ("a.toml", "x = 1"), ("a.json", None)):
        with pytest.raises(Exception, match="a[.]"):
            metadata.batch_jobs(spark.createDataFrame([bad], files.schema)).collect()


def test_bundle_info(spark):
    body = lambda status, put: f"<M><FUSBody><Results><Status>{status}</Status></Results><Put>{put}</Put></FUSBody></M>"
    put = "<BINARY_FILE_NAME><Data> f.zip </Data></BINARY_FILE_NAME><BINARY_BYTE_SIZE><Data>12</Data></BINARY_BYTE_SIZE><MODEL_PATH><Data/></MODEL_PATH>"
    seen = metadata.bundle_info(spark.createDataFrame([(body("S00", put),)], "x string"), "x").first()
    assert (seen.filename, seen.bytes, seen.path, seen.latest) == ("f.zip", 12, "", None)
    for bad, what in ((body("500", put), "status 500"), (body("200", put.replace("12", "1x")), "bad size"), (body("200", ""), "no bundle"), (body("200", put.replace("<MODEL_PATH><Data/></MODEL_PATH>", "")), "no bundle")):
        with pytest.raises(Exception, match=what):
            metadata.bundle_info(spark.createDataFrame([(bad,)], "x string"), "x").collect()


def test_choosing_versions(spark):
    rows = [("a", "1/2/3", "1", 1), ("a", "1/2/3/1", "90", 2), ("b", "9/9/9", "90", 1)]
    df = spark.createDataFrame(rows, "k string, version string, idx string, i int")
    assert {r.k: r.i for r in catalog.chosen(df, ["k"], "version", "idx", ["i"]).collect()} == {"a": 1, "b": 1}
    assert {r.k: r.i for r in catalog.chosen(df, ["k"], "version", "idx", ["i"], "1/2/3").collect()} == {"a": 2}


def test_bases(spark):
    rows = [("AB1", "C1", "SM-AB", None, None), ("AB1", "C1", "SM-XY", None, "the base belongs to another model"), ("AB1", "C1", "ab", "ab2/c1/", "another base AP is needed"), ("AB1", "C1", "AB", "AB1/C2/x", "another base CSC is needed"), (None, None, "AB", "q", None)]
    df = spark.createDataFrame(rows, "ap string, csc string, model string, version string, want string")
    got = df.select(metadata.base_problem(F.col("ap"), F.col("csc"), F.col("model"), F.col("version")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got), got
    history = spark.createDataFrame([("m", "A/B/C/D"), ("m", "A/B/E/D"), ("m", "A/B/C")], "k string, version string")
    want = spark.createDataFrame([("m", "A", "B", None, 0), ("m", "Z", "Z", "a/b/e", 1), ("m", "A", "B", "p/q/r/s", 2), ("m", "A", "B", "A//c/", 3)], "k string, ap string, csc string, given string, i int")
    found = metadata.base_matches(want, history, ["k"], "version", "ap", "csc", "given").collect()
    assert {r.i: r.base for r in found} == {0: None, 1: "A/B/E/D", 2: "P/Q/R/S", 3: "A/B/C/D"}


def test_payload_properties(spark):
    body = payload.make([{"name": "p", "new": bytes(B), "ops": [(6, b"", [], [(0, 1)])]}])
    size = 24 + int.from_bytes(body[12:20], "big")
    digest = base64.b64encode(hashlib.sha256(body[:size]).digest()).decode()
    good = f"FILE_SIZE={len(body)}\nMETADATA_SIZE={size}\nMETADATA_HASH={digest}\n"

    def problem(said, **how):
        import io
        import zipfile

        raw = io.BytesIO(bytes(archive(body, "source-csc-name=HOME_CSC_OMC_xyz1_a.tar\n")))
        with zipfile.ZipFile(raw, "a") as z:
            z.writestr(updates.PROPERTIES, said)
        seen = updates.inspect(spark.createDataFrame([("u", bytearray(raw.getvalue()))], "path string, content binary"), **how).first()
        assert seen.base_csc == "XYZ1"
        return seen.problem

    assert problem(good) is None and problem("") is None
    assert problem(good.replace(f"METADATA_SIZE={size}", "METADATA_SIZE=1")) == "payload metadata size differs"
    assert problem(good.replace(f"FILE_SIZE={len(body)}", "FILE_SIZE=1")) == "payload size differs"
    assert problem(good.replace(digest, "AAAA")) == "payload metadata hash differs"
    assert problem(good.replace(digest, "AAAA"), verify=False) is None


def test_streaming_in_place(spark):
    e = lambda *x: [{"start": s, "blocks": n} for s, n in x]
    rows = [(e((0, 2)), e((0, 2)), True), (e((0, 2)), e((1, 2)), False), (e((0, 2), (5, 1)), e((2, 3)), True), (e((None, 9)), e((0, 3)), True), ([], e((0, 1)), True)]
    df = spark.createDataFrame(rows, "src array<struct<start:long,blocks:long>>, dst array<struct<start:long,blocks:long>>, want boolean")
    assert all(r.got == r.want for r in df.select(payload.streams_in_place(F.col("src"), F.col("dst")).alias("got"), "want").collect())


def test_paths_below_the_partition(spark):
    entries = spark.createDataFrame([(2, "system", 3, None), (3, "etc", 4, None), (2, "etc", 5, None)], "parent long, name string, node long, link string")
    want = spark.createDataFrame([("/etc", "system"), ("/etc", "vendor"), ("/none", "system"), ("/x", "system")], "path string, partition string")
    more = entries.unionByName(spark.createDataFrame([(3, "x", 9, None)], entries.schema))
    got = {(r.path, r.partition): r.node for r in hierarchy.resolve_in(want, more, "partition").collect()}
    assert got == {("/etc", "system"): 5, ("/etc", "vendor"): 5, ("/none", "system"): None, ("/x", "system"): 9}

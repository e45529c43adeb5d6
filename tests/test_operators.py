"""Operators on small cases that queries over the driver's tables don't reach."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.errors import FormatError, SelectionError, exit_code
from tessera.functions import text
from tessera import batches
from tessera.operators import catalog, hierarchy, metadata, ranges, rates, schedule, selectors
from tessera.sources import sinks
from tessera.streaming import progress

MIB = 1 << 20


def test_split_of_a_large_download(spark):
    total = 12 << 30
    new = spark.createDataFrame([("k", 0, total - 1, 0)], "k string, start long, end long, offset long")
    parts = ranges.split_ranges(new, ["k"], 4).orderBy("start").collect()
    assert len(parts) == 24 and all(p.end - p.start + 1 == 512 * MIB for p in parts)
    # the first partly done, the fourth complete
    state = [("k", p.start, p.end, p.start + 64 * MIB if i == 0 else p.end + 1 if i == 3 else p.start) for i, p in enumerate(parts)]
    again = ranges.split_ranges(spark.createDataFrame(state, new.schema), ["k"], 2).orderBy("start").collect()
    at = 0
    for p in again:
        assert p.start == at and p.start <= p.offset <= p.end + 1
        at = p.end + 1
    assert at == total and sum(p.offset - p.start for p in again) == 64 * MIB + 512 * MIB
    assert {(p.start, p.end) for p in again if p.offset > p.start} == {(0, 64 * MIB - 1), (3 * 512 * MIB, 4 * 512 * MIB - 1)}
    rows = spark.createDataFrame([(p.start, p.end + 1) for p in again], "s long, e long").withColumns({"k": F.lit("k"), "t": F.lit(total)})
    assert ranges.not_tiling(rows, ["k"], "s", "e", "t").count() == 0
    assert ranges.not_tiling(rows.filter("s > 0"), ["k"], "s", "e", "t").count() == 1
    assert ranges.not_tiling(rows.withColumn("e", F.col("e") + 1), ["k"], "s", "e", "t").count() == 1


def test_interval_pairs_equal_a_nested_loop(spark):
    rng = random.Random(8)
    make = lambda n: [(i % 3, i, s, s + rng.choice([0, 1, 7, 500])) for i in range(n) for s in [rng.randint(0, 300)]]
    a, b = make(120), make(90)
    left = spark.createDataFrame(a, "k int, x int, s long, e long")
    right = spark.createDataFrame(b, "k int, y int, s long, e long")
    want = sorted((p[0], p[1], q[1]) for p in a for q in b if p[0] == q[0] and p[2] < q[3] and q[2] < p[3] and p[2] < p[3] and q[2] < q[3])
    for width in (1, 10, 1000):
        assert sorted(map(tuple, ranges.overlap_pairs(left, right, ["k"], "s", "e", ("x", "y"), width).collect())) == want


def test_range_sets(spark):
    cases = {"2,0,5": 5, "4,10,12,0,3": 5, "4,0,3,2,5": None, "2,5,5": None, "3,0,1": None, "2,0": None, "x": None, "2,-1,4": None, "0": None, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.n for r in df.select("t", ranges.blocks_in(ranges.parse_ranges(F.col("t"))).alias("n")).collect()}
    assert got == cases


def test_selectors(spark):
    names = ["AP_X_1.tar.md5", "dir/BL_Y.tar.md5", "home_csc.bin", "super.img.lz4", "a[1].bin"]
    entries = spark.createDataFrame([(n,) for n in names], "name string")
    pick = lambda *s: {r.name: r.selector for r in selectors.select(entries, "name", list(s)).collect()}
    assert pick("ap, bl", "SUPER.img.lz4") == {"AP_X_1.tar.md5": 0, "dir/BL_Y.tar.md5": 1, "super.img.lz4": 2}
    assert pick("*.bin", "home") == {"home_csc.bin": 0, "a[1].bin": 0}
    assert pick("?p_*", "[!a]*.lz4") == {"AP_X_1.tar.md5": 0, "super.img.lz4": 1}
    assert {r[0] for r in selectors.unmatched(entries, "name", ["ap,zz", "q*"]).collect()} == {"zz", "q*"}
    with pytest.raises(SelectionError) as e:
        selectors.require_all(entries, "name", ["ap", "zz"])
    assert exit_code(e.value) == 2 and exit_code(None) == 0 and exit_code(KeyboardInterrupt()) == 130 and exit_code(FormatError("x")) == 1


def test_versions_and_codes(spark):
    cases = [("A/B/C", "A/B/C/A"), (" A / B / ", "A/B/A/A"), ("A/B/C/D", "A/B/C/D"), ("A/B//D", "A/B/A/D"), ("A", "A")]
    df = spark.createDataFrame(cases, "v string, want string")
    assert df.filter(catalog.normal_version(F.col("v")) != F.col("want")).count() == 0
    rates_ = [("500", 500), ("10K", 10240), ("1.5MiB", 1572864), ("2gb", 2 << 30), ("0", None), ("-1", None), ("x", None), ("1T", 1 << 40)]
    df = spark.createDataFrame(rates_, "t string, want long")
    assert df.filter(~text.parse_rate(F.col("t")).eqNullSafe(F.col("want"))).count() == 0
    sizes = [(0, "0 B"), (1023, "1023 B"), (1024, "1.00 KiB"), (1536 * 1024, "1.50 MiB"), (5 << 40, "5.00 TiB"), (5000 << 40, "5000.00 TiB")]
    df = spark.createDataFrame(sizes, "n long, want string")
    assert df.filter(text.human_bytes(F.col("n")) != F.col("want")).count() == 0


def test_rates_reset_and_stall(spark):
    rows = [("k", t, n) for t, n in [(0.0, 0), (1.0, 100), (2.0, 200), (3.0, 400), (4.0, 400), (5.0, 400), (5.5, 50), (6.0, 150)]]
    df = spark.createDataFrame(rows, "k string, t double, n long")
    got = {r.t: (r.speed, r.eta_speed) for r in rates.sliding_rate(df, ["k"], "t", "n").collect()}
    assert got == {0.0: (0, 0), 1.0: (100, 100), 2.0: (100, 100), 3.0: (150, pytest.approx(400 / 3)), 4.0: (100, 100), 5.0: (0, 0), 5.5: (0, 0), 6.0: (200, 200)}


def test_write_after_read_order_breaks_cycles(spark):
    cost = spark.createDataFrame([("p", 0, 5), ("p", 1, 2), ("p", 2, 9), ("p", 3, 1)], "k string, op long, cost long")
    # 0 reads what 1 writes, 1 what 0 writes; 2 reads what 3 writes
    edges = spark.createDataFrame([("p", 0, 1), ("p", 1, 0), ("p", 2, 3)], "k string, reader long, writer long")
    got = [(r.save, r.op) for r in schedule.order(cost, edges, "k").orderBy("position").collect()]
    assert got == [(False, 2), (False, 3), (True, 1), (False, 0), (False, 1)]


def test_extent_trees(spark):
    rows = [("f", 0, 1, 0, 0, 0), ("f", 0, 2, 8, 0, 0), ("f", 1, None, 0, 8, 100), ("f", 2, None, 8, 2, 50), ("g", 0, None, 0, 1, 7)]
    nodes = spark.createDataFrame(rows, "file string, node long, child long, logical long, blocks long, physical long")
    got = sorted(map(tuple, hierarchy.flatten_extents(nodes).collect()))
    assert got == [("f", 0, 8, 100), ("f", 8, 2, 50), ("g", 0, 1, 7)]
    loop = spark.createDataFrame([("f", 0, 0, 0, 0, 0)], nodes.schema)
    with pytest.raises(Exception, match="too deep"):
        hierarchy.flatten_extents(loop).collect()


def test_paths(spark):
    cases = [("/a/b", True), ("a/b", False), ("/a//b", False), ("/a/../b", False), ("/a\\b", False), ("/", False), (None, False)]
    df = spark.createDataFrame(cases, "p string, want boolean")
    assert df.filter(hierarchy.is_safe(F.col("p")) != F.col("want")).count() == 0
    paths = spark.createDataFrame([("/system/a",), ("/vendor/b",), ("/system/c",)], "p string")
    assert {r["first"]: r.paths for r in hierarchy.grouped_paths(paths, "p").collect()} == {"system": ["/system/a", "/system/c"], "vendor": ["/vendor/b"]}


def test_metadata_problems(spark):
    cases = [(["payload.bin"], "", None), (["payload.bin"], "block", "declared to be another kind"), (["x"], "", "neither a payload nor transfer lists"), (["a", "a"], "", "entry names repeat"), (["s.transfer.list"], "BLOCK", None)]
    df = spark.createDataFrame(cases, "n array<string>, d string, want string")
    assert df.filter(~metadata.problems(F.col("n"), F.col("d")).eqNullSafe(F.col("want"))).count() == 0
    assert df.filter(metadata.problems(F.col("n"), F.col("d"), "ab") == "not the requested kind").count() == 1


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("out", "b", 2), ("out", "a", 1)], "path string, name string, size long")
    sinks.write_manifests(rows, str(tmp_path / "m"), ["path"], F.struct("name", "size"))
    assert [r.value for r in spark.read.text(str(tmp_path / "m")).collect()] == ['{"entries":[{"name":"a","size":1},{"name":"b","size":2}],"manifest_version":1}']
    state = str(tmp_path / "s")
    for at, ok in ((1, False), (2, True)):
        sinks.record(spark.createDataFrame([("o", "x", "d", ok, at)], "ota string, name string, sha256 string, verified boolean, at int"), state)
    assert [(r.name, r.verified) for r in sinks.completed(spark, state).collect()] == [("x", True)]
    chunks = spark.createDataFrame([("i", 0, bytearray(b"abc")), ("i", 4, bytearray(4)), ("j", 0, bytearray(b"\0x0"))], "image string, off long, data binary")
    sinks.write_chunks(chunks, str(tmp_path / "c"))
    back = spark.read.parquet(str(tmp_path / "c"))
    assert sorted((r.image, r.off, bytes(r.data)) for r in back.collect()) == [("i", 0, b"abc"), ("j", 0, b"\0x0")]
    assert [(r.image, r.off) for r in sinks.pending_chunks(chunks, back).collect()] == [("i", 4)]


def test_streaming_speeds_and_windows(spark, tmp_path):
    rows = [("k", t, n) for t, n in [(0.0, 0), (1.0, 100), (2.0, 200), (3.0, 400), (5.0, 400), (5.5, 50), (6.0, 150)]]
    df = spark.createDataFrame(rows, "k string, t double, n long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = progress.speeds(stream, "k", "t", "n").writeStream.format("memory").queryName("speeds").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {r.t: r.speed for r in spark.table("speeds").collect()}
    want = {r.t: r.speed for r in rates.sliding_rate(df, ["k"], "t", "n").collect()}
    assert got == pytest.approx(want)
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    events.coalesce(1).write.parquet(str(tmp_path / "ev"))
    s = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    q = progress.windowed(s, "user_id", "ts", "value").writeStream.format("memory").queryName("wins").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("wins").count() >= 0


def test_eta_has_two_digits_and_unknown_totals(spark):
    rows = [(10, 100, 1.0, False, "01:30"), (100, 100, 0.0, False, "00:00"), (0, 7200, 1.0, False, "02:00:00"), (5, 0, 3.0, False, "--:--"), (5, 0, 3.0, True, "00:00"), (5, 9, 0.0, False, "--:--"), (5, 9, 1.0, True, "--:--"), (0, 360000, 1.0, False, "100:00:00")]
    df = spark.createDataFrame(rows, "done long, total long, speed double, complete boolean, want string")
    got = df.select(text.eta(F.col("done"), F.col("total"), F.col("speed"), F.col("complete")).alias("eta"), "want").collect()
    assert all(r.eta == r.want for r in got), got


def test_rates_are_read_whole(spark):
    rows = [("500", 500), (" 10 M\t", 10 << 20), ("1.5GiB", 3 << 29), ("2kb", 2048), ("1t", 1 << 40), ("0", None), ("1.", None), (".5K", None), ("1.2.3", None), ("5X", None), ("", None), ("-1", None), (None, None)]
    df = spark.createDataFrame(rows, "t string, want long")
    assert all(r.got == r.want for r in df.select(text.parse_rate(F.col("t")).alias("got"), "want").collect())


def test_selectors_of_archives_and_of_updates(spark):
    names = spark.createDataFrame([(n,) for n in ("dir/a_x.img", "dir\\\\b.img".replace("\\\\", "\\"), "system", "system_ext", "Boot.img", "x[1].bin")], "name string")
    fit = lambda f, s: {r.name for r in names.filter(f(F.col("name"), s)).collect()}
    assert fit(selectors.matches, "dir/a") == {"dir/a_x.img"} == fit(selectors.matches, "A")
    assert fit(selectors.matches, "dir/b.img") == {"dir\\b.img"} == fit(selectors.matches, "b.img")
    assert fit(selectors.matches, "x[1].bin") == {"x[1].bin"}
    assert fit(selectors.matches, "system") == {"system", "system_ext"}
    assert fit(selectors.matches_target, "system") == {"system"}
    assert fit(selectors.matches_target, "boot") == {"Boot.img"} and fit(selectors.matches_target, "sys*") == {"system", "system_ext"}
    with pytest.raises(SelectionError):
        selectors.require_all(names, "name", [" ", ","])


def test_history_reads_xml_as_xml(spark):
    xml = """<L><BINARY_INFO x="1"><BINARY_SW_VERSION a='b'><Data><![CDATA[V1]]></Data><Data>V2</Data></BINARY_SW_VERSION>
    <!-- <BINARY_INFO> --><N>&quot;q&#39;</N><N> second </N></BINARY_INFO><BINARY_INFO><N/></BINARY_INFO></L>"""
    rows = catalog.release_rows(spark.createDataFrame([(xml,), (None,), ("",)], "x string"), "x").collect()
    assert [(r.version, r.fields["N"], r.position) for r in rows] == [("V1", ["\"q'", "second"], 0)]
    with pytest.raises(Exception, match="well-formed"):
        catalog.release_rows(spark.createDataFrame([(xml[:60],)], "x string"), "x").collect()


def test_gaps_reach_from_zero_to_the_size(spark):
    df = spark.createDataFrame([("a", 10, 20, 50), ("a", 30, 40, 50), ("b", 0, 5, 5)], "k string, s long, e long, n long")
    assert sorted(tuple(r) for r in ranges.gaps(df, ["k"], "s", "e", size="n").collect()) == [("a", 0, 10), ("a", 20, 30), ("a", 40, 50)]


def test_range_sizes(spark):
    mib = 1 << 20
    df = spark.createDataFrame([("a", i, r) for i, r in enumerate([None, 1048576.5, 1048576.5, 3e7])], "k string, i int, r double")
    got = {r.i: r["size"] for r in rates.next_size(df, ["k"], ["i"], "r", 2).collect()}
    assert got == {0: 4 * mib, 1: 16 * mib, 2: mib, 3: mib}


def test_android_versions_and_archive_hints(spark):
    df = spark.createDataFrame([("a (b (c) d)", "b (c"), ("() Android 9", ""), ("( ) 7", ""), ("Android (14)", "14"), ("12", "Android 12")], "t string, want string")
    assert all(r.got == r.want for r in df.select(catalog.android_version(F.col("t")).alias("got"), "want").collect())
    script = 'ui_print ( "[m] Source Binary QB Info\\nA.tar\\nb/c.tar\\n B.TAR.MD5 \\n.tar" );ui_print("source qb\\nC.tar");ui_print("source binary QB informs\\nD.tar")'
    df = spark.createDataFrame([(script,)], "s string")
    assert df.select(metadata.hints(F.create_map(F.lit("source-x-name"), F.lit(" Z.tar ")), F.col("s")).alias("h")).first().h == ["Z.tar", "A.tar", "B.TAR.MD5"]


def test_order_of_many_keys_is_each_keys_own(spark):
    """Keys are ordered together, across batches; until is where the first writer of what an operation reads runs."""
    cost, edges = [], []
    for k in range(300):
        cost += [(k, 10 * i, (k + i) % 3) for i in range(1 + k % 5)]
        edges += [(k, 10 * i, 10 * ((i + 1) % (1 + k % 5))) for i in range(1 + k % 5) if k % 5]  # a circle
    cost, edges = spark.createDataFrame(cost, "k long, op long, cost long"), spark.createDataFrame(edges, "k long, reader long, writer long")
    found = schedule.order(cost, edges, "k")
    assert found.columns == ["k", "position", "op", "save", "until"]
    by: dict = {}
    for r in found.orderBy("k", "position").collect():
        by.setdefault(r.k, []).append((r.position, r.op, r.save, r.until))
    assert sorted(by) == list(range(300)) and by[0] == [(0, 0, False, None)]
    # costs 1, 2, 0: the third saves what the first overwrites, and runs after the second has read
    assert by[7] == [(0, 20, True, 1), (1, 0, False, 2), (2, 10, False, 3), (3, 20, False, None)]
    for own in by.values():
        assert [p for p, *_ in own] == list(range(len(own)))
        assert all(until is None or p < until for p, _, _, until in own)
        assert [s for _, _, s, _ in own].count(True) == (len(own) > 1)


def test_conflicts_are_dealt_by_the_size_of_the_input(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(batches, "SHARE", 100)
    spark.range(50).selectExpr("1L as k", "id as op", "id * 2 as s", "id * 2 + 3 as e").coalesce(1).write.parquet(f"{tmp_path}/x")
    rows = spark.read.parquet(f"{tmp_path}/x")
    assert batches.tasks(rows) > 4
    found = schedule.conflicts(rows, rows, ["k"], 4)
    assert sorted((r.reader, r.writer) for r in found.collect()) == sorted((a, b) for a in range(50) for b in (a - 1, a + 1) if 0 <= b < 50)
    assert batches.tasks(spark.createDataFrame([(1,)], "a int")) == 4  # unknown sizes don't count

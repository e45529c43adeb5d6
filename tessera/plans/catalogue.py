"""More of the catalogue, metadata and scheduling operators as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import batches
from ..functions import text
from ..operators import catalog, metadata, ranges, schedule
from .registry import query, table


def _history(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    info = F.concat(
        F.lit("<BINARY_INFO><BINARY_SW_VERSION><Data>V"), "o_orderkey", F.lit("</Data></BINARY_SW_VERSION><BINARY_INDEX>"),
        F.when(F.col("o_orderkey") % 7 == 0, "90").otherwise(F.col("o_orderkey") % 3), F.lit("</BINARY_INDEX><BINARY_SEQUENCE> "),
        F.when(F.col("o_orderkey") % 5 == 0, "x").otherwise((F.col("o_orderkey") % 11).cast("string")), F.lit(" </BINARY_SEQUENCE><BINARY_NATURE><Data>"), "o_orderpriority",
        F.lit("</Data><Data>not read</Data></BINARY_NATURE><BINARY_NATURE>"), "o_orderstatus", F.lit("</BINARY_NATURE><BINARY_NATURE><Data>"), "o_orderstatus",
        F.lit("</Data></BINARY_NATURE><OS_NAME a='1'>A &amp; <![CDATA[B]]></OS_NAME></BINARY_INFO>"),
    )
    docs = orders.groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_list(F.struct("o_orderkey", info.alias("x"))))["x"], "").alias("x"))
    empty = F.lit("<BINARY_INFO><BINARY_INDEX>1</BINARY_INDEX></BINARY_INFO>")
    docs = docs.select("o_custkey", F.concat(F.lit("<LIST>"), "x", empty, F.lit("</LIST>")).alias("xml"))
    return catalog.release_rows(docs, "xml")


@query("""
SELECT o_custkey, 'V' || o_orderkey AS version, CASE WHEN o_orderkey % 7 = 0 THEN '90' ELSE (o_orderkey % 3)::VARCHAR END AS idx,
  CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE o_orderkey % 11 END::BIGINT AS sequence, o_orderpriority || '|' || o_orderstatus AS natures, 'A & B' AS os FROM orders""")
def release_history_scan(spark, sf_dir):
    f = F.col("fields")
    return _history(spark, sf_dir).select(
        "o_custkey", "version", catalog.field(f, "BINARY_INDEX").alias("idx"), catalog.sequence_value(catalog.field(f, "BINARY_SEQUENCE")).alias("sequence"),
        F.array_join(F.element_at(f, "BINARY_NATURE"), "|").alias("natures"), catalog.field(f, "MISSING", "OS_NAME").alias("os"),
    )


@query("""
SELECT o_custkey, version FROM (SELECT o_custkey, 'V' || o_orderkey AS version, row_number() OVER (PARTITION BY o_custkey
  ORDER BY CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE o_orderkey % 11 END DESC, o_orderkey DESC) AS r FROM orders WHERE o_orderkey % 7 <> 0) WHERE r = 1""")
def latest_history_release(spark, sf_dir):
    f = F.col("fields")
    rows = _history(spark, sf_dir).withColumn("sequence", catalog.sequence_value(catalog.field(f, "BINARY_SEQUENCE")))
    return catalog.latest(rows, ["o_custkey"], "version", ["sequence", "position"], alternate=F.trim(catalog.field(f, "BINARY_INDEX")) == "90")


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, 'V' || o_orderkey % 3 AS version, (o_orderkey % 2)::VARCHAR AS idx, o_orderpriority AS nature, strftime(o_orderdate, '%Y%m%d') AS day FROM orders),
f AS (SELECT o_custkey, version, idx, nature, min(o_orderkey) AS first FROM o GROUP BY 1, 2, 3, 4),
g AS (SELECT o_custkey, version, idx, string_agg(nature, '|' ORDER BY first) AS given, string_agg(nature, '|' ORDER BY nature) AS natures FROM f GROUP BY 1, 2, 3)
SELECT g.*, (SELECT max(day) FROM o WHERE o.o_custkey = g.o_custkey AND o.version = g.version AND o.idx = g.idx) AS open_date FROM g""")
def history_merge(spark, sf_dir):
    tag = lambda name, value: F.concat(F.lit(f"<{name}><Data>"), value, F.lit(f"</Data></{name}>"))
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyyMMdd")
    info = F.concat(
        F.lit("<BINARY_INFO>"), tag("BINARY_SW_VERSION", F.concat(F.lit("V"), k % 3)), tag("BINARY_INDEX", (k % 2).cast("string")),
        tag("BINARY_NATURE", F.col("o_orderpriority")), tag("BINARY_OPEN_DATE", day), F.lit("</BINARY_INFO>"),
    )
    docs = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_list(F.struct("o_orderkey", info.alias("x"))))["x"], "").alias("x"))
    rows = catalog.release_rows(docs.select("o_custkey", F.concat(F.lit("<LIST>"), "x", F.lit("</LIST>")).alias("xml")), "xml")
    out = catalog.merge_history(rows, ["o_custkey"])
    return out.select("o_custkey", "version", "idx", F.array_join(F.element_at("fields", "BINARY_NATURE"), "|").alias("given"), F.array_join("natures", "|").alias("natures"), "open_date")


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'x ' || p_size WHEN 1 THEN 'Android ' || p_size WHEN 2 THEN 'Android ' || p_size ELSE '' END AS android
FROM part""")
def android_versions(spark, sf_dir):
    k = F.col("p_partkey") % 4
    given = F.when(k == 0, F.concat(F.lit("OS (x "), "p_size", F.lit(")"))).when(k == 1, F.concat(F.lit(" Android "), "p_size")).when(k == 2, F.col("p_size").cast("string")).otherwise(F.lit("iOS"))
    return table(spark, sf_dir, "part").select("p_partkey", catalog.android_version(given).alias("android"))


@query("""
SELECT doc_id, lang AS pre_build, n_chars::VARCHAR || '=x' AS post_build, CASE doc_id % 3 WHEN 0 THEN 'ab' WHEN 1 THEN 'block' END AS kind,
  CASE doc_id % 3 WHEN 2 THEN 'neither a payload nor transfer lists' WHEN 1 THEN CASE WHEN doc_id % 2 = 0 THEN 'declared to be another kind' END END AS problem,
  CASE doc_id % 2 WHEN 0 THEN 'AP_' || source || '.tar.md5|' ELSE '' END || 'B_' || doc_id || '.tar' AS hints FROM documents""")
def ota_metadata_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    raw = F.concat(
        F.lit("# comment\n pre-build = "), "lang", F.lit("\r\npost-build=old\npost-build="), "n_chars", F.lit("=x\n\nsource-ap-name="),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("AP_"), "source", F.lit(".tar.md5"))).otherwise("not an archive"), F.lit("\nno value"),
    )
    names = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("payload.bin"), F.lit("x"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("system.transfer.list"))).otherwise(F.array(F.lit("y")))
    script = F.concat(F.lit('ui_print( " [x] Source binary QB info:\\n B_'), "doc_id", F.lit('.tar \\nnot this/one.tar"); ui_print("other\\nC.tar"); ui_print("source binary QB information\\nD.tar");'))
    declared = F.when((F.col("doc_id") % 3 == 1) & (F.col("doc_id") % 2 == 0), "AB").otherwise("")
    p = F.col("props")
    rows = docs.select("doc_id", metadata.properties(raw).alias("props"), names.alias("names"), script.alias("script"), declared.alias("declared"))
    return rows.select(
        "doc_id", F.element_at(p, "pre-build").alias("pre_build"), F.element_at(p, "post-build").alias("post_build"), metadata.detected(F.col("names")).alias("kind"),
        metadata.problems(F.col("names"), F.col("declared")).alias("problem"), F.array_join(metadata.hints(p, F.col("script")), "|").alias("hints"),
    )


@query("""
WITH h AS (SELECT DISTINCT p_brand, upper(p_type) AS ap, upper(split_part(p_name, ' ', 1)) AS csc, upper(p_type || '/' || split_part(p_name, ' ', 1) || '/' || p_size // 10 || '/Z') AS v FROM part WHERE p_size >= 25),
w AS (SELECT DISTINCT p_brand, p_type AS ap, CASE WHEN p_partkey % 2 = 0 THEN split_part(p_name, ' ', 1) ELSE '' END AS csc FROM part)
SELECT w.p_brand, w.ap, w.csc, CASE WHEN count(DISTINCT v) = 1 THEN min(v) END AS base FROM w LEFT JOIN h ON w.p_brand = h.p_brand AND upper(w.ap) = h.ap AND (w.csc = '' OR upper(w.csc) = h.csc) GROUP BY 1, 2, 3""")
def resolve_base_version(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    first = F.substring_index("p_name", " ", 1)
    version = F.concat("p_type", F.lit("/ "), first, F.lit("/"), F.floor(F.col("p_size") / 10), F.lit("/z"))
    history = part.select("p_brand", F.when(F.col("p_size") >= 25, version).otherwise(F.lit("A/B//D")).alias("version"))
    wanted = part.select("p_brand", F.col("p_type").alias("ap"), F.when(F.col("p_partkey") % 2 == 0, first).otherwise("").alias("csc")).distinct()
    return metadata.base_matches(wanted, history, ["p_brand"], "version", "ap", "csc")


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 6 <> 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'M' || c_nationkey WHEN c_custkey % 3 = 1 THEN 'X' END AS model,
  CASE WHEN c_custkey % 3 = 0 AND c_custkey % 6 <> 0 THEN NULL WHEN c_custkey % 3 = 0 THEN upper(c_mktsegment) WHEN c_custkey % 3 = 1 THEN 'Y' END AS region,
  CASE WHEN c_custkey % 6 = 0 OR c_custkey % 3 = 1 THEN 'planned' ELSE 'failed' END AS status FROM customer""")
def profile_jobs(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    body = F.concat(F.lit('{" P'), "c_custkey", F.lit(' ": {"model": "m'), "c_nationkey", F.lit(' ", "region": "'), F.lower("c_mktsegment"), F.lit('"}, "bad": {"model": ""}, "worse": 5}'))
    known = metadata.profiles(customer.filter("c_custkey % 6 = 0").select(body.alias("value")))
    k = F.col("c_custkey") % 3
    jobs = customer.select("c_custkey", F.when(k == 0, F.concat(F.lit("P"), "c_custkey")).alias("profile"), F.when(k == 1, F.lit(" x ")).alias("model"), F.when(k == 1, F.lit("y")).alias("region"))
    return metadata.jobs_with_devices(jobs, known).select("c_custkey", "model", "region", "status")


@query("""
WITH p AS (SELECT doc_id, n_chars * 1000 AS total, CASE doc_id % 3 WHEN 0 THEN 0 WHEN 1 THEN n_chars * 300 ELSE n_chars * 1000 END AS done FROM documents WHERE n_chars > 0),
g AS (SELECT *, least(1048576 * 32, greatest(65536, ceil(ceil((total - done) / 8) / 65536) * 65536))::BIGINT AS grid FROM p)
SELECT doc_id, 0::BIGINT AS s, done - 1 AS e, done AS offset_ FROM g WHERE done > 0
UNION ALL SELECT doc_id, greatest(done, c * grid), least(total, (c + 1) * grid) - 1, greatest(done, c * grid) FROM (SELECT *, unnest(range(done // grid, (total - 1) // grid + 1)) AS c FROM g WHERE done < total)""")
def resume_resplit(spark, sf_dir):
    total = F.col("n_chars") * 1000
    k = F.col("doc_id") % 3
    done = F.when(k == 0, 0).when(k == 1, F.col("n_chars") * 300).otherwise(total)
    half = F.floor(total / 2)
    docs = table(spark, sf_dir, "documents").filter("n_chars > 0").select("doc_id", total.alias("total"), half.alias("half"), done.alias("done"))
    # two neighbouring ranges with a common state, as an interrupted copy leaves them
    two = F.array(F.struct(F.lit(0).cast("long").alias("start"), (F.col("half") - 1).alias("end")), F.struct(F.col("half").alias("start"), (F.col("total") - 1).alias("end")))
    rows = docs.select("doc_id", "done", F.explode(two).alias("r")).select("doc_id", "r.start", "r.end", F.greatest("r.start", F.least("done", F.col("r.end") + 1)).alias("offset"))
    grid = ranges.split_ranges(rows, ["doc_id"], 4, step=65536)
    return grid.select("doc_id", F.col("start").alias("s"), F.col("end").alias("e"), F.col("offset").alias("offset_"))


@query("""
WITH b AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN NULL ELSE event_id // 3 + row_number() OVER w END AS phys, row_number() OVER w AS log FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY log ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN phys = lag(phys) OVER w + 1 OR (phys IS NULL AND lag(phys) OVER w IS NULL AND log > 1) THEN 0 ELSE 1 END AS new FROM b WINDOW w AS (PARTITION BY user_id ORDER BY log)))
SELECT user_id, min(log) AS logical, min(phys)::BIGINT AS physical, count(*) AS blocks FROM (SELECT *, (row_number() OVER (PARTITION BY user_id, run ORDER BY log) - 1) // 4 AS part FROM r) GROUP BY user_id, run, part""")
def file_block_runs(spark, sf_dir):
    from pyspark.sql import Window

    log = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    rows = table(spark, sf_dir, "events").withColumn("logical", log)
    phys = F.when(F.col("event_type") != "error", F.floor(F.col("event_id") / 3) + F.col("logical"))
    runs = ranges.file_runs(rows.select("user_id", "logical", phys.alias("physical")), ["user_id"], "logical", "physical", 4)
    return runs.select("user_id", "logical", "physical", "blocks")


def _operations(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_linenumber").cast("long").alias("n"))
    from pyspark.sql import Window

    op = F.row_number().over(Window.partitionBy("k").orderBy("n", "l_partkey", "l_suppkey", "l_extendedprice")).cast("long") - 1
    ops = batches.dealt(lines, ["k"]).withColumn("op", op).select("k", "op", F.col("l_partkey").alias("p"))
    targets = ops.select("k", "op", (F.col("op") * 2).alias("s"), (F.col("op") * 2 + 2).alias("e"))
    sources = ops.select("k", "op", (F.col("p") % 9).alias("s"), (F.col("p") % 9 + 1 + F.col("p") % 3).alias("e"))
    return ops, sources, targets


_OPS = """WITH o AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS op, l_partkey AS p FROM lineitem)"""


@query(_OPS + """ SELECT r.k, r.op AS reader, w.op AS writer FROM o r JOIN o w ON r.k = w.k AND r.op <> w.op AND r.p % 9 < w.op * 2 + 2 AND w.op * 2 < r.p % 9 + 1 + r.p % 3""")
def write_after_read(spark, sf_dir):
    _, sources, targets = _operations(spark, sf_dir)
    return schedule.conflicts(sources, targets, ["k"], 4)


@query(_OPS + " SELECT k, count(*) AS runs, true AS ordered FROM o GROUP BY 1")
def operation_order(spark, sf_dir):
    ops, sources, targets = _operations(spark, sf_dir)
    edges = schedule.conflicts(sources, targets, ["k"], 4)
    cost = ops.select("k", "op", (1 + F.col("p") % 3).alias("cost"))
    order = schedule.order(cost, edges, "k")
    # each reader runs, or has saved its source, before its writers run
    late = F.coalesce(F.max(F.col("position") >= F.col("until")), F.lit(False))
    return order.groupBy("k").agg(F.count_if(~F.col("save")).alias("runs"), (~late).alias("ordered"))


@query("""
WITH x AS (SELECT o_orderkey, o_orderkey % 100 AS done, CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE o_orderkey % 7 + 0.5 END AS speed, CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE 100000 END AS total FROM orders),
s AS (SELECT *, ceil((total - done) / nullif(speed, 0))::BIGINT AS s FROM x)
SELECT o_orderkey, CASE WHEN total > 0 AND done >= total THEN '00:00' WHEN total = 0 OR speed = 0 THEN '--:--' ELSE
  CASE WHEN s >= 3600 THEN lpad((s // 3600)::VARCHAR, greatest(2, length((s // 3600)::VARCHAR))::INT, '0') || ':' ELSE '' END
  || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') END AS eta FROM s""")
def eta_text(spark, sf_dir):
    k = F.col("o_orderkey")
    speed = F.when(k % 10 == 0, 0.0).otherwise(k % 7 + 0.5)
    total = F.when(k % 13 == 0, 0).otherwise(100_000)
    return table(spark, sf_dir, "orders").select("o_orderkey", text.eta(k % 100, total, speed).alias("eta"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN -n_chars * 70001 ELSE n_chars * 70001 END AS number, n_chars % 65536 AS low FROM documents")
def signed_numbers(spark, sf_dir):
    size = F.col("n_chars") * 70001
    big = F.lpad(F.hex(size), 16, "0")
    big = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("8"), F.substr(big, F.lit(2)))).otherwise(big)
    raw = F.unhex(F.array_join(F.reverse(F.regexp_extract_all(big, F.lit("(..)"), 1)), ""))
    low = F.unhex(F.concat(F.lit("FFFF"), F.array_join(F.reverse(F.regexp_extract_all(F.lpad(F.hex(F.col("n_chars") % 65536), 4, "0"), F.lit("(..)"), 1)), "")))
    return table(spark, sf_dir, "documents").select("doc_id", text.signed_magnitude(raw).alias("number"), text.little_endian(low, 2, 2).alias("low"))

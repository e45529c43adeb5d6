"""The operators as queries over the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import crypto, text
from ..operators import catalog, hierarchy, integrity, ranges, rates, selectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
HOUR = 3600.0


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(column: str):
    """Seconds since the epoch of a timestamp without zone, whole microseconds."""
    return F.unix_micros(F.col(column).cast("timestamp")) / F.lit(1e6)


# ---------------------------------------------------------------- catalogue


@query("""
SELECT o_custkey, year(o_orderdate) AS order_year, array_to_string(list_sort(list_distinct(list(o_orderpriority))), '|') AS natures,
       max(o_orderdate) AS latest, count(*) AS n_rows
FROM orders GROUP BY 1, 2""")
def merge_release_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("order_year", F.year("o_orderdate").cast("long"))
    out = catalog.merge_rows(rows, ["o_custkey", "order_year"], "o_orderpriority", "o_orderdate")
    return out.select("o_custkey", "order_year", F.array_join("merged", "|").alias("natures"), "latest", "n_rows")


@query("""
SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r
FROM orders WHERE o_orderstatus <> 'P') WHERE r = 1""")
def latest_release(spark, sf_dir):
    return catalog.latest(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", ["o_orderdate", "o_orderkey"], alternate=F.col("o_orderstatus") == "P")


@query("""
SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'
GROUP BY 1 HAVING count(DISTINCT o_orderkey) = 1""")
def resolve_unique_base(spark, sf_dir):
    condition = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F")
    return catalog.unique_match(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", condition)


@query("""
WITH b AS (SELECT DISTINCT l_partkey, c_mktsegment AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND year(l_shipdate) = 1998)
SELECT l_partkey, CASE WHEN count(*) = 2 THEN 'common' WHEN max(s) = 'BUILDING' THEN 'only_a' ELSE 'only_b' END AS found FROM b GROUP BY 1""")
def compare_regions(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").filter(F.year("l_shipdate") == 1998).select("l_orderkey", "l_partkey")
    customers = table(spark, sf_dir, "customer").filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_partkey", "c_mktsegment")
    return catalog.compare_sets(rows, "l_partkey", F.col("c_mktsegment"), "BUILDING", "MACHINERY")


@query("""
WITH u AS (SELECT p_partkey // 2 AS pair, p_partkey % 2 AS s, field, value FROM (
  SELECT p_partkey, unnest(['p_name', 'p_brand', 'p_type', 'p_size']) AS field, unnest([p_name, p_brand, p_type, p_size::VARCHAR]) AS value FROM part))
SELECT a.pair, a.field, a.value AS a, b.value AS b FROM u a JOIN u b ON a.pair = b.pair AND a.field = b.field AND a.s = 0 AND b.s = 1
WHERE a.value IS DISTINCT FROM b.value""")
def row_field_diff(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("pair", F.floor(F.col("p_partkey") / 2).cast("long"))
    return catalog.field_diff(rows, "pair", F.col("p_partkey") % 2 == 1, ["p_name", "p_brand", "p_type", "p_size"])


@query("""
SELECT event_id, coalesce(nullif(trim(json_extract_string(props, '$.name')), ''), nullif(trim(CASE WHEN event_id % 3 = 0 THEN '  ' ELSE json_extract_string(props, '$.k') END), ''), event_type) AS label
FROM events""")
def first_non_empty_field(spark, sf_dir):
    k = F.when(F.col("event_id") % 3 == 0, "  ").otherwise(F.get_json_object("props", "$.k"))
    return table(spark, sf_dir, "events").select("event_id", catalog.first_present(F.get_json_object("props", "$.name"), k, F.col("event_type")).alias("label"))


@query("""
WITH p AS (SELECT p_partkey, upper(trim(p_brand)) AS brand, list_transform(string_split(
    p_brand || ' / ' || p_type || CASE p_partkey % 3 WHEN 0 THEN '/ ' WHEN 1 THEN '/' || p_name ELSE '' END, '/'), lambda x: trim(x)) AS a FROM part)
SELECT p_partkey, brand, array_to_string(CASE WHEN len(a) = 3 THEN [a[1], a[2], CASE WHEN a[3] = '' THEN a[1] ELSE a[3] END, a[1]] ELSE a END, '/') AS code FROM p""")
def normalize_code(spark, sf_dir):
    third = F.when(F.col("p_partkey") % 3 == 0, "/ ").when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("/"), "p_name")).otherwise("")
    code = F.concat("p_brand", F.lit(" / "), "p_type", third)
    return table(spark, sf_dir, "part").select("p_partkey", catalog.upper_code(F.col("p_brand")).alias("brand"), catalog.normal_version(code).alias("code"))


# ---------------------------------------------------------------- selectors

_SELECTORS = ["red*,Blue Bolt", "*gear", "?ot anvil, none such", "[so]*bolt"]


@query("""
WITH s(i, g) AS (VALUES (0, 'red*'), (1, 'blue bolt'), (2, '*gear'), (3, '?ot anvil'), (5, '[so]*bolt'))
SELECT p_partkey, p_name, min(i) AS selector FROM part JOIN s ON lower(p_name) GLOB g OR starts_with(lower(p_name), CASE WHEN i = 1 THEN g || '_' ELSE chr(1) END)
GROUP BY 1, 2""")
def selector_match(spark, sf_dir):
    return selectors.select(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", _SELECTORS)


@query("""
WITH s(g) AS (VALUES ('red*'), ('blue bolt'), ('*gear'), ('?ot anvil'), ('none such'), ('[so]*bolt'))
SELECT g AS selector FROM s WHERE NOT EXISTS (SELECT 1 FROM part WHERE lower(p_name) GLOB g)""")
def selector_unmatched(spark, sf_dir):
    return selectors.unmatched(table(spark, sf_dir, "part"), "p_name", _SELECTORS)


@query("""
SELECT s_nationkey, s_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 3, s_acctbal DESC, s_name) AS r FROM supplier) WHERE r = 1""")
def ranked_member_choice(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier")
    return catalog.with_rank(rows, ["s_nationkey"], F.col("s_suppkey") % 3, F.desc("s_acctbal"), F.col("s_name")).select("s_nationkey", "s_suppkey")


_AVAILABLE = "p_name || CASE p_partkey % 4 WHEN 1 THEN '_a' WHEN 2 THEN '_b' ELSE '' END || CASE WHEN p_partkey % 4 = 3 THEN ' x' ELSE '' END"


@query(f"""
WITH have AS (SELECT p_brand || ' ' || {_AVAILABLE} AS entry, sum(CASE WHEN p_size > 3 THEN p_size ELSE 0 END)::BIGINT AS size FROM part GROUP BY 1),
want AS (SELECT DISTINCT p_brand || ' ' || p_name AS name FROM part),
hit AS (SELECT name, h.entry, h.size, row_number() OVER (PARTITION BY name ORDER BY r) AS k
  FROM want, (VALUES ('', 0), ('_a', 1), ('_b', 2)) AS t(suffix, r), have h WHERE h.entry = name || suffix AND (r = 0 OR h.size > 0))
SELECT want.name, entry, size FROM want LEFT JOIN hit ON want.name = hit.name AND k = 1""")
def slot_fallback(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    have = part.groupBy(F.expr(f"p_brand || ' ' || {_AVAILABLE}").alias("name")).agg(F.sum(F.when(F.col("p_size") > 3, F.col("p_size")).otherwise(0)).alias("size"))
    want = part.select(F.expr("p_brand || ' ' || p_name").alias("name")).distinct()
    return selectors.with_slot(want, have, "name", "size")


# ---------------------------------------------------------------- ranges


@query("""
SELECT doc_id, source, (sum(n_chars) OVER w - n_chars)::BIGINT AS target,
       coalesce(doc_id % 997 < max(doc_id % 997 + n_chars % 13) OVER (PARTITION BY source ORDER BY doc_id % 997, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS overlaps
FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)""")
def extent_copy_plan(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", (F.col("doc_id") % 997).alias("at"), (F.col("n_chars") % 13).alias("length"))
    plan = ranges.copy_plan(rows, "source", "doc_id", "at", "length").drop("target")
    return ranges.with_offsets(plan, ["source"], ["doc_id"], "n_chars", "target").select("doc_id", "source", "target", "overlaps")


def _spans(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select("event_id", "user_id", "event_type", seconds("ts").alias("s"), (seconds("ts") + F.col("value") * 60).alias("e"))


_SPANS = "WITH i AS (SELECT event_id, user_id, event_type, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + value * 60 AS e FROM events)"


@query(_SPANS + """
SELECT user_id, event_id FROM (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM i) WHERE s < last""")
def extent_overlap_check(spark, sf_dir):
    return ranges.overlapping(_spans(spark, sf_dir), ["user_id"], "s", "e").select("user_id", "event_id")


@query(_SPANS + """
SELECT a.user_id, a.event_id AS reader, b.event_id AS writer FROM i a JOIN i b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase' AND a.s < b.e AND b.s < a.e""")
def interval_overlap_pairs(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    readers = spans.filter("event_type = 'view'").withColumnRenamed("event_id", "reader")
    writers = spans.filter("event_type = 'purchase'").withColumnRenamed("event_id", "writer")
    return ranges.overlap_pairs(readers, writers, ["user_id"], "s", "e", ("reader", "writer"), HOUR)


@query("""
WITH x AS (SELECT doc_id, source, (sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - n_chars)::BIGINT AS start FROM documents),
p AS (SELECT item_id, 'src' || (item_id % 20) AS source, item_id * 7919 % 400000 AS at FROM benchmark)
SELECT p.item_id, p.source, p.at, x.start AS hit_start, x.doc_id FROM p ASOF LEFT JOIN x ON p.source = x.source AND p.at >= x.start""")
def asof_extent_lookup(spark, sf_dir):
    extents = ranges.with_offsets(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), ["source"], ["doc_id"], "n_chars", "start")
    points = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("src"), F.col("item_id") % 20).alias("source"), (F.col("item_id") * 7919 % 400000).alias("at"))
    return ranges.lookup(points, extents.filter("n_chars > 0"), ["source"], "at", "start", ["doc_id"], "doc_id")


@query("""
SELECT user_id, event_type, run, count(*) AS n, min(event_id) AS first_event FROM (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM (
    SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS new FROM events))
GROUP BY 1, 2, 3""")
def coalesce_runs(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = ranges.runs(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], [F.col("event_type") == F.lag("event_type").over(w)])
    return rows.groupBy("user_id", "event_type", "run").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("""
WITH x AS (SELECT doc_id, source, n_chars, (sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - n_chars)::BIGINT AS s FROM documents),
c AS (SELECT doc_id, source, s, s + n_chars AS e, unnest(range(s // 4096, (s + n_chars - 1) // 4096 + 1)) AS cell FROM x WHERE n_chars > 0)
SELECT doc_id, greatest(s, cell * 4096) AS part_start, least(e, (cell + 1) * 4096) AS part_end FROM c""")
def split_on_grid(spark, sf_dir):
    rows = ranges.with_offsets(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), ["source"], ["doc_id"], "n_chars", "s")
    rows = rows.withColumn("e", F.col("s") + F.col("n_chars"))
    return ranges.split_on_grid(rows, "s", "e", F.lit(4096)).select("doc_id", "part_start", "part_end")


@query("""
WITH p AS (SELECT o_orderkey, (o_totalprice * 100)::BIGINT AS total FROM orders), q AS (
  SELECT o_orderkey, total, greatest(16, total // (8 * 16) * 16) AS size FROM p), r AS (
  SELECT *, greatest(1, least(8, total // size)) AS n FROM q)
SELECT o_orderkey, i * size AS part_start, CASE WHEN i = n - 1 THEN total - 1 ELSE (i + 1) * size - 1 END AS part_end FROM (SELECT *, unnest(range(n)) AS i FROM r)""")
def even_parts(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("total"))
    rows = rows.select("o_orderkey", F.explode(ranges.even_parts(F.col("total"), 8)).alias("p"))
    return rows.select("o_orderkey", F.col("p.start").alias("part_start"), F.col("p.end").alias("part_end"))


@query(_SPANS + """
SELECT user_id, gap_start, s AS gap_end FROM (
  SELECT *, coalesce(max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gap_start
  FROM (SELECT user_id, s, e FROM i UNION ALL SELECT user_id, max(e) + 1000, max(e) + 1000 FROM i GROUP BY user_id)) WHERE gap_start < s""")
def gap_complement(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    sizes = spans.groupBy("user_id").agg((F.max("e") + 1000).alias("size"))
    return ranges.gaps(spans.join(sizes, "user_id"), ["user_id"], "s", "e", size="size")


@query("""
SELECT l_orderkey, sum(greatest(0, (l_quantity * 100)::BIGINT - l_linenumber * 500))::BIGINT AS done, count(*) AS n FROM lineitem GROUP BY 1""")
def resume_done_bytes(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    start, offset = F.col("l_linenumber").cast("long") * 500, F.round(F.col("l_quantity") * 100).cast("long")
    return rows.groupBy("l_orderkey").agg(ranges.done_bytes(start, offset).alias("done"), F.count("*").alias("n"))


@query("""
WITH r AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n, l_linenumber FROM lineitem)
SELECT k, count(*) AS parts FROM r GROUP BY 1 HAVING max(n <> l_linenumber)""")
def resume_tiling_check(spark, sf_dir):
    # parts that should be [n - 1, n) for n from 1 up, but repeat or leave out line numbers
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("e")).withColumn("s", F.col("e") - 1)
    total = Window.partitionBy("k")
    rows = rows.withColumn("total", F.count("*").over(total))
    bad = ranges.not_tiling(rows, ["k"], "s", "e", "total")
    return bad.join(rows.groupBy("k").agg(F.count("*").alias("parts")), "k")


@query("""
WITH t AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '4,0,' || n_chars || ',' || (n_chars + 5) || ',' || (n_chars + 9)
   WHEN 1 THEN '2,7,' || (7 + n_chars % 3) WHEN 2 THEN '4,0,10,5,12' WHEN 3 THEN '3,1,2' ELSE '2,' || doc_id || ',' || (doc_id + 1 + n_chars) END AS spec, n_chars FROM documents)
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN CASE WHEN n_chars > 0 THEN n_chars + 4 END WHEN 1 THEN nullif(n_chars % 3, 0) WHEN 4 THEN 1 + n_chars END AS blocks FROM t""")
def range_set_grammar(spark, sf_dir):
    spec = F.expr("""CASE doc_id % 5 WHEN 0 THEN '4,0,' || n_chars || ',' || (n_chars + 5) || ',' || (n_chars + 9)
        WHEN 1 THEN '2,7,' || (7 + n_chars % 3) WHEN 2 THEN '4,0,10,5,12' WHEN 3 THEN '3,1,2' ELSE '2,' || doc_id || ',' || (doc_id + 1 + n_chars) END""")
    return table(spark, sf_dir, "documents").select("doc_id", ranges.blocks_in(ranges.parse_ranges(spec)).alias("blocks"))


# ---------------------------------------------------------------- rates

_SAMPLES = """WITH x AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t, CASE WHEN event_id % 37 = 0 THEN 0 ELSE 1 END AS up, (value * 100)::BIGINT AS v FROM events),
r AS (SELECT *, sum(1 - up) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS part FROM x),
d AS (SELECT event_id, user_id, t, sum(CASE WHEN up = 1 THEN v ELSE 0 END) OVER (PARTITION BY user_id, part ORDER BY t ROWS UNBOUNDED PRECEDING)::BIGINT AS done FROM r),"""


def _samples(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", seconds("ts").alias("t"), (F.col("event_id") % 37 != 0).cast("int").alias("up"), F.round(F.col("value") * 100).cast("long").alias("v"))
    w = Window.partitionBy("user_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("part", F.sum(1 - F.col("up")).over(w))
    inner = Window.partitionBy("user_id", "part").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("event_id", "user_id", "t", F.sum(F.col("v") * F.col("up")).over(inner).alias("done"))


@query(_SAMPLES + """
f AS (SELECT *, CASE WHEN done < lag(done) OVER w THEN 1 ELSE 0 END AS fell FROM d WINDOW w AS (PARTITION BY user_id ORDER BY t)),
g AS (SELECT *, sum(fell) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM f),
h AS (SELECT *, max(CASE WHEN rose THEN t END) OVER (PARTITION BY user_id, run ORDER BY t ROWS UNBOUNDED PRECEDING) AS last_rise,
   first(t) OVER (PARTITION BY user_id, run ORDER BY t ROWS UNBOUNDED PRECEDING) AS t0, first(done) OVER (PARTITION BY user_id, run ORDER BY t ROWS UNBOUNDED PRECEDING) AS n0
  FROM (SELECT *, done > coalesce(lag(done) OVER (PARTITION BY user_id, run ORDER BY t), done - 1) AS rose FROM g)),
s AS (SELECT h.*, a.t AS ta, a.done AS na FROM (SELECT *, t - 7200 AS at2, t - 36000 AS at10 FROM h) h ASOF LEFT JOIN g a ON h.user_id = a.user_id AND h.run = a.run AND h.at2 >= a.t),
e AS (SELECT s.*, b.t AS tb, b.done AS nb FROM s ASOF LEFT JOIN g b ON s.user_id = b.user_id AND s.run = b.run AND s.at10 >= b.t)
SELECT event_id, CASE WHEN t - last_rise >= 7200 OR t = coalesce(ta, t0) THEN 0 ELSE round((done - coalesce(na, n0)) / (t - coalesce(ta, t0)), 6) END::DOUBLE AS speed,
  CASE WHEN t - last_rise >= 7200 OR t = coalesce(tb, t0) THEN 0 ELSE round((done - coalesce(nb, n0)) / (t - coalesce(tb, t0)), 6) END::DOUBLE AS eta_speed FROM e""")
def sliding_rate(spark, sf_dir):
    out = rates.sliding_rate(_samples(spark, sf_dir), ["user_id"], "t", "done", short=2 * HOUR, long=10 * HOUR)
    return out.select("event_id", F.round("speed", 6).alias("speed"), F.round("eta_speed", 6).alias("eta_speed"))


@query("""
WITH w AS (SELECT event_id, min(v) OVER k AS lo, max(v) OVER k AS hi, median(v) OVER k AS mid FROM (SELECT *, value * 50000 AS v FROM events)
  WINDOW k AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))
SELECT event_id, CASE WHEN lo IS NULL THEN 4194304 ELSE least(16777216, greatest(1048576, ceil(floor(CASE WHEN lo * 2 < hi THEN lo ELSE mid END) / 1048576) * 1048576)) END::BIGINT AS size FROM w""")
def rolling_range_size(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("v", F.col("value") * 50000)
    return rates.next_size(rows, ["user_id"], ["ts", "event_id"], "v", 6).select("event_id", "size")


@query("""
WITH x AS (SELECT *, epoch_us(ts) AS t, (value * 100)::BIGINT * 1000000 AS cost FROM events),
y AS (SELECT *, sum(cost) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total FROM x)
SELECT event_id, (max(t - total + cost) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) + total)::BIGINT AS finish FROM y""")
def virtual_clock(spark, sf_dir):
    cost = F.round(F.col("value") * 100).cast("long") * 1_000_000
    out = rates.limited(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.unix_micros(F.col("ts").cast("timestamp")), cost)
    return out.select("event_id", "finish")


# ---------------------------------------------------------------- aggregates and integrity


@query("""
SELECT user_id, count(*) FILTER (event_type = 'view') AS n_view, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'purchase') AS n_purchase,
  count(*) FILTER (event_type = 'error') AS n_error, count(*) FILTER (event_type = 'signup') AS n_signup FROM events GROUP BY 1""")
def op_histogram(spark, sf_dir):
    kinds = ["view", "click", "purchase", "error", "signup"]
    return table(spark, sf_dir, "events").groupBy("user_id").agg(*[F.count_if(F.col("event_type") == k).alias(f"n_{k}") for k in kinds])


@query("SELECT md5(text) AS name, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(spark, sf_dir):
    return integrity.duplicates(table(spark, sf_dir, "documents"), F.md5(F.col("text").cast("binary")), F.min("doc_id").alias("first_doc"))


@query("SELECT doc_id, sha256(text) AS sha256, sha1(text) AS sha1, md5(text) AS md5, strlen(text) AS size FROM documents")
def content_digests(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    made = integrity.digests(F.col("text"))
    return docs.select("doc_id", *[v.alias(k) for k, v in made.items()], F.octet_length("text").cast("long").alias("size"))


@query("SELECT source, sha256(string_agg(doc_id || ':' || n_chars || ':' || lang, chr(10) ORDER BY doc_id)) AS identity FROM documents GROUP BY 1")
def identity_digest(spark, sf_dir):
    parts = [F.col(c).cast("string") for c in ("doc_id", "n_chars", "lang")]
    return integrity.identity(table(spark, sf_dir, "documents"), ["source"], ["doc_id"], parts)


@query("SELECT doc_id, true AS equal FROM documents")
def crc32_merge(spark, sf_dir):
    data = F.col("text").cast("binary")
    parts = F.transform(crypto.chunks(data, 1000), lambda c: F.struct(F.crc32(c["data"]).alias("crc"), F.octet_length(c["data"]).alias("len")))
    return table(spark, sf_dir, "documents").select("doc_id", (integrity.crc32_fold(parts) == F.crc32(data)).alias("equal"))


@query("SELECT doc_id, text AS plain FROM documents")
def aes_roundtrip(spark, sf_dir):
    key = crypto.key_of(F.col("lang"), F.col("source"), F.col("doc_id").cast("string"))
    docs = table(spark, sf_dir, "documents").select("doc_id", key.alias("key"), crypto.encrypt(F.col("text").cast("binary"), key).alias("data"))
    # a chunk may end within a character, so bytes are joined before they are text
    parts = F.transform(crypto.chunks(F.col("data"), 4096), lambda c: F.hex(crypto.decrypt_chunk(c["data"], F.col("key"), c["last"])))
    return docs.select("doc_id", F.unhex(F.array_join(parts, "")).cast("string").alias("plain"))


@query("SELECT doc_id, sha256(text) AS sha256, ((strlen(text) + 1023) // 1024)::BIGINT AS chunks FROM documents WHERE strlen(text) > 0")
def chunk_reassembly(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter(F.octet_length("text") > 0)
    rows = docs.select("doc_id", F.explode(crypto.chunks(F.col("text").cast("binary"), 1024)).alias("c")).select("doc_id", "c.off", "c.data")
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("off", "data"))), lambda c: F.hex(c["data"])), "")
    return rows.groupBy("doc_id").agg(F.sha2(F.unhex(whole), 256).alias("sha256"), F.count("*").alias("chunks"))


@query("SELECT source, count(*) AS entries, sum(n_chars)::BIGINT AS size, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def manifest_json(spark, sf_dir):
    entry = F.struct(F.col("doc_id").alias("name"), F.col("n_chars").alias("size"))
    made = integrity.manifest(table(spark, sf_dir, "documents"), ["source"], entry)
    parsed = F.from_json("manifest", "entries array<struct<name:bigint,size:bigint>>, manifest_version int")
    made = made.select("source", parsed.alias("m"))
    total = F.aggregate("m.entries", F.lit(0).cast("long"), lambda a, e: a + e["size"])
    return made.select("source", F.size("m.entries").cast("long").alias("entries"), total.alias("size"), F.col("m.entries")[0]["name"].alias("first_doc"))


@query("""
SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)""")
def pending_outputs(spark, sf_dir):
    state = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("verified"))
    return integrity.pending(table(spark, sf_dir, "documents").select("doc_id"), state, ["doc_id"])


@query("""
SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def latest_state(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return integrity.latest_record(rows, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


# ---------------------------------------------------------------- hierarchy, grammar, text


@query("""
WITH RECURSIVE p AS (SELECT list_filter(string_split(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/'), lambda x: x <> '') AS parts FROM pages),
r AS (SELECT parts, 1 AS n FROM p WHERE len(parts) > 0 UNION ALL SELECT parts, n + 1 FROM r WHERE n < len(parts))
SELECT array_to_string(parts[1:n], '/') AS directory, (n - 1) AS depth, count(*) AS entries FROM r GROUP BY 1, 2""")
def path_hierarchy(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1).alias("path"))
    return hierarchy.directory_counts(pages, "path")


@query("""
SELECT page_id, starts_with(p, '/') AND len(list_filter(string_split(p[2:], '/'), lambda x: x IN ('', '.', '..'))) = 0 AS safe
FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1) || CASE page_id % 4 WHEN 0 THEN '/..' WHEN 1 THEN '/x' ELSE '' END AS p FROM pages)""")
def safe_paths(spark, sf_dir):
    tail = F.when(F.col("page_id") % 4 == 0, "/..").when(F.col("page_id") % 4 == 1, "/x").otherwise("")
    path = F.concat(F.regexp_extract("url", "^[a-z]+://[^/]*([^?#]*)", 1), tail)
    return table(spark, sf_dir, "pages").select("page_id", hierarchy.is_safe(path).alias("safe"))


@query("""
SELECT conv_id, turn, i - 1 AS seq, words[1] AS command, len(words) - 1 AS arity FROM (
  SELECT conv_id, turn, unnest(range(1, len(lines) + 1)) AS i, string_split(unnest(lines), ' ') AS words FROM (
    SELECT conv_id, turn, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS lines FROM conversations))""")
def transfer_grammar(spark, sf_dir):
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x, F.lit(" "))), lambda x: x != "")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(lines).alias("seq", "line"))
    words = F.split("line", " ")
    return rows.select("conv_id", "turn", F.col("seq").cast("long").alias("seq"), F.get(words, F.lit(0)).alias("command"), (F.size(words) - 1).cast("long").alias("arity"))


@query("""
WITH o AS (SELECT user_id, event_id, event_type, ts, max(CASE WHEN event_type = 'signup' THEN event_id END) OVER w AS opened, max(CASE WHEN event_type = 'error' THEN event_id END) OVER w AS freed
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, opened, coalesce(opened > coalesce(freed, -1), false) AS live FROM o WHERE event_type = 'purchase'""")
def stash_liveness(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda kind: F.last(F.when(F.col("event_type") == kind, F.col("event_id")), ignorenulls=True).over(w)
    rows = table(spark, sf_dir, "events").withColumns({"opened": last("signup"), "freed": last("error")}).filter("event_type = 'purchase'")
    return rows.select("event_id", "opened", F.coalesce(F.col("opened") > F.coalesce("freed", F.lit(-1)), F.lit(False)).alias("live"))


@query("""
SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN format('{:.2f} KiB', n / 1024.0) WHEN n < 1073741824 THEN format('{:.2f} MiB', n / 1048576.0)
  WHEN n < 1099511627776 THEN format('{:.2f} GiB', n / 1073741824.0) ELSE format('{:.2f} TiB', n / 1099511627776.0) END AS human
FROM (SELECT doc_id, CAST(n_chars AS BIGINT) * CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 1000000 ELSE 100000000 END AS n FROM documents)""")
def human_bytes(spark, sf_dir):
    n = F.col("n_chars") * F.when(F.col("doc_id") % 4 == 0, 1).when(F.col("doc_id") % 4 == 1, 1000).when(F.col("doc_id") % 4 == 2, 1_000_000).otherwise(100_000_000)
    return table(spark, sf_dir, "documents").select("doc_id", text.human_bytes(n).alias("human"))


@query("""
SELECT doc_id, nullif(CASE doc_id % 5 WHEN 0 THEN n_chars WHEN 1 THEN n_chars * 1024 WHEN 2 THEN n_chars * 1048576 WHEN 3 THEN n_chars * 1073741824 END, 0)::BIGINT AS rate FROM documents""")
def parse_rate(spark, sf_dir):
    unit = F.when(F.col("doc_id") % 5 == 0, "").when(F.col("doc_id") % 5 == 1, "K").when(F.col("doc_id") % 5 == 2, " MB").when(F.col("doc_id") % 5 == 3, "GiB").otherwise("x")
    return table(spark, sf_dir, "documents").select("doc_id", text.parse_rate(F.concat(F.col("n_chars").cast("string"), unit)).alias("rate"))


@query("""
SELECT doc_id, array_to_string(list_transform(string_split(md5(doc_id::VARCHAR), ''), lambda c: substr(sha256(text), (ascii(c) & 15) + 1, 1)), '') AS code FROM documents""")
def logic_permutation(spark, sf_dir):
    nonce = F.md5(F.col("doc_id").cast("string").cast("binary"))
    return table(spark, sf_dir, "documents").select("doc_id", text.permuted(F.sha2(F.col("text").cast("binary"), 256), nonce).alias("code"))

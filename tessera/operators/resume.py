"""What earlier runs left: ranges half done, indexes of archives, outputs and their records. Each is rows of a table, and
what can't be trusted is left out by a filter. Null in a field that is needed makes a row invalid; ties go to the last order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How far apart an index has marks, and how much of a member is read at once.
SPACING, LEAST, MOST = 8 << 20, 1 << 20, 16 << 20


def valid_ranges(rows: DataFrame, keys: Sequence[str], *, alignment: int = 1) -> DataFrame:
    """rows (keys, start, end, offset, total, recorded, file_size), `end` the last byte, of keys whose ranges can be resumed: the
    recorded size is the total, the ranges cover it once, in order, with all places aligned, and each offset is within
    its range or just behind it. offset is cut to what the file has, down to the alignment."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    off_grid = [F.col("start") % alignment, (F.col("end") + 1) % alignment, F.col("offset") % alignment]
    good = (F.col("start") == F.coalesce(F.lag("end").over(w) + 1, F.lit(0))) & (F.col("recorded") == F.col("total"))
    good &= F.col("offset").between(F.col("start"), F.col("end") + 1) & (F.col("start") <= F.col("end")) & (F.col("end") < F.col("total"))
    for x in off_grid:
        good &= x == 0
    seen = rows.withColumn("\u0001good", F.coalesce(good, F.lit(False)))
    every = Window.partitionBy(*keys)
    seen = seen.withColumns({"\u0001all": F.min("\u0001good").over(every), "\u0001end": F.max("end").over(every)})
    have = F.greatest("start", F.least("offset", "file_size"))
    kept = seen.filter(F.col("\u0001all") & (F.col("\u0001end") + 1 == F.col("total")))
    return kept.withColumn("offset", (have - have % alignment).cast("long")).drop("\u0001good", "\u0001all", "\u0001end")


def valid_indexes(members: DataFrame, current: DataFrame, keys: Sequence[str], *, version: int = 1) -> DataFrame:
    """members (keys, identity, version, complete, name, size, offset_data) of indexes that hold for the archives of today,
    current (keys, identity, length): of that identity and version, and with no member that is nameless or outside."""
    now = current.select(*keys, F.col("identity").alias("\u0001id"), F.col("length").alias("\u0001n"))
    rows = members.join(now, list(keys))
    good = (F.col("identity") == F.col("\u0001id")) & (F.col("version") == version) & F.col("complete").isNotNull() & (F.col("name") != "")
    good &= (F.col("size") >= 0) & (F.col("offset_data") >= 0) & (F.col("offset_data") + F.col("size") <= F.col("\u0001n"))
    w = Window.partitionBy(*keys, "identity", "version")
    rows = rows.withColumn("\u0001all", F.min(F.coalesce(good, F.lit(False))).over(w))
    return rows.filter("`\u0001all`").drop("\u0001id", "\u0001n", "\u0001all")


def best_index(saved: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """(keys, complete, progress, order): of each key's saved indexes (keys, order, complete, size, offset_data) the complete
    one, else that which reaches furthest; of equal ones the last."""
    reach = saved.groupBy(*keys, order).agg(F.max("complete").alias("complete"), F.coalesce(F.max(F.col("offset_data") + F.col("size")), F.lit(0)).cast("long").alias("progress"))
    best = reach.groupBy(*keys).agg(F.max(F.struct("complete", "progress", order)).alias("b"))
    return best.select(*keys, "b.*")


def prefers_index(size: Column, offset: Column) -> Column:
    """Whether going to a member by the index reads less than going through what lies before it."""
    buffer = F.least(F.lit(MOST), F.greatest(F.lit(LEAST), size))
    return offset > F.greatest(F.lit(1), F.ceil(size / buffer)) * SPACING


def locations(saved: DataFrame, identity: Column) -> DataFrame:
    """Saved (name, entry) places that hold for an identity."""
    return saved.filter((F.col("identity") == identity) & F.col("name").isNotNull() & F.col("entry").isNotNull())


def in_physical_order(entries: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """entries with `turn`: the order in which an archive's entries lie, so that one pass extracts them."""
    return entries.withColumn("turn", F.row_number().over(Window.partitionBy(*keys).orderBy(at)))


def batch_summary(results: DataFrame, keys: Sequence[str], order: str, *, fail_fast: bool = False) -> DataFrame:
    """(keys, jobs, failed, code): how batches of jobs (keys, order, status) ended; code is 1 if one failed, else 0. With
    fail_fast the jobs behind the first that failed don't count: they never ran."""
    failed = F.coalesce(F.col("status") == "failed", F.lit(False)).cast("int")
    if fail_fast:
        before = F.coalesce(F.sum(failed).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        results = results.withColumn("\u0001before", before).filter("`\u0001before` = 0")
    return results.groupBy(*keys).agg(F.count("*").alias("jobs"), F.sum(failed).alias("failed"), F.max(failed).alias("code"))

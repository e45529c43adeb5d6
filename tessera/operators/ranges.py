"""Byte ranges and intervals as tables: offsets, overlaps, look-ups, runs, grids and gaps.

Every function takes key columns by which its windows and joins are partitioned (an image, a partition, a user), and
order columns that must order each key's rows totally. Ends are exclusive unless a name says inclusive.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIB = 1 << 20


def _before(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def with_offsets(rows: DataFrame, keys: Sequence[str], order: Sequence[str], size: str, offset: str = "offset") -> DataFrame:
    """rows with the sum of the sizes before each: where it goes in the copy."""
    return rows.withColumn(offset, F.coalesce(F.sum(size).over(_before(keys, order)), F.lit(0)).cast("long"))


def copy_plan(extents: DataFrame, partition: str, index: str, source: str, size: str) -> DataFrame:
    """extents in copy form: where each goes, and whether its source range overlaps one before it on the medium."""
    plan = with_offsets(extents, [partition], [index], size, "target")
    end = F.max(F.col(source) + F.col(size)).over(_before([partition], [source, index]))
    return plan.withColumn("overlaps", F.coalesce(F.col(source) < end, F.lit(False)))


def overlapping(rows: DataFrame, keys: Sequence[str], start: str, end: str, order: Sequence[str] = ()) -> DataFrame:
    """rows that start before some earlier one of the key ends; none: the intervals are disjoint."""
    last = F.max(end).over(_before(keys, [start, end, *order]))
    return rows.withColumn("\u0001last", last).filter(F.col(start) < F.col("\u0001last")).drop("\u0001last")


def not_tiling(rows: DataFrame, keys: Sequence[str], start: str, end: str, total: str) -> DataFrame:
    """Keys whose half-open intervals don't cover [0, total) exactly once."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    step = rows.withColumn("\u0001gap", F.col(start) != F.coalesce(F.lag(end).over(w), F.lit(0)))
    both = step.groupBy(*keys).agg(F.max("\u0001gap").alias("\u0001gap"), F.max(end).alias("\u0001end"), F.max(total).alias("\u0001total"))
    return both.filter("`\u0001gap` or `\u0001end` <> `\u0001total`").select(*keys)


def overlap_pairs(left: DataFrame, right: DataFrame, key: Sequence[str], start: str, end: str, ids: tuple[str, str], width: int | float, tasks: int | None = None) -> DataFrame:
    """Pairs (key, left id, right id) of intervals of one key that overlap, each once; tasks: how many the join is dealt to.

    An interval goes into each bin of `width` that it meets, and a pair counts in the bin where its overlap begins: an
    equi-join on (key, bin), in place of a nested loop. left and right have the same column names but for the ids.
    """

    def binned(rows: DataFrame, side: str, own: str) -> DataFrame:
        first, last = F.floor(F.col(start) / width), F.ceil(F.col(end) / width) - 1
        rows = rows.filter(F.col(start) < F.col(end))
        rows = rows.select(*key, F.col(own), F.col(start).alias(f"{side}s"), F.col(end).alias(f"{side}e"), F.explode(F.sequence(first, F.greatest(first, last))).alias("bin"))
        return rows if tasks is None else rows.repartition(tasks, *key, "bin")

    both = binned(left, "l", ids[0]).join(binned(right, "r", ids[1]), [*key, "bin"])
    both = both.filter((F.col("ls") < F.col("re")) & (F.col("rs") < F.col("le")))
    return both.filter(F.floor(F.greatest("ls", "rs") / width) == F.col("bin")).select(*key, *ids)


def lookup(points: DataFrame, extents: DataFrame, key: Sequence[str], at: str, start: str, values: Sequence[str], order: str) -> DataFrame:
    """points with the values of the last extent that starts at or before them (null where there is none).

    An as-of join: both sides in one sort by key and position, the last extent carried forward.
    """
    a = extents.select(*key, F.col(start).alias("\u0001at"), F.lit(0).alias("\u0001side"), F.struct(F.col(start).alias("start"), *values).alias("\u0001hit"), F.lit(None).alias("\u0001row"), F.col(order).alias("\u0001tie"))
    b = points.select(*key, F.col(at).alias("\u0001at"), F.lit(1).alias("\u0001side"), F.lit(None).alias("\u0001hit"), F.struct(*[F.col(c) for c in points.columns if c not in key]).alias("\u0001row"), F.lit(None).alias("\u0001tie"))
    w = Window.partitionBy(*key).orderBy("\u0001at", "\u0001side", "\u0001tie")
    hit = F.last("\u0001hit", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    both = a.unionByName(b).withColumn("\u0001hit", hit).filter("`\u0001side` = 1")
    return both.select(*key, "\u0001row.*", F.col("\u0001hit.start").alias("hit_start"), *[F.col(f"\u0001hit.{v}") for v in values])


def runs(rows: DataFrame, keys: Sequence[str], order: Sequence[str], same: Sequence[Column]) -> DataFrame:
    """rows with run: a number that grows wherever one of `same` (true: goes with the row before) fails."""
    w = Window.partitionBy(*keys).orderBy(*order)
    joined = same[0]
    for s in same[1:]:
        joined = joined & s
    rows = rows.withColumn("\u0001new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1))
    return rows.withColumn("run", F.sum("\u0001new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("\u0001new")


def file_runs(blocks: DataFrame, keys: Sequence[str], logical: str, physical: str, most: int = 256) -> DataFrame:
    """Runs of physically consecutive blocks (holes, null, go with holes), cut after `most` blocks."""
    w = Window.partitionBy(*keys).orderBy(logical)
    follows = (F.col(physical) == F.lag(physical).over(w) + 1) | (F.col(physical).isNull() & F.lag(physical).over(w).isNull() & F.lag(logical).over(w).isNotNull())
    out = runs(blocks, keys, [logical], [follows, F.col(logical) == F.lag(logical).over(w) + 1])
    inner = F.row_number().over(Window.partitionBy(*keys, "run").orderBy(logical)) - 1
    out = out.withColumn("part", F.floor(inner / most))
    return out.groupBy(*keys, "run", "part").agg(F.min(logical).alias("logical"), F.min(physical).alias("physical"), F.count("*").alias("blocks"))


def grid_size(remaining: Column, workers: int, low: int = 16 * MIB, high: int = 512 * MIB) -> Column:
    """Part size for what remains: an even share of two parts a worker, in whole steps of `low`, within [low, high]."""
    share = F.ceil(remaining / F.lit(2 * workers))
    return F.least(F.lit(high), F.greatest(F.lit(low), F.ceil(share / F.lit(low)) * low)).cast("long")


def split_on_grid(rows: DataFrame, start: str, end: str, grid: Column) -> DataFrame:
    """rows, each cut at the multiples of grid: part_start, part_end."""
    rows = rows.filter(F.col(start) < F.col(end)).withColumn("\u0001grid", grid.cast("long"))
    cell = F.sequence(F.floor(F.col(start) / F.col("\u0001grid")), F.floor((F.col(end) - 1) / F.col("\u0001grid")))
    rows = rows.withColumn("\u0001cell", F.explode(cell))
    at = F.col("\u0001cell") * F.col("\u0001grid")
    return rows.withColumns({"part_start": F.greatest(F.col(start), at), "part_end": F.least(F.col(end), at + F.col("\u0001grid"))}).drop("\u0001grid", "\u0001cell")


def split_ranges(ranges: DataFrame, keys: Sequence[str], workers: int, *, step: int = 16 * MIB) -> DataFrame:
    """Resumable ranges (start, end inclusive, offset: next byte) re-cut for so many workers.

    Neighbouring ranges of one state join; finished ones stay whole; the rest is cut on a grid for what remains.
    """
    w = Window.partitionBy(*keys).orderBy("start")
    done = F.col("offset") > F.col("end")
    parts = ranges.withColumn("done", done)
    # a range that is partly done is finished up to its offset
    pieces = F.filter(
        F.array(
            F.struct(F.col("start"), (F.col("offset") - 1).alias("end"), F.lit(True).alias("done")),
            F.struct(F.col("offset").alias("start"), F.col("end"), F.lit(False).alias("done")),
        ),
        lambda p: p["start"] <= p["end"],
    )
    parts = parts.select(*keys, F.explode(pieces).alias("p")).select(*keys, "p.*")
    parts = runs(parts, keys, ["start"], [F.col("done") == F.lag("done").over(w), F.col("start") == F.lag("end").over(w) + 1])
    joined = parts.groupBy(*keys, "run", "done").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    left = F.sum(F.when(~F.col("done"), F.col("end") - F.col("start") + 1).otherwise(0)).over(Window.partitionBy(*keys))
    joined = joined.withColumns({"grid": grid_size(left, workers, step), "stop": F.col("end") + 1})
    cut = split_on_grid(joined.filter("not done"), "start", "stop", F.col("grid"))
    cut = cut.select(*keys, F.col("part_start").alias("start"), (F.col("part_end") - 1).alias("end"), F.col("part_start").alias("offset"))
    whole = joined.filter("done").select(*keys, "start", "end", F.col("stop").alias("offset"))
    return whole.unionByName(cut)


def even_parts(total: Column, parts: int, align: int = 16) -> Column:
    """array<struct<start, end (inclusive), offset>>: at most `parts` parts of equal aligned size; the last takes what is left."""
    size = F.greatest(F.lit(align), F.floor(total / F.lit(parts * align)) * align)
    count = F.greatest(F.lit(1), F.least(F.lit(parts), F.floor(total / size)))
    make = lambda i: F.struct((i * size).cast("long").alias("start"), F.when(i == count - 1, total - 1).otherwise((i + 1) * size - 1).cast("long").alias("end"), (i * size).cast("long").alias("offset"))
    return F.transform(F.sequence(F.lit(0).cast("long"), count.cast("long") - 1), make)


def gaps(rows: DataFrame, keys: Sequence[str], start: str, end: str, order: Sequence[str] = (), *, size: str | None = None) -> DataFrame:
    """(keys, gap_start, gap_end): what the intervals leave of each key's space, from 0 up to column size (one value a key),
    or up to the last interval's start if there is none."""
    if size is not None:  # an empty interval at the end
        edge = rows.groupBy(*keys).agg(F.max(size).alias(start)).withColumn(end, F.col(start))
        rows = rows.select(*keys, start, end, *order).unionByName(edge, allowMissingColumns=True)
    last = F.coalesce(F.max(end).over(_before(keys, [start, end, *order])), F.lit(0))
    return rows.withColumn("gap_start", last).filter(F.col("gap_start") < F.col(start)).select(*keys, "gap_start", F.col(start).alias("gap_end"))


def done_bytes(start: Column, offset: Column) -> Column:
    return F.sum(F.greatest(F.lit(0), offset - start))


def parse_ranges(text: Column) -> Column:
    """array<struct<s, e>> of a literal `n,a,b,...`: n numbers, pairs of a < b that don't overlap; null if it isn't one."""
    numbers = F.transform(F.split(text, ","), lambda x: x.try_cast("long"))
    count = F.try_element_at(numbers, F.lit(1))
    size = F.size(numbers)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), ((size - 1) / 2).cast("int"))), lambda i: F.struct(F.get(numbers, (2 * i - 1).cast("int")).alias("s"), F.get(numbers, (2 * i).cast("int")).alias("e")))
    ordered = F.array_sort(pairs)
    fine = F.forall(pairs, lambda p: (p["s"] >= 0) & (p["s"] < p["e"]))
    apart = F.forall(F.sequence(F.lit(1), F.size(pairs)), lambda i: (i == 1) | (F.get(ordered, i - 2)["e"] <= F.get(ordered, i - 1)["s"]))
    ok = F.coalesce((size >= 3) & (size % 2 == 1) & (count == size - 1) & ~F.exists(numbers, lambda x: x.isNull()), F.lit(False))
    return F.when(ok, F.when(fine & apart, pairs))


def blocks_in(ranges: Column) -> Column:
    return F.aggregate(ranges, F.lit(0).cast("long"), lambda a, r: a + r["e"] - r["s"])

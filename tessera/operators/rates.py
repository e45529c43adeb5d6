"""Rates over samples of progress: sliding speeds, sizes of the next request, and a bandwidth limit's clock."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIB = 1 << 20


def sliding_rate(samples: DataFrame, keys: Sequence[str], at: str, done: str, *, short: float = 2.0, long: float = 10.0) -> DataFrame:
    """samples (at in seconds; total done) with speed over the last `short` and eta_speed over the last `long` seconds.

    A rate is measured from the last sample at or before that long ago, else from the first of the run; a decrease
    of done starts a new run; without an increase for `short` seconds both are 0.
    """
    order = Window.partitionBy(*keys).orderBy(at)
    fell = F.coalesce(F.col(done) < F.lag(done).over(order), F.lit(False))
    rows = samples.withColumn("run", F.sum(fell.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("\u0001us", F.round(F.col(at) * 1e6).cast("long"))  # range frames have whole bounds
    run = Window.partitionBy(*keys, "run").orderBy("\u0001us")
    rose = F.when(F.col(done) > F.coalesce(F.lag(done).over(run), F.col(done) - 1), F.col(at))
    rows = rows.withColumns({"\u0001rose": rose, "\u0001me": F.struct(F.col(at).alias("t"), F.col(done).alias("n"))})
    last_rise = F.last("\u0001rose", ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, 0))

    def speed(window: float) -> Column:
        # the last sample of the range that ends `window` seconds ago
        anchor = F.last("\u0001me").over(run.rangeBetween(Window.unboundedPreceding, -round(window * 1e6)))
        anchor = F.coalesce(anchor, F.first("\u0001me").over(run))
        took = F.col(at) - anchor["t"]
        return F.when(took > 0, (F.col(done) - anchor["n"]) / took).otherwise(0.0)

    rows = rows.withColumns({"\u0001last": last_rise, "\u0001s": speed(short), "\u0001e": speed(long)})
    stalled = F.col(at) - F.col("\u0001last") >= short
    zero = lambda c: F.when(stalled, 0.0).otherwise(F.col(c))
    return rows.withColumns({"speed": zero("\u0001s"), "eta_speed": zero("\u0001e")}).drop("\u0001us", "\u0001rose", "\u0001me", "\u0001last", "\u0001s", "\u0001e")


def next_size(samples: DataFrame, keys: Sequence[str], order: Sequence[str], rate: str, workers: int) -> DataFrame:
    """samples with size: bytes of the next request. The first is 4 MiB; then, from the 2 * workers rates before (null: none
    was seen), 16 MiB without any, else one second's worth of the slowest if that is under half the fastest, or of the
    median; whole bytes, up to whole MiB, from 1 to 16."""
    w = Window.partitionBy(*keys).orderBy(*order)
    few = w.rowsBetween(-2 * workers, -1)
    low, high, mid = F.min(rate).over(few), F.max(rate).over(few), F.expr(f"percentile({rate}, 0.5)").over(few)
    picked = F.floor(F.when(low * 2 < high, low).otherwise(mid))
    size = F.least(F.lit(16 * MIB), F.greatest(F.lit(MIB), F.ceil(picked / MIB) * MIB))
    first = F.row_number().over(w) == 1
    return samples.withColumn("size", F.when(first, F.lit(4 * MIB)).otherwise(F.when(low.isNull(), F.lit(16 * MIB)).otherwise(size)).cast("long"))


def limited(requests: DataFrame, keys: Sequence[str], order: Sequence[str], at: Column, cost: Column) -> DataFrame:
    """requests with finish: when each is through a limiter that serves one after another, each for its cost.

    finish = max(at, finish before) + cost, which is a running maximum of (at - cost before) plus the running cost.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = requests.withColumns({"\u0001at": at, "\u0001cost": cost})
    rows = rows.withColumn("\u0001sum", F.sum("\u0001cost").over(w))
    finish = F.max(F.col("\u0001at") - F.col("\u0001sum") + F.col("\u0001cost")).over(w) + F.col("\u0001sum")
    return rows.withColumn("finish", finish).drop("\u0001at", "\u0001cost", "\u0001sum")

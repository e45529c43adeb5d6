"""Progress rates over streams: an extension, as batches have the exact ones (operators.rates)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(samples: DataFrame, key: str, at: str, amount: str, *, size: str = "2 hours", step: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window start and end, key, n, amount): sums in sliding windows of event time; later rows than `late` are dropped."""
    rows = samples.withWatermark(at, late).groupBy(F.window(at, size, step).alias("w"), key)
    return rows.agg(F.count("*").alias("n"), F.sum(amount).alias(amount)).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", amount)


def speeds(samples: DataFrame, key: str, at: str, done: str, *, window: float = 2.0) -> DataFrame:
    """(key, at, speed) for each sample (at in seconds): from the last sample at or before `window` ago, else from the first
    since the last decrease; 0 without an increase for that long. State: the samples of the window and the one before it."""

    def update(k, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept, rose = (list(map(tuple, state.get[0])), state.get[1]) if state.exists else ([], None)
        out = []
        rows = pd.concat(list(frames)).sort_values(at)
        for t, n in zip(rows[at], rows[done], strict=True):
            if kept and n < kept[-1][1]:
                kept, rose = [], None
            if not kept or n > kept[-1][1]:
                rose = t
            kept.append((float(t), float(n)))
            while len(kept) > 1 and kept[1][0] <= t - window:
                kept.pop(0)
            took = t - kept[0][0]
            out.append((k[0], t, 0.0 if took <= 0 or t - rose >= window else (n - kept[0][1]) / took))
        state.update(([list(x) for x in kept], float(rose)))
        yield pd.DataFrame(out, columns=[key, at, "speed"])

    kind = samples.schema[key].dataType.simpleString()
    return samples.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, {at} double, speed double", "kept array<array<double>>, rose double", "append", "NoTimeout")

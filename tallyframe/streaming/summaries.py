"""Summaries of streams: the measures of `summ` over event-time windows.

The same mergeable aggregates as in batch, so state is a few numbers per window and key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyframe.meta import Dataset
from tallyframe.operators.measures import Aggregates, Measure, quantile


def windowed_summary(stream: Dataset, time: str, window: str, *measures: Measure, keys: tuple[str, ...] = (), slide: str | None = None, watermark: str = "0 seconds", weight: str | None = None) -> DataFrame:
    """window_start, window_end, the keys, _freq_ and the measures of each window, closed when the watermark passes it.

    Rows later than the watermark are left out. Works on batch data too. Quantiles are not mergeable and are refused.
    """
    if any(isinstance(m, quantile) for m in measures):
        raise ValueError("quantiles cannot be kept in the state of a stream; use a sketch")
    a = Aggregates()
    count = a.count("rows", F.lit(True))
    closing = {k: e for m in measures for k, e in m.settled(stream, weight).build(a).items()}
    # Watermarks need a timestamp with time zone; others are read in that of the session.
    df = stream.df.withColumn(time, F.col(f"`{time}`").cast("timestamp"))
    df = df.withWatermark(time, watermark) if df.isStreaming else df
    w = F.window(time, window, slide) if slide else F.window(time, window)
    grouped = df.groupBy(w.alias("w"), *[F.col(f"`{k}`") for k in keys]).agg(*a.first())
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, count.cast("bigint").alias("_freq_"), *[e.alias(k) for k, e in closing.items()])

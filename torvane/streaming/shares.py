"""Ring operators on streams: they are row-local expressions, so they work on streaming frames as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from torvane.functions.ring import encode, ring
from torvane.functions.share import Dealer, open_sum, pair


def shared_window_sums(events: DataFrame, *, ts: str, key: str, value: str, ids: tuple[str, ...], window: str, late: str, f: int, seed: int = 1) -> DataFrame:
    """Rows (start, key, total) of a stream: values are shared row by row, each party sums its shares by event-time window, and sums are opened. Rows later than the watermark are dropped."""
    with ring(events.sparkSession):
        shared = events.withWatermark(ts, late).withColumn("torvane_s", Dealer(ids, seed).share(encode(F.col(value), f), "window").column)
        sums = shared.groupBy(F.window(ts, window).alias("w"), F.col(key)).agg(pair(F.sum("torvane_s.s0"), F.sum("torvane_s.s1")).alias("s"))
        return sums.select(F.col("w.start").alias("start"), key, open_sum(F.col("s")).alias("total"))

"""When time buckets of a tick stream are closed and known."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causaltape.functions.clock import floor_bucket


def bar_availability(ticks: DataFrame, frames: dict[str, int], keys: list[str], event: str = "event_ts_ns", received: str = "received_ts_ns", seq: str = "source_sequence") -> DataFrame:
    """Rows (keys, timeframe, bar_open_ns, bar_close_ns, available_time_ns, trigger_sequence): a bucket is closed by
    the first tick of the next bucket that has ticks, and known when that tick is received. Gaps give no empty bars
    and the last bucket of a stream gives no row. Ticks are reduced to one row per bucket before any window."""
    every = F.array(*[F.struct(F.lit(n).alias("timeframe"), F.lit(w).cast("long").alias("width")) for n, w in frames.items()])
    cut = ticks.select(*keys, event, received, seq, F.inline(every)).withColumn("bar_open_ns", floor_bucket(F.col(event), F.col("width")))
    first = cut.groupBy(*keys, "timeframe", "width", "bar_open_ns").agg(F.min(F.struct(F.col(seq).alias("s"), F.col(received).alias("r"))).alias("t"))
    after = F.lead("t").over(Window.partitionBy(*keys, "timeframe").orderBy("bar_open_ns"))
    return first.withColumn("n", after).where("n is not null").select(
        *keys, "timeframe", "bar_open_ns", (F.col("bar_open_ns") + F.col("width")).alias("bar_close_ns"), F.col("n.r").alias("available_time_ns"), F.col("n.s").alias("trigger_sequence")
    )


def with_availability(bars: DataFrame, availability: DataFrame, keys: list[str]) -> DataFrame:
    """Bars with the time they are known; a bar without a record stays, with nulls."""
    known = availability.select(*keys, F.col("timeframe").alias("scale"), (F.col("bar_close_ns") / 1_000_000).cast("long").alias("bar_close_ts"), "available_time_ns", "trigger_sequence")
    return bars.join(known, [*keys, "scale", "bar_close_ts"], "left")

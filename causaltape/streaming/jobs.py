"""Structured Streaming forms of the stateful operators. Each gives the rows of its batch twin once the stream is
drained, and keeps state that doesn't grow with the stream: a forming bucket, a latest context, a lifecycle position,
or the rows inside a join interval."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from causaltape.functions.clock import floor_bucket

STORES = "org.apache.spark.sql.execution.streaming.state"
ROCKS, PLAIN = f"{STORES}.RocksDBStateStoreProvider", f"{STORES}.HDFSBackedStateStoreProvider"


def micros_of(ns: str) -> Column:
    """A timestamp for watermarks; the nanoseconds stay in their column."""
    return F.timestamp_micros((F.col(ns) / 1000).cast("long"))


class _Keyed:
    """One value of state per key. The rows of a key in a micro-batch are ordered by `order` and worked on as whole columns;
    what is kept of them is one row of state. Rows that come too late for their place are told apart by `late`. Rows of a
    null key are a key of their own, which `step` gets as None."""

    state_schema, order = "", ()

    def rows(self, key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(parts), ignore_index=True).sort_values(list(self.order), kind="stable", ignore_index=True)
        instrument, *others, known = key
        held, out = self.step((instrument if known else None, *others), state.get if state.exists else None, batch)
        if held is not None:
            state.update(held)
        yield out

    def step(self, key: tuple, held: tuple | None, batch: pd.DataFrame) -> tuple[tuple | None, pd.DataFrame]:
        raise NotImplementedError


def integers(values: np.ndarray, known: np.ndarray | bool = True) -> pd.arrays.IntegerArray:
    """Whole numbers, null where `known` is not true."""
    return pd.arrays.IntegerArray(np.asarray(values, np.int64), np.broadcast_to(~np.asarray(known, bool), len(values)).copy())


def named(key: tuple, n: int) -> pd.arrays.IntegerArray:
    """The key's instrument n times."""
    return integers(np.full(n, 0 if key[0] is None else key[0]), key[0] is not None)


class Availability(_Keyed):
    """Emits a bucket when a tick of a later bucket arrives. A tick whose event time goes back behind that of an accepted
    one, or whose sequence does not rise, is emitted as a violation and changes nothing."""

    state_schema, order = "bucket long, sequence long, event long", ("source_sequence",)
    schema = "instrument long, timeframe string, bar_open_ns long, bar_close_ns long, available_time_ns long, trigger_sequence long, violation boolean"

    def step(self, key, held, batch):
        event, sequence, bucket = (batch[c].to_numpy(np.int64) for c in ("event_ts_ns", "source_sequence", "bucket"))
        least = np.iinfo(np.int64).min
        now, last, top = held or (least, least, least)
        good = self.accepted(event, sequence, top, last)
        before = np.concatenate(([now], bucket[good][:-1]))
        closes = np.zeros(len(batch), bool)
        opened = np.zeros(len(batch), np.int64)
        closes[good] = (before != least) & (bucket[good] > before)
        opened[good] = before
        rows = np.flatnonzero(closes | ~good)
        closed, width = closes[rows], batch["width"].to_numpy(np.int64)[rows]
        frame = pd.DataFrame({
            "instrument": named(key, len(rows)), "timeframe": [key[1]] * len(rows), "bar_open_ns": integers(opened[rows], closed), "bar_close_ns": integers(np.where(closed, opened[rows], 0) + width, closed),
            "available_time_ns": integers(batch["received_ts_ns"].to_numpy(np.int64)[rows]), "trigger_sequence": integers(sequence[rows]), "violation": ~closed,
        })
        at = np.flatnonzero(good)
        return ((int(bucket[at[-1]]), int(sequence[at[-1]]), int(event[at[-1]])) if len(at) else held), frame

    @staticmethod
    def accepted(event: np.ndarray, sequence: np.ndarray, top: int, last: int) -> np.ndarray:
        """Which rows are neither back in time nor without a rise of the sequence, in order of sequence. A rejected row never
        has the greatest event time so far, so the running maximum may include it, unless its sequence number repeats:
        then whether the first of them counts decides on the next, and rows are taken one by one."""
        good = sequence > last
        if (sequence[1:] > sequence[:-1]).all():
            good[good] = event[good] >= np.maximum.accumulate(np.concatenate(([top], event[good])))[:-1]
            return good
        for i in range(len(event)):
            good[i] = sequence[i] > last and event[i] >= top
            if good[i]:
                top, last = event[i], sequence[i]
        return good


class LatestContext(_Keyed):
    """Holds the latest context of a key and hands it to each anchor.

    An anchor older than the context held would be told of its future: it is late and gets none. A context older than an
    anchor already answered is late too, and a row of its own; of later anchors it is used like any other."""

    state_schema, order = "available_time long, context_seq long, context_value double, answered long", ("t", "kind", "seq")
    schema = "instrument long, anchor_id long, context_seq long, context_value double, lag_ns long, late boolean"

    def step(self, key, held, batch):
        time, seq, value, kind = batch["t"].to_numpy(np.int64), batch["seq"].to_numpy(np.int64), batch["value"].to_numpy(float), batch["kind"].to_numpy()
        least = np.iinfo(np.int64).min
        then, number, what, answered = held or (least, least, float("nan"), least)
        context = kind == 0
        newer = context & ((time > then) | ((time == then) & (seq >= number)))
        at = np.maximum.accumulate(np.where(newer, np.arange(len(batch)), -1))
        pick = lambda new, old: np.where(at >= 0, new[at], old)
        its_time, its_seq, its_value = pick(time, then), pick(seq, number), pick(value, what)
        late = np.where(context, time < answered, (at < 0) & (its_time > time))
        known = ~context & ~late & (its_time != least)
        rows = np.flatnonzero(~context | late)
        frame = pd.DataFrame({
            "instrument": named(key, len(rows)), "anchor_id": integers(seq[rows], ~context[rows]), "context_seq": integers(np.where(context, seq, np.where(known, its_seq, 0))[rows], (known | context)[rows]),
            "context_value": np.where(context, value, np.where(known, its_value, np.nan))[rows], "lag_ns": integers((time - np.where(known, its_time, time))[rows], known[rows]), "late": late[rows],
        })
        anchors = time[~context]
        return (int(its_time[-1]), int(its_seq[-1]), float(its_value[-1]), max(answered, int(anchors.max()) if len(anchors) else least)), frame


class Lifecycle(_Keyed):
    """Numbers the episodes of a key: IDLE closes, a new or lost id starts anew, taking on an id continues.

    A row at or before the last one seen, by time and sequence, is late: it has no episode and changes nothing, so that
    numbers already handed out stand."""

    state_schema, order = "state string, eid string, episode long, time long, sequence long", ("received_ts_ns", "source_sequence")
    schema = "instrument long, source_sequence long, episode long, late boolean"

    def step(self, key, held, batch):
        state, eid, episode, then, number = held or ("", "", 0, np.iinfo(np.int64).min, np.iinfo(np.int64).min)
        time, seq = batch["received_ts_ns"].to_numpy(np.int64), batch["source_sequence"].to_numpy(np.int64)
        late = (time < then) | ((time == then) & (seq <= number))
        states, ids = batch["state"].to_numpy(object)[~late], batch["eid"].to_numpy(object)[~late]
        before, id_before = np.concatenate(([state], states[:-1])), np.concatenate(([eid], ids[:-1]))
        active = states != "IDLE"
        starts = active & ((before == "") | (before == "IDLE") | ((id_before != "") & (id_before != ids)))
        numbers = episode + np.cumsum(starts.astype(np.int64))
        shown = late.copy()
        shown[~late] = active
        episodes = np.zeros(len(batch), np.int64)
        episodes[~late] = numbers
        frame = pd.DataFrame({"instrument": named(key, shown.sum()), "source_sequence": integers(seq[shown]), "episode": integers(episodes[shown], ~late[shown]), "late": late[shown]})
        if late.all():
            return held, frame
        return (states[-1], ids[-1], int(numbers[-1]), int(time[~late][-1]), int(seq[~late][-1])), frame


def _transform(df: DataFrame, keys: list[str], processor: _Keyed) -> DataFrame:
    """The processor's rows. State goes by Arrow with the rows: tasks of keys without rows cost little, where a stateful
    processor starts a worker of its own and a store's server in every task of every micro-batch."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PLAIN)
    # pandas would turn the whole numbers beside a null into floats
    df = df.withColumn("known", F.col("instrument").isNotNull()).withColumn("instrument", F.coalesce("instrument", F.lit(0)))
    return df.groupBy(*keys, "known").applyInPandasWithState(processor.rows, processor.schema, processor.state_schema, "append", GroupStateTimeout.NoTimeout)


def availability_stream(ticks: DataFrame, frames: dict[str, int]) -> DataFrame:
    """Rows without an event time, time of receipt or sequence are left out."""
    ticks = ticks.dropna(subset=["event_ts_ns", "received_ts_ns", "source_sequence"])
    every = F.array(*[F.struct(F.lit(n).alias("timeframe"), F.lit(w).cast("long").alias("width")) for n, w in frames.items()])
    cut = ticks.select("instrument", "event_ts_ns", "received_ts_ns", "source_sequence", F.inline(every)).withColumn("bucket", floor_bucket(F.col("event_ts_ns"), F.col("width")))
    return _transform(cut, ["instrument", "timeframe"], Availability())


def latest_context_stream(anchors: DataFrame, contexts: DataFrame) -> DataFrame:
    """anchors (instrument, anchor_time, anchor_seq) and contexts (instrument, available_time, context_seq, value). Rows
    without a time or sequence are left out, as are contexts of a null instrument, which no anchor equals; late rows are
    marked (see `LatestContext`)."""
    c = contexts.select("instrument", F.col("available_time").alias("t"), F.lit(0).alias("kind"), F.col("context_seq").alias("seq"), F.col("context_value").alias("value")).dropna(subset=["instrument"])
    a = anchors.select("instrument", F.col("anchor_time").alias("t"), F.lit(1).alias("kind"), F.col("anchor_seq").alias("seq"), F.lit(None).cast("double").alias("value"))
    return _transform(c.unionByName(a).dropna(subset=["t", "seq"]), ["instrument"], LatestContext())


def lifecycle_stream(snapshots: DataFrame) -> DataFrame:
    """Episodes by row, late rows marked (see `Lifecycle`). Rows without a state, time or sequence are left out."""
    rows = snapshots.select("instrument", "received_ts_ns", "source_sequence", "state", F.coalesce(F.col("eid").cast("string"), F.lit("")).alias("eid"))
    return _transform(rows.dropna(subset=["received_ts_ns", "source_sequence", "state"]), ["instrument"], Lifecycle())


def interval_join_stream(anchors: DataFrame, others: DataFrame, before_ns: int, after_ns: int, late: str = "10 minutes") -> DataFrame:
    """Anchors (instrument, anchor_id, anchor_time) with the others (instrument, other_id, other_time) from before_ns
    before to after_ns after them. Watermarks on both sides let Spark drop rows that can meet nothing any more."""
    a = anchors.withColumn("a_ts", micros_of("anchor_time")).withWatermark("a_ts", late).withColumnRenamed("instrument", "a_instrument")
    o = others.withColumn("o_ts", micros_of("other_time")).withWatermark("o_ts", late)
    near = F.expr(f"a_instrument = instrument and o_ts >= a_ts - interval {before_ns // 1_000_000_000 + 1} seconds and o_ts <= a_ts + interval {after_ns // 1_000_000_000 + 1} seconds")
    exact = (F.col("other_time") >= F.col("anchor_time") - before_ns) & (F.col("other_time") <= F.col("anchor_time") + after_ns)
    return a.join(o, near).where(exact).select("instrument", "anchor_id", "anchor_time", "other_id", "other_time")


def incident_stream(firings: DataFrame, by: list[str], time: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Firings no more than the gap apart, as sessions; a session is final once the watermark has passed its end."""
    stamped = firings.withColumn("ts", micros_of(time)).withWatermark("ts", late)
    return stamped.groupBy(*by, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("firings"), F.min(time).alias("start_ns"), F.max(time).alias("end_ns"))


def drain(stream: DataFrame, path: str) -> DataFrame:
    """Runs a stream over all there is, in micro-batches, into a new table, and reads that.

    A stateful step has as many tasks in every micro-batch as there were shuffle partitions at its start, with keys or
    without, and each commits files of its own: here no more than twice the cores there are."""
    spark: SparkSession = stream.sparkSession
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(min(int(partitions), 2 * spark.sparkContext.defaultParallelism)))
    try:
        # a started stream has a session of its own
        query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/progress").outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")

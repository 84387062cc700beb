"""Episodes of a detector's state on a tick stream: segmentation, runs, anchors, milestones, emitted records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causaltape.functions.clock import floor_div
from causaltape.operators.asof import DAY_NS

ACTIVE = ("BURST", "DECAY_RISK", "DYING")


def episodes(snapshots: DataFrame, keys: list[str], time: str = "received_ts_ns", seq: str = "source_sequence", state: str = "state", eid: str = "eid") -> DataFrame:
    """State-bearing rows with `episode` (null while idle), `ordinal` and the previous row's state.

    Rows without a state are transparent. IDLE closes an episode. A row that isn't idle starts one if the row before
    is idle or missing, or had an id that this row lacks or differs from; taking on an id keeps the episode. Episode
    numbers run from 1 along each key. Rows are exchanged once, by key and day; what a day inherits (last row, counts)
    comes from a table of one row per day, so a single long tape is no single task.
    """
    day = [*keys, "__day"]
    here = Window.partitionBy(*day).orderBy(time, seq)
    now = F.struct(F.col(state).alias("state"), F.col(eid).alias("eid"))

    def starts(row: Column, before: Column) -> Column:
        id_before = before.getField("eid")
        cut_off = id_before.isNotNull() & ~id_before.eqNullSafe(row.getField("eid"))
        return (row.getField("state") != "IDLE") & (before.isNull() | (before.getField("state") == "IDLE") | cut_off)

    rows = snapshots.where(F.col(state).isNotNull()).withColumn("__day", floor_div(F.col(time), DAY_NS)).withColumn("__now", now)
    rows = rows.withColumn("__prev", F.lag("__now").over(here)).withColumn("__n", F.row_number().over(here))
    rows = rows.withColumn("__starts", (F.col("__n") > 1) & starts(F.col("__now"), F.col("__prev")))
    rows = rows.withColumn("__sum", F.sum(F.col("__starts").cast("long")).over(here.rowsBetween(Window.unboundedPreceding, 0)))
    days = rows.groupBy(*day).agg(F.min_by("__now", "__n").alias("first"), F.max_by("__now", "__n").alias("last"), F.count("*").alias("rows"), F.sum(F.col("__starts").cast("long")).alias("started"))
    along = Window.partitionBy(*keys).orderBy("__day")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("__before", F.lag("last").over(along)).withColumn("__opens", starts(F.col("first"), F.col("__before")))
    days = days.withColumn("__all", F.col("started") + F.col("__opens").cast("long"))
    days = days.select(*day, "__before", "__opens", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("__rows"), (F.coalesce(F.sum("__all").over(earlier), F.lit(0)) + F.col("__opens").cast("long")).alias("__started"))
    full, leads = rows.join(days, day), F.col("__n") == 1
    before = F.when(leads, F.col("__before")).otherwise(F.col("__prev"))
    out = full.withColumns({
        f"prev_{state}": before.getField("state"), f"prev_{eid}": before.getField("eid"), "ordinal": F.col("__rows") + F.col("__n"),
        "starts": F.when(leads, F.col("__opens")).otherwise(F.col("__starts")), "episode": F.when(F.col(state) != "IDLE", F.col("__started") + F.col("__sum")),
    })
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def summary(rows: DataFrame, keys: list[str], time: str = "received_ts_ns", seq: str = "source_sequence", state: str = "state", eid: str = "eid") -> DataFrame:
    """One row per episode: span, id, and what its borders hide.

    left_truncated: the tape's first state-bearing row is in it. right_censored: the tape's last one is. forming: it
    never took an id; a forming episode that closed has fizzled."""
    inside = rows.where("episode is not null").groupBy(*keys, "episode").agg(
        F.count("*").alias("rows"), F.min("ordinal").alias("first_ordinal"), F.max("ordinal").alias("last_ordinal"), F.min(time).alias("entry_ns"), F.max(time).alias("exit_ns"), F.max(eid).alias("event_id")
    )
    ends = rows.groupBy(*keys).agg(F.max("ordinal").alias("tape_end"))
    out = inside.join(ends, keys)
    censored = F.col("last_ordinal") == F.col("tape_end")
    return out.select(*keys, "episode", "event_id", "rows", "entry_ns", "exit_ns", (F.col("first_ordinal") == 1).alias("left_truncated"), censored.alias("right_censored"), F.col("event_id").isNull().alias("forming"), (F.col("event_id").isNull() & ~censored).alias("fizzled"))


def state_runs(rows: DataFrame, keys: list[str], time: str = "received_ts_ns", state: str = "state") -> DataFrame:
    """Runs of one state inside an episode: entry, exit, rows, and whether the state was there before."""
    inside = rows.where("episode is not null")
    w = Window.partitionBy(*keys, "episode").orderBy("ordinal")
    change = (F.lag(state).over(w).isNull() | (F.lag(state).over(w) != F.col(state))).cast("long")
    runs = inside.withColumn("__c", change).withColumn("run", F.sum("__c").over(w)).groupBy(*keys, "episode", "run", state).agg(F.min(time).alias("entry_ns"), F.max(time).alias("exit_ns"), F.count("*").alias("rows"))
    return runs.withColumn("re_entry", F.row_number().over(Window.partitionBy(*keys, "episode", state).orderBy("run")) > 1)


def transitions(rows: DataFrame, keys: list[str], state: str = "state") -> DataFrame:
    """Counts of (from, to) over consecutive state-bearing rows, with the share of each `from`."""
    counted = rows.where(f"prev_{state} is not null").groupBy(F.col(f"prev_{state}").alias("from_state"), F.col(state).alias("to_state")).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("from_state")))


def state_anchors(rows: DataFrame, keys: list[str], time: str = "received_ts_ns", seq: str = "source_sequence", state: str = "state", eid: str = "eid", left_policy: str = "absorb") -> DataFrame:
    """The first entry into BURST, DECAY_RISK and DYING of each episode. With `absorb` the state that a tape begins
    in gives no anchor, as it was entered unseen; with `emit` it does."""
    first = rows.where(F.col("episode").isNotNull() & F.col(state).isin(*ACTIVE)).groupBy(*keys, "episode", state).agg(
        F.min(F.struct("ordinal", F.col(time).alias("t"), F.col(seq).alias("s"), F.col(eid).alias("e"))).alias("a")
    )
    if left_policy == "absorb":
        first = first.where("a.ordinal > 1")
    return first.select(*keys, "episode", F.col(state).alias("anchor_state"), F.col("a.t").alias("anchor_time"), F.col("a.s").alias("anchor_sequence"), F.col("a.e").alias("event_id"))


def milestones(rows: DataFrame, keys: list[str], value: str, time: str = "received_ts_ns", state: str = "state") -> DataFrame:
    """The milestone value that stands when an episode first reaches BURST, at the row where that value appeared:
    the first row of the run of equal values that holds the first BURST row. A null value there gives no milestone."""
    inside = rows.where("episode is not null")
    w = Window.partitionBy(*keys, "episode").orderBy("ordinal")
    change = (F.row_number().over(w) == 1) | ~F.lag(value).over(w).eqNullSafe(F.col(value))
    runs = inside.withColumn("__c", change.cast("long")).withColumn("__run", F.sum("__c").over(w))
    armed = runs.groupBy(*keys, "episode").agg(F.min(F.when(F.col(state) == "BURST", F.struct("ordinal", "__run"))).alias("arm")).where("arm is not null")
    armed = armed.select(*keys, "episode", F.col("arm.__run").alias("__run"), F.col("arm.ordinal").alias("arm_ordinal"))
    first = runs.groupBy(*keys, "episode", "__run").agg(F.min(F.struct("ordinal", F.col(time).alias("t"))).alias("f"), F.first(value).alias(value))
    return armed.join(first, [*keys, "episode", "__run"]).where(F.col(value).isNotNull()).select(*keys, "episode", value, "arm_ordinal", F.col("f.ordinal").alias("crossing_ordinal"), F.col("f.t").alias("crossing_ns"))


def emitted_records(sightings: DataFrame, keys: list[str], record_id: str, content: Column, order: str) -> DataFrame:
    """Per record id: first sighting, duplicate sightings and mutations, and whether it stood in the tape's first row."""
    w = Window.partitionBy(*keys, record_id).orderBy(order)
    seen = sightings.withColumn("__h", F.sha2(content, 256)).withColumn("__p", F.lag("__h").over(w))
    return seen.groupBy(*keys, record_id).agg(
        F.min(order).alias("first_seen"), F.count("*").alias("sightings"), F.count_if(F.col("__p") == F.col("__h")).alias("duplicates"),
        F.count_if(F.col("__p") != F.col("__h")).alias("mutations"), F.min(order).eqNullSafe(F.lit(1)).alias("baseline"),
    )


def agreement(live: DataFrame, emitted: DataFrame, keys: list[str]) -> DataFrame:
    """Live anchors against emitted ones, both directions: rows (keys, live_ms, emitted_ms, class, lag_ms)."""
    both = live.join(emitted, keys, "full")
    a, b = F.col("live_ms"), F.col("emitted_ms")
    kind = F.when(a.isNull() & b.isNull(), "NULL_AGREEMENT").when(a.isNull(), "MISSING").when(b.isNull(), "SPURIOUS").when(a == b, "MATCHED").otherwise("VALUE_MISMATCH")
    return both.withColumn("class", kind).withColumn("lag_ms", a - b)


def agreement_classes(live: DataFrame, emitted: DataFrame, tracks: DataFrame, keys: list[str], track: list[str]) -> DataFrame:
    """Agreement of live anchors (keys, live_ms, absorbed) with emitted ones (keys, emitted_ms), given tracks (columns
    `track` of the keys, left_truncated, leaf_first_ms): rows (keys, live_ms, emitted_ms, class, lag_ms).

    What was entered before the leaf began can't be seen live: an absorbed anchor, or a left-truncated track's emitted time
    before the leaf, is EXCLUDED_LEFT_TRUNCATED; an absorbed anchor emitted at the leaf's very first time is
    BOUNDARY_AMBIGUOUS, and later than that VALUE_MISMATCH. Otherwise MATCHED, VALUE_MISMATCH, MISSING (emitted alone),
    SPURIOUS (live alone), NULL_AGREEMENT (both rows without a time). Keys are unique on each side and not null; a key
    without a track counts as untruncated."""
    both = live.join(emitted, keys, "full").join(tracks.select(*track, "left_truncated", "leaf_first_ms"), track, "left")
    a, b, first = F.col("live_ms"), F.col("emitted_ms"), F.col("leaf_first_ms")
    hidden = F.coalesce(F.col("absorbed"), F.lit(False))
    kind = F.when(hidden & b.isNotNull() & (b == first), "BOUNDARY_AMBIGUOUS").when(hidden & (b.isNull() | (b < first)), "EXCLUDED_LEFT_TRUNCATED").when(hidden, "VALUE_MISMATCH")
    kind = kind.when(F.col("left_truncated") & (b < first), "EXCLUDED_LEFT_TRUNCATED").when(a.isNull() & b.isNull(), "NULL_AGREEMENT")
    kind = kind.when(a.isNull(), "MISSING").when(b.isNull(), "SPURIOUS").when(a == b, "MATCHED").otherwise("VALUE_MISMATCH")
    return both.select(*keys, "live_ms", "emitted_ms", kind.alias("class"), (a - b).alias("lag_ms"))


def terminations(rows: DataFrame, keys: list[str], extra: list[str] | None = None, state: str = "state") -> DataFrame:
    """Per episode: the state (and `extra` columns) of its first row, its last state, and why it ended: WENT_IDLE,
    NEW_EPISODE (another one follows without idling) or RIGHT_CENSORED (the tape ends in it)."""
    first = F.min_by(F.struct(F.col(state).alias("entry_state"), *(extra or [])), "ordinal").alias("__f")
    inside = rows.where("episode is not null").groupBy(*keys, "episode").agg(first, F.max_by(state, "ordinal").alias("last_state"), F.max("ordinal").alias("__n"))
    closing = rows.where((F.col(f"prev_{state}") != "IDLE") & ((F.col(state) == "IDLE") | F.col("starts"))).select(*keys, (F.col("ordinal") - 1).alias("__n"), F.when(F.col(state) == "IDLE", "WENT_IDLE").otherwise("NEW_EPISODE").alias("__why"))
    joined = inside.join(closing, [*keys, "__n"], "left")
    return joined.select(*keys, "episode", "__f.*", "last_state", F.coalesce("__why", F.lit("RIGHT_CENSORED")).alias("end_reason"))


def transition_lists(runs: DataFrame, keys: list[str], state: str = "state") -> DataFrame:
    """Per episode its states in order, runs collapsed, as `states`, and the number of changes. A row holds one episode."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("run", F.col(state).alias("s")))), lambda r: r["s"])
    return runs.groupBy(*keys, "episode").agg(listed.alias("states")).withColumn("changes", F.size("states") - 1)

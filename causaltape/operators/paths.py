"""What prices did after an anchor: outcomes over clock horizons and over later bars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causaltape.functions.clock import NS_PER_MS, NS_PER_S, floor_div
from causaltape.operators.asof import DAY_NS, asof_latest, carry_sum
from causaltape.sources.lake import cut


def ladder(pick: np.ufunc, keys: np.ndarray, branch: int) -> np.ndarray:
    """Row k holds `pick` of the branch**k keys from each place on, as far as there are so many."""
    sizes = [1]
    while sizes[-1] * branch <= len(keys):
        sizes.append(sizes[-1] * branch)
    rows = np.empty((len(sizes), len(keys)), keys.dtype)
    rows[:] = keys
    for k, step in enumerate(sizes[:-1]):
        some = len(keys) - step * branch + 1
        rows[k + 1] = rows[k]
        for j in range(1, branch):
            pick(rows[k + 1, :some], rows[k, j * step : j * step + some], out=rows[k + 1, :some])
    return rows


def tick_paths(time: np.ndarray, number: np.ndarray, own: np.ndarray, direction: np.ndarray, t: np.ndarray, seq: np.ndarray, mid: np.ndarray, horizons: dict[str, int], tape_end: int, branch: int = 8) -> dict[str, dict[str, tuple]]:
    """Paths of the anchors of a key (time, number, own price, direction) over its ticks in order of time and sequence: by
    horizon and outcome the values of all anchors, and where they are known. Sums come from running sums, extremes from
    spans of powers of `branch`, and first moves by narrowing them, so that the work follows anchors and ticks and not
    their pairs. A tick without a price above zero counts, and is left out of the prices."""
    if not len(t):
        t, seq, mid = np.array([np.iinfo(np.int64).max]), np.array([0]), np.array([np.nan])
    n, place = len(t), np.arange(len(t))
    # ticks at or before each anchor by time and sequence
    kind = np.repeat([0, 1], [n, len(time)])
    order = np.lexsort((kind, np.concatenate((seq, number)), np.concatenate((t, time))))
    low = np.zeros(len(time), np.int64)
    low[order[kind[order] == 1] - n] = np.cumsum(kind[order] == 0)[kind[order] == 1]

    priced = mid > 0
    mid, own = np.where(priced, mid, np.nan), np.where(own > 0, own, np.nan)
    levels, rank = np.unique(mid[priced], return_inverse=True)
    keys = rank * n + place[priced]
    high_first, low_first = np.full(n, -1), np.full(n, n * n)
    high_first[priced], low_first[priced] = rank * n + (n - 1 - place[priced]), keys
    most, least = ladder(np.maximum, high_first, branch), ladder(np.minimum, low_first, branch)
    sizes = branch ** np.arange(len(most))
    above, below = np.searchsorted(levels, own, "right") * n, np.searchsorted(levels, own, "left") * n
    up, down = low.copy(), low.copy()
    for k in range(len(most) - 1, -1, -1):
        for _ in range(branch - 1):
            for at, table, still in ((up, most, lambda v: v < above), (down, least, lambda v: v >= below)):
                at += np.where((at + sizes[k] <= n) & still(table[k][np.minimum(at, n - 1)]), sizes[k], 0)
    same = np.sort(keys)
    met = np.searchsorted(same, below + low)
    tie = np.full(len(time), n)
    at_price = (met < len(same)) & (above > below)
    tie[at_price] = same[met[at_price]] - below[at_price]

    # a step beside a tick without a price is none
    steps = np.concatenate(([0.0], np.nan_to_num(np.log(mid[1:] / mid[:-1]))))
    moved, moves = np.cumsum(steps), np.cumsum(np.abs(steps))
    second = t // NS_PER_S
    opens = np.flatnonzero(np.concatenate(([True], second[1:] != second[:-1])))
    closes = np.concatenate((opens[1:], [n]))
    unit = np.repeat(np.arange(len(opens)), closes - opens)
    squares = np.concatenate(([0.0], np.cumsum(np.add.reduceat(steps, opens) ** 2)))
    latest = np.maximum.accumulate(np.where(priced, place, -1))

    found = {}
    for name, width in horizons.items():
        high = np.searchsorted(t, time + width, "right")
        some = high > low
        first, last = np.where(some, low, 0), np.where(some, high, 1) - 1
        whole = tape_end >= time + width
        ret = np.log(mid[np.maximum(latest[last], 0)] / own)
        known = some & (latest[last] >= first) & ~np.isnan(own)
        aimed = known & ~np.isnan(direction)
        start = np.nan_to_num(np.log(mid[first] / own))
        total = np.abs(start) + moves[last] - moves[first]
        head = start + moved[np.minimum(closes[unit[first]] - 1, last)] - moved[first]
        tail = moved[last] - moved[np.maximum(opens[unit[last]] - 1, 0)]
        variance = head**2 + np.where(unit[last] > unit[first], tail**2 + squares[unit[last]] - squares[np.minimum(unit[first] + 1, unit[last])], 0.0)
        k = np.searchsorted(sizes, last - first + 1, "right") - 1
        top, bottom = most[k, first], least[k, first]
        for j in range(1, branch):
            at = np.minimum(first + j * sizes[k], last + 1 - sizes[k])
            top, bottom = np.maximum(top, most[k, at]), np.minimum(bottom, least[k, at])
        top, bottom = n - 1 - top % n, bottom % n
        best, worst = np.where(direction < 0, bottom, top), np.where(direction < 0, top, bottom)
        offset = lambda at: (t[np.minimum(at, n - 1)] - time) // NS_PER_MS
        good, bad = (offset(np.where(direction < 0, x, y)) for x, y in ((down, up), (up, down)))
        both = aimed & (up < high) & (down < high)
        gain = lambda at, side: np.maximum(side * np.log(mid[at] / own), 0.0)
        always = np.ones(len(time), bool)
        found[name] = {
            "ticks": (np.where(some, high - low, 0), always), "endpoint_return": (ret, known), "signed_return": (direction * ret, aimed), "mfe": (gain(best, direction), aimed), "mae": (gain(worst, -direction), aimed),
            "mfe_offset_ms": (offset(best), aimed), "mae_offset_ms": (offset(worst), aimed), "favorable_first": (good < bad, both), "adverse_first": (bad < good, both),
            "covered_ns": (np.where(~some, 0, np.where(whole, width, t[last] - time)), always), "tie": (some & (tie < high), always), "realized_variance": (np.where(some, np.nan_to_num(variance), 0.0), always),
            "path_efficiency": (np.divide(ret, total, where=total > 0, out=np.zeros(len(time))), known & (total > 0)), "complete": (whole, always),
        }
    return found


#: What `tick_paths` has for an anchor and horizon.
MEASURES = {
    "ticks": "long", "endpoint_return": "double", "signed_return": "double", "mfe": "double", "mae": "double", "mfe_offset_ms": "long", "mae_offset_ms": "long", "favorable_first": "boolean", "adverse_first": "boolean",
    "covered_ns": "long", "tie": "boolean", "realized_variance": "double", "path_efficiency": "double", "complete": "boolean",
}
#: A span of time of a key that is worked on at once is no shorter than this.
SPAN_NS = 3600 * NS_PER_S


def _sides(anchors: DataFrame, ticks: DataFrame, by: list[str], horizons: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """Anchors under their span and ticks under theirs and the one before."""
    span = max(*horizons.values(), SPAN_NS)
    edge = np.iinfo(np.int64)
    last = ticks.groupBy(*by).agg(F.max("received_ts_ns").alias("__end"))
    # an anchor without a time lies behind all ticks
    time = F.coalesce("anchor_time", F.lit(4 * 10**18))
    asked = anchors.join(last, by, "left").select(*by, "anchor_id", time.alias("__t"), F.coalesce("anchor_seq", F.lit(edge.max)).alias("__s"), F.col("anchor_mid").cast("double").alias("__m"), F.col("direction").cast("double").alias("__d"), F.coalesce("__end", F.lit(edge.min)).alias("__end"), floor_div(time, span).alias("__span"))
    own = floor_div(F.col("received_ts_ns"), span)
    seen = ticks.dropna(subset=[*by, "received_ts_ns"]).select(*by, F.col("received_ts_ns").alias("__t"), F.coalesce("source_sequence", F.lit(edge.min)).alias("__s"), F.col("mid").cast("double").alias("__m"), F.explode(F.array(own, own - 1)).alias("__span"))
    # anchors may be rows of the ticks themselves, so one side takes new columns
    return asked, seen.toDF(*seen.columns)


def _found(left: pa.Table, right: pa.Table, horizons: dict[str, int], branch: int) -> dict[str, dict[str, tuple]]:
    """`tick_paths` of the anchors and ticks of a span."""
    floats = lambda c: c.to_numpy() if not c.null_count else c.fill_null(float("nan")).to_numpy()
    t, seq, mid = right["__t"].to_numpy(), right["__s"].to_numpy(), floats(right["__m"])
    order = np.lexsort((seq, t)) if left.num_rows else np.zeros(0, np.int64)
    end = left["__end"][0].as_py() if left.num_rows else np.iinfo(np.int64).min
    with np.errstate(all="ignore"):
        return tick_paths(left["__t"].to_numpy(), left["__s"].to_numpy(), floats(left["__m"]), floats(left["__d"]), t[order], seq[order], mid[order], horizons, end, branch)


def forward_paths(anchors: DataFrame, ticks: DataFrame, by: list[str], horizons: dict[str, int], branch: int = 8) -> DataFrame:
    """A row per anchor and horizon, whether or not ticks follow.

    Ticks count if their (received, sequence) is above the anchor's and they are received by the end of the horizon.
    A horizon is complete once a tick at or after its end exists on the tape; else it is censored by the tape's end.
    Realised variance squares the log step of each one-second bucket, whose opening price is the tick before it; the
    first tick's step is from the anchor's price. Directions are 1 or -1. Favorable and adverse come first by millisecond, so
    that both may be false. covered_ns is the horizon if it is complete and has a tick, else the time to its last tick;
    continuation and reversal distances are the excursions under their other names.

    A key's tape is cut into spans as long as the longest horizon. Anchors go to their span and ticks to theirs and the
    one before, so each span has all it needs, every tick is exchanged twice and every anchor once, however many ticks a
    horizon holds. Inside a span anchors meet whole columns (`tick_paths`). What one task holds is the ticks of a key in two
    spans; `branch` sets how many lookups an extreme takes against how many columns are kept for it.
    """
    asked, seen = _sides(anchors, ticks, by, horizons)

    def of(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        for name, columns in _found(left, right, horizons, branch).items():
            arrays = [*left.select([*by, "anchor_id"]).columns, pa.array([name] * left.num_rows, pa.string()), *[pa.array(v, mask=~known) for v, known in columns.values()]]
            parts.append(pa.Table.from_arrays(arrays, [*by, "anchor_id", "horizon", *columns]))
        return pa.concat_tables(parts)

    schema = asked.select(*by, "anchor_id").schema
    for name, kind in {"horizon": "string", **MEASURES}.items():
        schema = schema.add(name, kind)
    keys = [*by, "__span"]
    got = asked.groupBy(*keys).cogroup(seen.groupBy(*keys)).applyInArrow(of, schema)
    return got.select(
        *by, "anchor_id", "horizon", "ticks", "endpoint_return", "signed_return", "mfe", "mae", "mfe_offset_ms", "mae_offset_ms", "favorable_first", "adverse_first", F.col("mfe").alias("continuation_distance"), F.col("mae").alias("reversal_distance"),
        "covered_ns", "tie", "realized_variance", "path_efficiency", "complete", F.when(~F.col("complete"), "DEVELOPMENT_BOUNDARY").alias("censor_reason"),
    )


def wide_paths(anchors: DataFrame, ticks: DataFrame, by: list[str], horizons: dict[str, int], measures: list[str], branch: int = 8) -> DataFrame:
    """A row per anchor: anchor_id and, for each measure of `forward_paths` that is asked for, a column `measure_horizon`. Where
    all horizons of an anchor are wanted together, they need no exchange to meet, and other measures leave no task."""

    def of(left: pa.Table, right: pa.Table) -> pa.Table:
        found = _found(left, right, horizons, branch)
        columns = [pa.array(values, mask=~known) for h in horizons for values, known in (found[h][m] for m in measures)]
        return pa.Table.from_arrays([left["anchor_id"], *columns], schema.names)

    asked, seen = _sides(anchors, ticks, by, horizons)
    schema = asked.select("anchor_id").schema
    for h in horizons:
        for m in measures:
            schema = schema.add(f"{m}_{h}", MEASURES[m])
    keys = [*by, "__span"]
    return asked.groupBy(*keys).cogroup(seen.groupBy(*keys)).applyInArrow(of, schema)


def baseline_anchors(rows: DataFrame, keys: list[str], every: int = 500, time: str = "received_ts_ns", seq: str = "source_sequence") -> DataFrame:
    """Every n-th row of each key in order, numbered in day buckets with a carry."""
    days = rows.withColumn("__day", floor_div(F.col(time), DAY_NS))
    return carry_sum(days, keys, [F.col(time), F.col(seq)], F.lit(1), "__day", "row_index").where(F.col("row_index") % every == 0).drop("__day")


def bar_outcomes(anchors: DataFrame, bars: DataFrame, by: list[str], counts: list[int], cutoff: int) -> DataFrame:
    """Per anchor, scale and number of bars: outcomes over the first bars that lie fully after the anchor.

    The first bar opens after the anchor's event time and is known after the anchor's (received, sequence) and before
    the cutoff. Both conditions hold from some bar on, so its number (first_bar, counted from 1 per key and scale)
    follows from two as-of joins, and later bars are found by number. Bars have columns open_ns, close_ns, open, high, low, close, available_time_ns, trigger_sequence.
    """
    w = Window.partitionBy(*by, "scale").orderBy("open_ns")
    known = F.col("available_time_ns").isNotNull() & (F.col("available_time_ns") < cutoff)
    bars = cut(bars, "bars")  # read by every join below
    numbered = bars.withColumn("bar_no", F.row_number().over(w).cast("long")).withColumn("prev_close", F.lag("close").over(w)).withColumn("known", known)
    numbered = numbered.withColumn("next_known", F.first(F.when(F.col("known"), F.col("bar_no")), ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    a = anchors.join(bars.select(*by, "scale").distinct(), by)
    keys = [*by, "scale"]
    opened = asof_latest(a, numbered, keys, "event_ts_ns", "open_ns", "anchor_seq", "bar_no", ["bar_no"]).withColumnRenamed("ctx_bar_no", "opened")
    told = asof_latest(opened, numbered.where("known").withColumn("last_no", F.col("bar_no")), keys, "anchor_time", "available_time_ns", "anchor_seq", "trigger_sequence", ["last_no"], by_sequence=True)
    wanted = told.withColumn("bar_no", F.greatest(F.coalesce("opened", F.lit(0)), F.coalesce("ctx_last_no", F.lit(0))) + 1)
    near = wanted.join(numbered.select(*keys, "bar_no", "next_known"), [*keys, "bar_no"]).select("anchor_id", "scale", F.col("next_known").alias("first_bar"))
    every = a.select(*by, "anchor_id", "anchor_mid", "direction", "scale", F.explode(F.array(*[F.lit(c) for c in counts])).alias("bars"))
    every = every.join(near, ["anchor_id", "scale"], "left").withColumn("bar_no", F.explode_outer(F.when(F.col("first_bar").isNotNull(), F.sequence(F.col("first_bar"), F.col("first_bar") + F.col("bars") - 1))))
    got = every.join(numbered.select(*by, "scale", "bar_no", "high", "low", "close", "prev_close", "known"), [*by, "scale", "bar_no"], "left")
    base = F.when(F.col("bar_no") == F.col("first_bar"), F.col("anchor_mid")).otherwise(F.col("prev_close"))
    out = got.groupBy(*by, "anchor_id", "scale", "bars").agg(
        F.first("first_bar").alias("first_bar"), F.count("close").alias("found"), F.count_if(F.col("known")).alias("known"), F.max_by("close", "bar_no").alias("last_close"), F.first("anchor_mid").alias("m"), F.first("direction").alias("d"),
        F.max(F.col("direction") * F.ln(F.col("high") / F.col("anchor_mid"))).alias("hi"), F.min(F.col("direction") * F.ln(F.col("low") / F.col("anchor_mid"))).alias("lo"), F.sum(F.pow(F.ln(F.col("close") / base), F.lit(2.0))).alias("rv"),
    )
    complete = (F.col("found") == F.col("bars")) & (F.col("known") == F.col("bars"))
    ret = F.ln(F.col("last_close") / F.col("m"))
    reason = F.when(F.col("found") < F.col("bars"), "NO_FULLY_POST_ANCHOR_BAR").when(F.col("known") < F.col("bars"), "UNRESOLVED_AVAILABILITY")
    done = lambda c: F.when(complete, c)
    return out.select(*by, "anchor_id", "scale", "bars", "first_bar", done(ret).alias("bar_return"), done(F.col("d") * ret).alias("signed_return"), done(F.greatest("hi", F.lit(0.0))).alias("mfe"), done(F.greatest(-F.col("lo"), F.lit(0.0))).alias("mae"), done(F.col("rv")).alias("realized_volatility"), complete.alias("complete"), reason.alias("censor_reason"))

"""Context around anchors: support, sequences, zones, breaks, firings, exposure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causaltape.operators import quantiles


def support_by_month(cells: DataFrame, by: list[str], month: str, value: str, half: str | None = None) -> DataFrame:
    """Per cell: size, months, support label, dominance of one month, and whether the months' medians share a sign.

    300 and more are supported; 150 to 299 are a fallback if at least three months have 50 each. With `half` (two values,
    which side of the leaf's midpoint a row falls on) also `halves_agree`, both halves' medians having one sign, and
    `stable`: months' signs consistent over at least three of them and the halves agreeing."""
    seen = cells.where(F.col(value).isNotNull())
    per, *rest = quantiles.medians(seen, [[*by, month], *([[*by, half]] if half else [])], value)
    return _support(per.withColumnRenamed("median", "m"), rest[0] if rest else None, by)


def _support(per: DataFrame, halves: DataFrame | None, by: list[str]) -> DataFrame:
    got = per.groupBy(*by).agg(
        F.sum("n").alias("n"), F.count("*").alias("months"), F.count_if(F.col("n") >= 50).alias("full_months"), (F.max("n") / F.sum("n")).alias("largest_share"),
        (F.greatest(F.count_if(F.col("m") > 0), F.count_if(F.col("m") < 0)) == F.count("*")).alias("consistent"),
    )
    label = F.when(F.col("n") >= 300, "SUPPORTED").when((F.col("n") >= 150) & (F.col("full_months") >= 3), "LOW_SUPPORT_FALLBACK").otherwise("INSUFFICIENT_SUPPORT")
    out = got.withColumn("support", label).withColumn("dominated", F.col("largest_share") > 0.5)
    if halves is None:
        return out
    sides = halves.groupBy(*by).agg((F.abs(F.sum(F.signum("median"))) == 2).alias("__agree"))
    return null_safe_join(out, sides, by).withColumn("halves_agree", F.coalesce("__agree", F.lit(False))).drop("__agree").withColumn("stable", F.col("consistent") & (F.col("months") >= 3) & F.col("halves_agree"))


def null_safe_join(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Left join on columns in which null equals null, with the columns of `by` once."""
    other = right.withColumnsRenamed({c: f"__r_{c}" for c in by})
    test = F.lit(True)
    for c in by:
        test = test & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
    return left.join(other, test, "left").drop(*[f"__r_{c}" for c in by])


def conditioning(rows: DataFrame, cell: list[str], outcome: str, value: str, month: str, half: str, reference: DataFrame) -> DataFrame:
    """Per cell and outcome: support_by_month with halves, the median, and its effect against the outcome's reference
    (outcome, median, iqr). Material: the effect reaches a tenth of the reference's interquartile range. Rows without a
    value are outside; a cell whose outcome has no reference has null effect and null `material`."""
    seen = rows.where(F.col(value).isNotNull())
    by = [*cell, outcome]
    months, halves, whole = quantiles.medians(seen, [[*by, month], [*by, half], by], value)
    support, medians = _support(months.withColumnRenamed("median", "m"), halves, by), whole.drop("n")
    ref = reference.select(outcome, F.col("median").alias("__m"), F.col("iqr").alias("__iqr"))
    out = null_safe_join(support, medians, by).join(ref, outcome, "left").withColumn("effect", F.col("median") - F.col("__m"))
    return out.withColumn("material", F.abs("effect") >= 0.1 * F.col("__iqr")).drop("__m", "__iqr")


def month_blocks(rows: DataFrame, cell: list[str], outcome: str, value: str, month: str) -> DataFrame:
    """The block table under `conditioning`: size and median per cell, outcome and month."""
    return quantiles.medians(rows, [[*cell, outcome, month]], value)[0]


def event_sequences(events: DataFrame, anchor: str, order: list[str], label: str, month: str, time: str, longest: int = 4, block: int = 10_000) -> DataFrame:
    """Runs of up to `longest` neighbouring event labels of an anchor: how often they occur, at how many anchors, and
    in how many months (that of their first event).

    Events are numbered in day buckets with a carry and then stand in blocks of `block`; the first few of a block are
    also put at the end of the block before, so that no window holds more."""
    from causaltape.functions.clock import floor_div
    from causaltape.operators.asof import DAY_NS, carry_sum

    days = events.withColumn("__day", floor_div(F.col(time), DAY_NS))
    n = carry_sum(days, [anchor], [F.col(c) for c in order], F.lit(1), "__day", "__n").withColumn("__n", F.col("__n") - 1)
    own = floor_div(F.col("__n"), block)
    guests = (F.col("__n") % block < longest - 1) & (own > 0)
    placed = n.select(anchor, month, F.col(label).alias("__label"), "__n", F.explode(F.when(guests, F.array(own, own - 1)).otherwise(F.array(own))).alias("__block"))
    w = Window.partitionBy(anchor, "__block").orderBy("__n")
    runs = placed.select(anchor, month, "__n", "__block", *[F.lead("__label", k).over(w).alias(f"__{k}") for k in range(longest)]).where(floor_div(F.col("__n"), block) == F.col("__block"))
    grams = F.array(*[F.when(F.col(f"__{k}").isNotNull(), F.concat_ws(">", *[f"__{j}" for j in range(k + 1)])) for k in range(longest)])
    counted = runs.select(anchor, month, F.explode(grams).alias("sequence")).where("sequence is not null").groupBy("sequence", anchor, month).agg(F.count("*").alias("n"))
    return counted.groupBy("sequence").agg(F.sum("n").alias("n"), F.count_distinct(anchor).alias("anchors"), F.count_distinct(month).alias("months"))


def named_pairs(events: DataFrame, pairs: DataFrame, by: list[str], label: str, time: str) -> DataFrame:
    """Per named pair (a, b): rows of `a`, those that had a `b` of their key at or before them, the status of the pair
    and the worst status of all. UNKNOWN: no row of `a`, or no `b` before any; PARTIAL: before some; KNOWN: before all.
    `pairs` is a declared list."""
    from causaltape.operators.portfolio import severity

    first = events.groupBy(*by, F.col(label).alias("b")).agg(F.min(time).alias("__first"))
    rows = events.join(F.broadcast(pairs), F.col(label) == F.col("a")).select(*by, "a", "b", time).join(first, [*by, "b"], "left")
    met = rows.groupBy("a", "b").agg(F.count("*").alias("rows"), F.count_if(F.col("__first") <= F.col(time)).alias("matched"))
    full = pairs.join(met, ["a", "b"], "left").fillna(0, ["rows", "matched"])
    status = F.when(F.col("matched") == 0, "UNKNOWN").when(F.col("matched") < F.col("rows"), "PARTIAL").otherwise("KNOWN")
    judged = full.withColumn("status", status)
    return judged.join(F.broadcast(judged.agg(F.max_by("status", severity(F.col("status"))).alias("overall"))))


def exposure_verdict(effects: DataFrame, least_pairs: int, material: float) -> DataFrame:
    """One row from effects (domain, pairs, effect), domains TICK and BAR: where firings move the outcome. INCONCLUSIVE
    if a domain has fewer pairs than `least_pairs`; else by which effects reach `material` in size."""
    of = lambda domain, column: F.max(F.when(F.col("domain") == domain, F.col(column)))
    one = effects.agg(*[of(d, c).alias(f"{d.lower()}_{c}") for d in ("TICK", "BAR") for c in ("pairs", "effect")])
    few = lambda d: F.coalesce(F.col(f"{d}_pairs"), F.lit(0)) < least_pairs
    tick, bar = (F.abs(f"{d}_effect") >= material for d in ("tick", "bar"))
    verdict = F.when(few("tick") | few("bar"), "INCONCLUSIVE").when(tick & bar, "BOTH").when(tick, "TICK_DOMAIN_ONLY").when(bar, "BAR_DOMAIN_ONLY").otherwise("NONE")
    return one.withColumn("verdict", verdict)


def primary_scale(counts: DataFrame, by: list[str], scale: str, width: str, n: str = "n") -> DataFrame:
    """The coarsest scale with 300 events, or else with 150; null if none."""
    best = F.coalesce(F.max_by(scale, F.when(F.col(n) >= 300, F.col(width))), F.max_by(scale, F.when(F.col(n) >= 150, F.col(width))))
    return counts.groupBy(*by).agg(best.alias("primary_scale"))


def zone_lifecycle(zones: DataFrame, events: DataFrame, tape_start: int) -> DataFrame:
    """Zones (zone_id, formed_ns) with the first touch, invalidation and cancellation at or after their formation.

    Status: INVALIDATED or CANCELLED, whichever came first; else censored, touched or not. A zone formed before the
    tape is left-truncated."""
    first = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("event_ns")))
    seen = zones.join(events, "zone_id", "left").where("event_ns is null or event_ns >= formed_ns").groupBy("zone_id", "formed_ns").agg(first("touch").alias("touch_ns"), first("invalidate").alias("invalid_ns"), first("cancel").alias("cancel_ns"))
    full = zones.select("zone_id", "formed_ns").join(seen, ["zone_id", "formed_ns"], "left")
    i, c, t = F.col("invalid_ns"), F.col("cancel_ns"), F.col("touch_ns")
    status = F.when(i.isNotNull() & (c.isNull() | (i <= c)), "INVALIDATED").when(c.isNotNull(), "CANCELLED").when(t.isNotNull(), "CENSORED_TOUCHED").otherwise("CENSORED_UNTOUCHED")
    return full.select("zone_id", "formed_ns", "touch_ns", status.alias("status"), F.least(i, c).alias("end_ns"), (F.col("formed_ns") < tape_start).alias("left_truncated"))


def nesting(inner: DataFrame, outer: DataFrame, by: list[str]) -> DataFrame:
    """Zones of one scale against those of a coarser one (zone_id, start_ns, end_ns, low, high): NESTED, OVERLAP,
    INDEPENDENT. A zone that lies inside any coarser one is nested, whatever else it overlaps."""
    from causaltape.operators.intervals import overlapping_pairs

    met = overlapping_pairs(inner, outer, by).where((F.col("low") <= F.col("r_high")) & (F.col("r_low") <= F.col("high")))
    inside = (F.col("low") >= F.col("r_low")) & (F.col("high") <= F.col("r_high")) & (F.col("start_ns") >= F.col("r_start_ns")) & (F.col("end_ns") <= F.col("r_end_ns"))
    found = met.groupBy(*by, "zone_id").agg(F.max(inside).alias("__in"))
    return inner.join(found, [*by, "zone_id"], "left").withColumn("relation", F.when(F.col("__in"), "NESTED").when(F.col("__in").isNotNull(), "OVERLAP").otherwise("INDEPENDENT")).drop("__in")


def scale_agreement(events: DataFrame, by: list[str], scale: str, scales: list[str], time: str, side: str, window_ns: int, horizon_ns: int) -> DataFrame:
    """Events of several scales (declared from fine to coarse) and two sides (1, -1) with: `since_opposing_ns`, time since
    the last event of the other side at the same scale; `vs_coarser` and `vs_finer`, whether the nearest event of the next
    scale within the window has the same time (COINCIDES), came before (FOLLOWS, also if as near as a later one) or comes after
    (PRECEDES), else NONE; and `contradicted`, whether the next coarser scale has an event of the other side within the
    horizon, its own time included.

    Times are first reduced to one row per key and time; both directions are then carried over day buckets for all
    scales and sides at once. Events of other scales or sides, or without a time or key, are left out; repeats stay."""
    from causaltape.functions.clock import floor_div
    from causaltape.operators.asof import DAY_NS, carry_many

    known = events.dropna(subset=[time, *by]).where(F.col(scale).isin(scales) & F.col(side).isin(1, -1))
    cells = {f"{i}_{n}": (F.col(scale) == name) & (F.col(side) == s) for i, name in enumerate(scales) for n, s in (("u", 1), ("d", -1))}
    rows = known.groupBy(*by, F.col(time).alias("__t")).agg(*[F.max(F.when(test, F.col(time))).alias(f"__h{c}") for c, test in cells.items()])
    rows = rows.withColumn("__day", floor_div(F.col("__t"), DAY_NS)).withColumn("__nday", -F.col("__day"))
    rows = carry_many(rows, by, [F.col("__t")], {f"__p{c}": F.col(f"__h{c}") for c in cells}, "__day")
    rows = carry_many(rows, by, [-F.col("__t")], {f"__n{c}": F.col(f"__h{c}") for c in cells}, "__nday")
    full = known.withColumn("__t", F.col(time)).join(rows.drop("__day", "__nday"), [*by, "__t"])

    def of(shift: int, pick) -> Column:
        """`pick` of the scale that is `shift` steps coarser than the row's own."""
        out = F.lit(None).cast("long")
        for i, name in enumerate(scales):
            if 0 <= i + shift < len(scales):
                out = F.when(F.col(scale) == name, pick(i + shift)).otherwise(out)
        return out

    other = lambda way: lambda i: F.when(F.col(side) == 1, F.col(f"__{way}{i}_d")).otherwise(F.col(f"__{way}{i}_u"))
    t = F.col(time)

    def relation(shift: int) -> Column:
        back = t - of(shift, lambda i: F.greatest(f"__p{i}_u", f"__p{i}_d"))
        ahead = of(shift, lambda i: F.least(f"__n{i}_u", f"__n{i}_d")) - t
        near = F.least(back, ahead)
        return F.when(near.isNull() | (near > window_ns), "NONE").when(near == 0, "COINCIDES").when(back == near, "FOLLOWS").otherwise("PRECEDES")

    against = of(1, other("n"))
    marked = {"since_opposing_ns": t - of(0, other("p")), "vs_coarser": relation(1), "vs_finer": relation(-1), "contradicted": F.coalesce(against - t <= horizon_ns, F.lit(False))}
    return full.select(*events.columns, *[v.alias(n) for n, v in marked.items()])


def paired_firings(firings: DataFrame, by: list[str], time: str, side: str, order: str, window_ns: int) -> DataFrame:
    """Firings of two sides: TOGETHER if the other side fires at the same time, SEQUENTIAL if within the window, else
    ISOLATED. Neighbours of the other side come from one window per key and day, carried over its borders."""
    from causaltape.functions.clock import floor_div
    from causaltape.operators.asof import DAY_NS, carry_last

    out = firings
    for name, other in (("a", 0), ("b", 1)):
        out = out.withColumn(f"__t{name}", F.when(F.col(side) == other, F.col(time)))
    out = out.withColumn("__day", floor_div(F.col(time), DAY_NS)).withColumn("__neg", -F.col(time)).withColumn("__nday", -F.col("__day"))
    for name in "ab":
        out = carry_last(out, by, [F.col(time), F.col(order)], f"__t{name}", "__day", f"__p{name}")
        out = carry_last(out, by, [F.col("__neg"), F.col(order)], f"__t{name}", "__nday", f"__n{name}")
    before = F.when(F.col(side) == 0, F.col("__pb")).otherwise(F.col("__pa"))
    after = F.when(F.col(side) == 0, F.col("__nb")).otherwise(F.col("__na"))
    near = F.least(F.col(time) - before, after - F.col(time))
    kind = F.when(near == 0, "TOGETHER").when(near <= window_ns, "SEQUENTIAL").otherwise("ISOLATED")
    return out.withColumn("gap_ns", near).withColumn("class", kind).drop(*[c for c in out.columns if c.startswith("__")])


def feed_anomalies(ticks: DataFrame, by: list[str], latency_ns: int, gap_ns: int, closure_ns: int, jump: int) -> DataFrame:
    """Ticks with flags recomputed from their clocks in receipt order: clock inversion, latency spike, event-time gap
    and regression, expected market closure (an event-time gap of `closure_ns` and more), sequence duplicate, gap (of
    more than `jump`) and regression."""
    from causaltape.functions.clock import floor_div
    from causaltape.operators.asof import DAY_NS, carry_lag

    days = ticks.withColumn("__day", floor_div(F.col("received_ts_ns"), DAY_NS))
    t = carry_lag(days, by, [F.col("received_ts_ns"), F.col("source_sequence")], ["event_ts_ns", "source_sequence"], "__day").drop("__day")
    step, ahead = F.col("event_ts_ns") - F.col("prev_event_ts_ns"), F.col("source_sequence") - F.col("prev_source_sequence")
    flags = {
        "CLOCK_INVERSION": F.col("received_ts_ns") < F.col("event_ts_ns"), "LATENCY_SPIKE": F.col("received_ts_ns") - F.col("event_ts_ns") > latency_ns, "EVENT_TIME_GAP": step > gap_ns,
        "EVENT_TIME_REGRESSION": step < 0, "EXPECTED_MARKET_CLOSURE": step >= closure_ns, "SEQUENCE_DUPLICATE": ahead == 0, "SEQUENCE_GAP": ahead > jump, "SEQUENCE_REGRESSION": ahead < 0,
    }
    return t.withColumn("anomalies", F.filter(F.array(*[F.when(v, n) for n, v in flags.items()]), lambda a: a.isNotNull()))


def incidents(firings: DataFrame, by: list[str], time: str, gap_ns: int) -> DataFrame:
    """Firings no more than the gap apart, as incidents with start, end and number of firings."""
    from causaltape.functions.clock import floor_div
    from causaltape.operators.asof import DAY_NS, carry_lag, carry_sum

    days = firings.withColumn("__day", floor_div(F.col(time), DAY_NS))
    order = [F.col(time)]
    t = carry_lag(days, by, order, [time], "__day")
    fresh = F.coalesce(F.col(time) - F.col(f"prev_{time}") > gap_ns, F.lit(True))
    numbered = carry_sum(t, by, order, fresh.cast("long"), "__day", "incident")
    return numbered.groupBy(*by, "incident").agg(F.min(time).alias("start_ns"), F.max(time).alias("end_ns"), F.count("*").alias("firings"))


def near_firing(anchors: DataFrame, firings: DataFrame, by: list[str], anchor_id: str, anchor_time: str, firing_time: str, window_ns: int) -> DataFrame:
    """Anchors with `exposed`: whether a firing of their key lies within the window on either side."""
    from causaltape.functions.clock import floor_div

    own = floor_div(F.col(anchor_time), window_ns)
    spread = anchors.select(*by, anchor_id, anchor_time, F.explode(F.array(own - 1, own, own + 1)).alias("__b"))
    fired = firings.select(*by, F.col(firing_time).alias("__f"), floor_div(F.col(firing_time), window_ns).alias("__b"))
    hit = spread.join(fired, [*by, "__b"]).where(F.abs(F.col("__f") - F.col(anchor_time)) <= window_ns).select(anchor_id).distinct().withColumn("exposed", F.lit(True))
    return anchors.join(hit, anchor_id, "left").fillna(False, ["exposed"])


def missing_reason(checks: list[tuple[Column, str]]) -> Column:
    """The first reason that applies, null if nothing is missing."""
    out = F.lit(None).cast("string")
    for test, reason in reversed(checks):
        out = F.when(test, reason).otherwise(out)
    return out

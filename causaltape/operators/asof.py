"""Joins on an availability clock: latest known, lookback windows, forward horizons.

No operator here sorts all rows of one key in one task. Rows fall into time buckets; windows run inside (key, bucket),
and what a bucket inherits from those before it is carried over a table with one row per bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causaltape.functions.clock import floor_div

DAY_NS = 86_400_000_000_000


def carry_last(df: DataFrame, keys: list[str], order: list[Column], value: str, bucket: str, out: str, include_current: bool = True, how: str = "inner") -> DataFrame:
    """Adds `out`: the last non-null `value` at or before (or only before) each row of its key, in the order given.

    `bucket` must not fall along the order. Rows of a key with no such value get null. A bucket's last value is an
    aggregate, with a partial step before its exchange unless `df` is already dealt by key and bucket. Rows with a null key or
    bucket are left out, or with how="left" stay and inherit nothing from other buckets."""
    here = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    latest = df.groupBy(*keys, bucket).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("__last"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carried = latest.select(*keys, bucket, F.last("__last", ignorenulls=True).over(before).alias("__carry"))
    inside = df.withColumn("__in", F.last(value, ignorenulls=True).over(here))
    return inside.join(carried, [*keys, bucket], how).withColumn(out, F.coalesce("__in", "__carry")).drop("__in", "__carry")


def carry_many(df: DataFrame, keys: list[str], order: list[Column], values: dict[str, Column], bucket: str, include_current: bool = True, how: str = "inner") -> DataFrame:
    """carry_last for several values at once: adds a column per name, with one window, one aggregate of buckets and one
    join for all of them. `bucket` must not fall along the order."""
    here = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    held = df.withColumns({f"__v_{n}": v for n, v in values.items()})
    latest = held.groupBy(*keys, bucket).agg(*[F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), F.struct(*order))).alias(f"__l_{n}") for n in values])
    carried = latest.select(*keys, bucket, *[F.last(f"__l_{n}", ignorenulls=True).over(before).alias(f"__c_{n}") for n in values])
    inside = held.withColumns({f"__i_{n}": F.last(f"__v_{n}", ignorenulls=True).over(here) for n in values})
    return inside.join(carried, [*keys, bucket], how).select(*df.columns, *[F.coalesce(f"__i_{n}", f"__c_{n}").alias(n) for n in values])


def carry_sum(df: DataFrame, keys: list[str], order: list[Column], value: Column, bucket: str, out: str) -> DataFrame:
    """Adds `out`: the running sum of `value` up to and with each row of its key, in the order given."""
    here = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = df.withColumn("__v", value).withColumn("__in", F.sum("__v").over(here))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.withColumn("__v", value).groupBy(*keys, bucket).agg(F.sum("__v").alias("__t")).select(*keys, bucket, F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__carry"))
    return inside.join(totals, [*keys, bucket]).withColumn(out, F.col("__in") + F.col("__carry")).drop("__v", "__in", "__carry")


def carry_lag(df: DataFrame, keys: list[str], order: list[Column], values: list[str], bucket: str) -> DataFrame:
    """Adds prev_<value>: the value of the row just before, across bucket borders."""
    packed = df.withColumn("__row", F.struct(*values))
    return carry_last(packed, keys, order, "__row", bucket, "__prev", include_current=False).select("*", *[F.col(f"__prev.{v}").alias(f"prev_{v}") for v in values]).drop("__row", "__prev")


def asof_latest(anchors: DataFrame, contexts: DataFrame, by: list[str], anchor_time: str, context_time: str, anchor_seq: str = "source_sequence", context_seq: str = "source_sequence", fields: list[str] | None = None, strict: bool = False, by_sequence: bool = False, bucket_ns: int = DAY_NS) -> DataFrame:
    """Each anchor with the latest context of its key that is known by then, as columns ctx_<field>; null if none.

    Inclusive: a context available at the anchor's own time counts, and of equal times the last sequence wins.
    by_sequence: at equal time only contexts of at most the anchor's sequence count. Strict: the context's (time,
    sequence) must be below the anchor's. Contexts without a time or with a null key are never used.
    Every anchor stays, one with a null time or key without context. Anchors and contexts are exchanged by key and time bucket twice: whole for the window, and without the
    anchors' columns for what buckets hand on.
    """
    fields = fields or [c for c in contexts.columns if c not in by]
    names = anchors.columns
    ctx = contexts.dropna(subset=[context_time, *by]).select(*by, F.col(context_time).alias("__t"), F.col(context_seq).alias("__s"), F.lit(1 if strict else 0).alias("__kind"), F.struct(*fields).alias("__ctx"))
    anc = anchors.select(*by, F.col(anchor_time).alias("__t"), F.col(anchor_seq).alias("__s"), F.lit(0 if strict else 1).alias("__kind"), F.struct(*names).alias("__anchor"))
    # dealt anew: a union may claim to be dealt by key as its two sides are, though their partitions do not match, and
    # a key and time bucket would then stand in two tasks
    both = ctx.unionByName(anc, allowMissingColumns=True).withColumn("__b", floor_div(F.col("__t"), bucket_ns)).repartition(*by, "__b")
    order = [F.col("__t"), F.col("__s"), F.col("__kind")] if strict or by_sequence else [F.col("__t"), F.col("__kind"), F.col("__s")]
    got = carry_last(both, by, order, "__ctx", "__b", "__found", how="left").where("__anchor is not null")
    return got.select("__anchor.*", *[F.col(f"__found.{f}").alias(f"ctx_{f}") for f in fields])


def asof_families(anchors: DataFrame, contexts: DataFrame, by: list[str], family: str, families: list[str], anchor_time: str, context_time: str, anchor_seq: str = "source_sequence", context_seq: str = "source_sequence", fields: list[str] | None = None, strict: bool = True, bucket_ns: int = DAY_NS) -> DataFrame:
    """Each anchor with the latest context of every declared family of its key: a row per anchor and family, with
    `family`, ctx_<field> and `known`; a family without any context by then has `known` false and null fields.

    All families travel together. However many are declared, anchors and contexts are read and exchanged by key and time
    bucket twice: whole for the window, and without the anchors' columns for what buckets hand on. Strict: a context's (time, sequence) must be below the anchor's; else one at the anchor's own time
    counts. Contexts of other families, and those without a time or key, are never used. Every anchor stays, repeats too; one without a time or key knows nothing."""
    fields = fields or [c for c in contexts.columns if c not in (*by, family)]
    ctx = contexts.dropna(subset=[context_time, *by]).where(F.col(family).isin(families)).select(*by, F.col(context_time).alias("__t"), F.col(context_seq).alias("__s"), F.lit(1 if strict else 0).alias("__kind"), F.col(family).alias("__f"), F.struct(*fields).alias("__ctx"))
    anc = anchors.select(*by, F.col(anchor_time).alias("__t"), F.col(anchor_seq).alias("__s"), F.lit(0 if strict else 1).alias("__kind"), F.struct(*anchors.columns).alias("__anchor"))
    both = ctx.unionByName(anc, allowMissingColumns=True).withColumn("__b", floor_div(F.col("__t"), bucket_ns)).repartition(*by, "__b")
    order = [F.col("__t"), F.col("__s"), F.col("__kind")] if strict else [F.col("__t"), F.col("__kind"), F.col("__s")]
    got = carry_many(both, by, order, {f"__f{i}": F.when(F.col("__f") == name, F.col("__ctx")) for i, name in enumerate(families)}, "__b", how="left").where("__anchor is not null")
    each = got.select("__anchor", F.explode(F.array(*[F.struct(F.lit(name).alias(family), F.col(f"__f{i}").alias("ctx")) for i, name in enumerate(families)])).alias("__one"))
    return each.select("__anchor.*", f"__one.{family}", *[F.col(f"__one.ctx.{f}").alias(f"ctx_{f}") for f in fields], F.col("__one.ctx").isNotNull().alias("known"))


def lookback(anchors: DataFrame, contexts: DataFrame, by: list[str], anchor_time: str, context_time: str, window_ns: int) -> DataFrame:
    """Pairs of anchors and the contexts of their key available in [t - window, t], both ends included.

    An equi-join on (key, bucket of the window's width): each anchor goes to the two buckets its window can touch."""
    ctx = contexts.withColumn("__b", floor_div(F.col(context_time), window_ns))
    own = floor_div(F.col(anchor_time), window_ns)
    anc = anchors.withColumn("__b", F.explode(F.array(own, own - 1)))
    t, u = F.col(anchor_time), F.col(context_time)
    return anc.join(ctx, [*by, "__b"]).where((u <= t) & (u >= t - window_ns)).drop("__b")


def forward(anchors: DataFrame, ticks: DataFrame, by: list[str], start: tuple[str, str], tick: tuple[str, str], width_ns: int) -> DataFrame:
    """Pairs of anchors and the ticks after them, (time, sequence) above the anchor's and time up to start + width."""
    (t, s), (u, v) = start, tick
    own = floor_div(F.col(t), width_ns)
    anc = anchors.withColumn("__b", F.explode(F.array(own, own + 1)))
    tk = ticks.withColumn("__b", floor_div(F.col(u), width_ns))
    after = (F.col(u) > F.col(t)) | ((F.col(u) == F.col(t)) & (F.col(v) > F.col(s)))
    return anc.join(tk, [*by, "__b"]).where(after & (F.col(u) <= F.col(t) + width_ns)).drop("__b")


def between(spans: DataFrame, rows: DataFrame, by: list[str], after: tuple[str, str], until: str, clock: tuple[str, str]) -> DataFrame:
    """Spans with `n` and `last_time`: how many rows of their key have a (time, sequence) above the span's `after` and a
    time up to its `until`, and the time of the last of them, null if none.

    No span meets its rows. These are numbered along their key, and two as-of joins say how many lie up to either end,
    so the work follows spans and rows whatever a span holds. Rows without a time or key count nowhere. Writes a table."""
    from causaltape.sources.lake import cut

    (t, s), (u, v) = after, clock
    known = rows.dropna(subset=[u, *by]).select(*by, F.col(u).alias("__at"), F.col(v).alias("__no"), floor_div(F.col(u), DAY_NS).alias("__day"))
    known = cut(carry_sum(known, by, [F.col("__at"), F.col("__no")], F.lit(1), "__day", "count").drop("__day"), "numbered")
    low = asof_latest(spans, known, by, t, "__at", s, "__no", ["count"], by_sequence=True).withColumnRenamed("ctx_count", "__low")
    high = asof_latest(low, known, by, until, "__at", s, "__no", ["count", "__at"])
    n = F.greatest(F.coalesce("ctx_count", F.lit(0)) - F.coalesce("__low", F.lit(0)), F.lit(0)).cast("long")
    return high.select(*spans.columns, n.alias("n"), F.when(n > 0, F.col("ctx___at")).alias("last_time"))


def first_after(anchors: DataFrame, contexts: DataFrame, by: list[str], anchor_time: str, context_time: str, context_seq: str, fields: list[str], width_ns: int) -> DataFrame:
    """Each anchor with the first context of its key that is later than it by `width_ns` at most, as columns ctx_<field>
    (context_time among them); of equal times the least sequence. An as-of join with both clocks turned round."""
    turned = contexts.select(*by, *fields, context_time, (-F.col(context_time)).alias("__u"), (-F.col(context_seq)).alias("__v"))
    # at the anchor's own time no sequence is below this one
    asked = anchors.withColumn("__t", -F.col(anchor_time)).withColumn("__s", F.lit(-(2**63)).cast("long"))
    got = asof_latest(asked, turned, by, "__t", "__u", "__s", "__v", [*fields, context_time], strict=True)
    near = F.col(f"ctx_{context_time}") - F.col(anchor_time) <= width_ns
    return got.select(*anchors.columns, *[F.when(near, F.col(f"ctx_{f}")).alias(f"ctx_{f}") for f in (*fields, context_time)])

"""Leaves of a time split: overlap, assignment, exposure, scoring, fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causaltape.functions.scalars import z_score
from causaltape.operators.intervals import overlapping_pairs


def overlapping(leaves: DataFrame, name: str = "leaf", start: str = "start_ns", end: str = "end_ns", by: list[str] | None = None) -> DataFrame:
    """Pairs of half-open intervals (of equal `by`) that overlap, the smaller name first."""
    some = leaves.select(*(by or []), name, start, end)
    met = overlapping_pairs(some, some, by or [], start, end).where(F.col(name) < F.col(f"r_{name}"))
    return met.select(*(by or []), *[F.col(f"{side}{c}").alias(f"{x}_{c2}") for x, side in (("a", ""), ("b", "r_")) for c, c2 in ((name, "name"), (start, "start"), (end, "end"))])


def assign(df: DataFrame, leaves: DataFrame, time: str) -> DataFrame:
    """Rows with the leaf that holds their time, null outside all. Leaves are few and broadcast."""
    spans = leaves.select("leaf", F.col("start_ns").alias("__s"), F.col("end_ns").alias("__e"))
    return df.join(F.broadcast(spans), (F.col(time) >= F.col("__s")) & (F.col(time) < F.col("__e")), "left").drop("__s", "__e")


def unavailable_inputs(rows: DataFrame, inputs: DataFrame, row_id: str, time: str, ids: str = "input_ids") -> DataFrame:
    """(row, input, reason) of each referenced input that doesn't exist or isn't known by the row's time."""
    refs = rows.select(row_id, time, F.explode(ids).alias("input_id"))
    both = refs.join(inputs, "input_id", "left")
    reason = F.when(F.col("available_time_ns").isNull(), "UNKNOWN_INPUT").when(F.col("available_time_ns") > F.col(time), "FUTURE_INPUT")
    return both.withColumn("reason", reason).where("reason is not null").select(row_id, "input_id", "reason")


def missing_ids(required: DataFrame, confirmed: DataFrame, on: str) -> DataFrame:
    """Required ids that are not confirmed; empty if all are."""
    return required.join(confirmed, on, "left_anti")


def contaminated_exposures(exposures: DataFrame, protected: DataFrame) -> DataFrame:
    """Exposures (exposure, purpose, start_ns, end_ns) of detector confirmation that touch a protected holdout, and
    whether an earlier exposure had touched it already."""
    a = exposures.where("purpose = 'detector_confirmation'")
    hit = a.join(F.broadcast(protected.select("leaf", F.col("start_ns").alias("__s"), F.col("end_ns").alias("__e"))), (F.col("start_ns") < F.col("__e")) & (F.col("__s") < F.col("end_ns")))
    first = hit.groupBy("leaf").agg(F.min("exposure").alias("first_exposure"))
    return hit.join(first, "leaf").select("exposure", "leaf", (F.col("exposure") != F.col("first_exposure")).alias("repeated"))


#: Roles of exposures and leaves, fixed values.
CONFIRMATION, HOLDOUTS = "detector_confirmation", ("strategy_holdout", "portfolio_holdout")


def exposure_history(exposures: DataFrame, leaves: DataFrame, by: list[str]) -> DataFrame:
    """Each exposure (by, exposure, role, start_ns, end_ns, exposed_ns) with `leaf` and `verdict`, by its turn.

    An exposure must overlap a declared leaf (by, leaf, role, start_ns, end_ns) of its role, else NO_LEAF; the smallest
    such leaf is named. A strategy or portfolio holdout that overlaps a detector confirmation exposed before it (earlier,
    or at the same time with a smaller id) is CONTAMINATED; `source` is the first of these. All others are ACCEPTED.
    Confirmations without a leaf enter no history and contaminate nothing."""
    named = overlapping_pairs(exposures, leaves, [*by, "role"]).groupBy("exposure").agg(F.min("r_leaf").alias("leaf"))
    known = exposures.join(named, "exposure", "left")
    before = known.where((F.col("role") == CONFIRMATION) & F.col("leaf").isNotNull())
    met = overlapping_pairs(known.where(F.col("role").isin(*HOLDOUTS) & F.col("leaf").isNotNull()), before, by)
    turn = lambda p: F.struct(F.col(f"{p}exposed_ns").alias("at"), F.col(f"{p}exposure").alias("exposure"))
    first = met.where(turn("r_") < turn("")).groupBy("exposure").agg(F.min(turn("r_")).alias("__first"))
    verdict = F.when(F.col("leaf").isNull(), "NO_LEAF").when(F.col("__first").isNotNull(), "CONTAMINATED").otherwise("ACCEPTED")
    return known.join(first, "exposure", "left").select(*exposures.columns, "leaf", verdict.alias("verdict"), F.col("__first.exposure").alias("source"))


def threshold_score(rows: DataFrame, by: list[str], signal: str, outcome: str, threshold: float, cap: float, cost: float) -> DataFrame:
    """Unit scores: a signal at or beyond the threshold acts in its direction. Null signal or outcome abstains; an
    outcome beyond the cap is a breach and abstains, whatever the signal."""
    s, o = F.col(signal), F.col(outcome)
    breach = s.isNotNull() & o.isNotNull() & (F.abs(o) > cap)
    side = F.when(s >= threshold, 1.0).when(s <= -threshold, -1.0)
    acts = s.isNotNull() & o.isNotNull() & ~breach & side.isNotNull()
    got = rows.groupBy(*by).agg(F.count("*").alias("observations"), F.count_if(acts).alias("acted"), F.count_if(~acts).alias("abstentions"), F.count_if(breach).alias("risk_breaches"), F.coalesce(F.sum(F.when(acts, side * o)), F.lit(0.0)).alias("gross_score"))
    return got.withColumn("costs", F.col("acted") * cost).withColumn("net_score", F.col("gross_score") - F.col("costs"))


def fit_and_apply(rows: DataFrame, by: list[str], value: str, leaf: str = "leaf", fit_on: str = "development") -> DataFrame:
    """Adds z: the value standardised by mean and population deviation of the development leaf of its group."""
    fitted = rows.where(F.col(leaf) == fit_on).groupBy(*by).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__d"))
    return rows.join(fitted, by, "left").withColumn("z", z_score(F.col(value), F.col("__m"), F.col("__d"))).drop("__m", "__d")



"""Filters and gates on clocks, order and validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def development_filter(df: DataFrame, clocks: list[str], boundary: int) -> DataFrame:
    """Rows with every clock before the boundary. A null clock ends the job: it can't be judged."""
    checked = [F.when(F.col(c).isNull(), F.raise_error(F.lit(f"null clock {c}"))).otherwise(F.col(c)) for c in clocks]
    return df.where(F.greatest(*checked, F.lit(-(2**63)).cast("long")) < boundary)


def classify(df: DataFrame, by: list[str], clocks: list[str], boundary: int) -> DataFrame:
    """Per part or group: whether it lies before, after or on both sides of the boundary, with counts and borders."""
    inside = F.greatest(*[F.col(c) for c in clocks], F.lit(-(2**63)).cast("long")) < boundary
    borders = [f(c).alias(f"{n}_{c}") for c in clocks for f, n in ((F.min, "min"), (F.max, "max"))]
    got = df.groupBy(*by).agg(F.count("*").alias("rows"), F.count_if(inside).alias("eligible"), *borders)
    kind = F.when(F.col("eligible") == F.col("rows"), "FULL_DEVELOPMENT").when(F.col("eligible") == 0, "FULL_CONFIRMATION").otherwise("MIXED")
    return got.withColumn("class", kind)


def ordering_regressions(df: DataFrame, parts: list[str], position: str, key: list[str]) -> DataFrame:
    """How many rows have a key below that of the row before, in physical order, and how many repeat it.

    Each part is compared inside; the borders between parts are compared over one row per part."""
    w = Window.partitionBy(*parts).orderBy(position)
    k = F.struct(*key)
    inner = df.select(*parts, position, k.alias("k")).withColumn("p", F.lag("k").over(w))
    per = inner.groupBy(*parts).agg(F.count_if(F.col("k") < F.col("p")).alias("regressions"), F.count_if(F.col("k") == F.col("p")).alias("repeats"), F.min_by("k", position).alias("first"), F.max_by("k", position).alias("last"))
    border = per.withColumn("before", F.lag("last").over(Window.orderBy(*parts)))
    return border.agg(F.sum(F.col("regressions") + F.coalesce((F.col("first") < F.col("before")).cast("long"), F.lit(0))).alias("regressions"), F.sum(F.col("repeats") + F.coalesce((F.col("first") == F.col("before")).cast("long"), F.lit(0))).alias("repeats"))


def clock_counters(df: DataFrame, event: str, received: str, columns: list[str]) -> DataFrame:
    """One row of counters: rows, received before its event, not on a whole millisecond, nulls per column."""
    return df.agg(F.count("*").alias("rows"), F.count_if(F.col(received) < F.col(event)).alias("causal_violations"), F.count_if(F.pmod(F.col(event), F.lit(1_000_000)) != 0).alias("sub_millisecond"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns])


def verify_view(view: DataFrame, declared: DataFrame, by: list[str], clocks: list[str], boundary: int) -> DataFrame:
    """Each group of a written view against its declared (rows, max clocks): faults as an array, empty if it holds."""
    found = classify(view, by, clocks, boundary)
    both = declared.join(found.withColumnsRenamed({"rows": "found_rows", **{f"max_{c}": f"found_max_{c}" for c in clocks}}), by, "full")
    faults = [F.when(F.col("found_rows").isNull(), "MISSING"), F.when(F.col("rows").isNull(), "UNDECLARED"), F.when(F.col("rows") != F.col("found_rows"), "ROWS_DIFFER"), F.when(F.col("class") != "FULL_DEVELOPMENT", "BEYOND_BOUNDARY")]
    faults += [F.when(F.col(f"max_{c}") != F.col(f"found_max_{c}"), f"MAX_{c.upper()}_DIFFERS") for c in clocks]
    return both.select(*by, F.filter(F.array(*faults), lambda f: f.isNotNull()).alias("faults"))


def key_faults(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def grid_check(streams: DataFrame, stream: str, time: str, available: str | None = None) -> DataFrame:
    """Per stream: points, repeated times, values known too late, and a fingerprint of the grid; streams share a grid
    if their fingerprints and counts are equal."""
    late = F.count_if(F.col(available) > F.col(time)) if available else F.lit(0).cast("long")
    return streams.groupBy(stream).agg(F.count("*").alias("points"), (F.count("*") - F.count_distinct(time)).alias("repeats"), late.alias("late"), F.bit_xor(F.xxhash64(time)).alias("grid"))


def allowed(df: DataFrame, permissions: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose detector and scale are on the allow-list."""
    return df.join(permissions, on, "left_semi")


def numeric_faults(finite: list[str], probabilities: list[str]) -> Column:
    """Names of columns that hold no finite number, or no probability."""
    bad = [F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")), c) for c in finite]
    bad += [F.when(~F.coalesce(F.col(c).between(0, 1), F.lit(False)), c) for c in probabilities]
    return F.filter(F.array(*bad), lambda b: b.isNotNull())


def require_rising(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """`df`, if along `order` the `value` of each key always rises; else an error that names a key."""
    w = Window.partitionBy(*by).orderBy(order)
    fallen = df.withColumn("__before", F.lag(value).over(w)).where(F.col(value) <= F.col("__before")).select(*by, order).first()
    if fallen is not None:
        raise ValueError(f"{value} does not rise at {fallen.asDict()}")
    return df

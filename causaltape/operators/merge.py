"""Several tables as one ordered stream."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causaltape.sources.lake import cut


def ordered(parts: dict[str, DataFrame], order: list[str], kind: str = "kind", place: str = "place", ranges: int | None = None) -> DataFrame:
    """All rows of the named tables with `kind`, the name of their table, and `place`, their number from 1 in the order of
    `order` and then of the name.

    Rows are dealt to `ranges` sorted ranges (the session's number of shuffle partitions by default) and numbered inside
    them; what a range hands on is its count, so no task orders the whole stream, and one moment that holds many rows is
    split by the columns after it. Ranges come from a sample, so they are written once to the shared folder with the
    rows they hold and read back: building the result runs that job. Nulls come first. Rows equal in all of `order` and
    in kind take consecutive places, which of them first is left open. A column that a table lacks is null. Empty tables
    add nothing."""
    named = [df.select("*", F.lit(name).alias(kind)) for name, df in parts.items()]
    union = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)
    n = ranges or int(union.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(union.repartitionByRange(n, *order, kind).withColumn("__range", F.spark_partition_id()), "ordered")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = dealt.groupBy("__range").agg(F.count("*").alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order, kind))
    return dealt.withColumn("__inside", inside).join(offsets, "__range").withColumn(place, F.col("__before") + F.col("__inside")).drop("__range", "__inside", "__before")

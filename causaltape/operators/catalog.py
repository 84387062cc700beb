"""Versioned records and lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causaltape.functions.clock import rfc3339_ns
from causaltape.sources.lake import cut


def faceted(records: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Records whose facets hold all wanted values; an array facet must contain its value."""
    kinds = dict(records.dtypes)
    test: Column = F.lit(True)
    for facet, value in wanted.items():
        test = test & (F.array_contains(facet, value) if kinds[facet].startswith("array") else F.col(facet).cast("string") == value)
    return records.where(test)


def as_of(records: DataFrame, created: str, at: str) -> DataFrame:
    """Records created at or before an RFC 3339 time, to the nanosecond; unreadable times never count."""
    return records.where(rfc3339_ns(F.col(created)) <= rfc3339_ns(F.lit(at)))


def supersession(records: DataFrame, record_id: str, supersedes: str, facets: list[str]) -> DataFrame:
    """Each record with `link` (ROOT, OK, MISSING_PREDECESSOR, DIFFERENT_FACETS) and whether it is the latest of its
    chain, superseded by nothing."""
    before = records.select(F.col(record_id).alias("__id"), *[F.col(f).alias(f"__{f}") for f in facets])
    same = F.lit(True)
    for f in facets:
        same = same & F.col(f).eqNullSafe(F.col(f"__{f}"))
    joined = records.join(before, F.col(supersedes) == F.col("__id"), "left")
    link = F.when(F.col(supersedes).isNull(), "ROOT").when(F.col("__id").isNull(), "MISSING_PREDECESSOR").when(~same, "DIFFERENT_FACETS").otherwise("OK")
    linked = joined.withColumn("link", link).drop("__id", *[f"__{f}" for f in facets])
    gone = records.where(F.col(supersedes).isNotNull()).select(F.col(supersedes).alias("__gone")).distinct()
    return linked.join(gone, F.col(record_id) == F.col("__gone"), "left").withColumn("latest", F.col("__gone").isNull()).drop("__gone")


def append_checked(existing: DataFrame, new: DataFrame, record_id: str, rules: dict[str, Column]) -> DataFrame:
    """New records with `rejects`, the names of the rules they break; a known or repeated id is DUPLICATE_ID."""
    known = existing.select(F.col(record_id).alias("__k")).distinct()
    times = new.groupBy(record_id).agg(F.count("*").alias("__n"))
    joined = new.join(times, record_id).join(known, F.col(record_id) == F.col("__k"), "left")
    bad = [F.when(F.col("__k").isNotNull() | (F.col("__n") > 1), "DUPLICATE_ID"), *[F.when(~F.coalesce(good, F.lit(False)), name) for name, good in rules.items()]]
    return joined.withColumn("rejects", F.filter(F.array(*bad), lambda b: b.isNotNull())).drop("__k", "__n")


#: Fixed value: the surface under which a change of instrument or dataset is reported.
SCOPE = "instrument_or_dataset_identity"


def version_delta(before: DataFrame, after: DataFrame, key: str, surfaces: list[str], scope: tuple[str, str] | None = None) -> DataFrame:
    """(key, surface, expected, actual) of each surface that two snapshots of a record show differently.

    `scope` names the columns of instrument and dataset: if either differs, both are one more surface, "instrument:dataset".
    Null is a value that equals null; in a scope it is shown as nothing. Arrays are compared whole. A record that only one
    snapshot has differs in every surface that is not null, and in its scope. Both tables hold a key once; empty ones
    give the differences to nothing; other columns are ignored."""
    def long(df: DataFrame, name: str) -> DataFrame:
        cells = [F.struct(F.lit(s).alias("surface"), F.col(s).cast("string").alias(name), F.lit(None).cast("string").alias("__id")) for s in surfaces]
        if scope:
            both = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in scope]
            cells.append(F.struct(F.lit(SCOPE).alias("surface"), F.concat_ws(":", *both).alias(name), F.to_json(F.array(*[F.col(c).cast("string") for c in scope])).alias("__id")))
        return df.select(key, F.inline(F.array(*cells))).withColumnRenamed("__id", f"__{name}")

    both = long(before, "expected").join(long(after, "actual"), [key, "surface"], "full")
    changed = ~F.col("expected").eqNullSafe(F.col("actual")) | ~F.col("__expected").eqNullSafe(F.col("__actual"))
    return both.where(changed).select(key, "surface", "expected", "actual")


def compatibility(before: DataFrame, after: DataFrame, key: str, surfaces: list[str], scope: tuple[str, str] | None = None) -> DataFrame:
    """(key, verdict, changed) of every record of either snapshot: COMPATIBLE, or DELTA_REQUIRED with the surfaces that
    `version_delta` finds, in order of name."""
    found = version_delta(before, after, key, surfaces, scope).groupBy(key).agg(F.array_sort(F.collect_set("surface")).alias("changed"))
    every = before.select(key).unionByName(after.select(key)).distinct()
    got = every.join(found, key, "left")
    return got.select(key, F.when(F.col("changed").isNull(), "COMPATIBLE").otherwise("DELTA_REQUIRED").alias("verdict"), F.coalesce("changed", F.array().cast("array<string>")).alias("changed"))


def illegal_transitions(observed: DataFrame, allowed: DataFrame) -> DataFrame:
    """Observed (from_state, to_state) that no declared transition allows."""
    return observed.join(allowed, ["from_state", "to_state"], "left_anti")


def ancestors(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """All (node, ancestor, distance) of a lineage, of any depth, by path doubling: each round joins the known paths to
    themselves, so paths of up to 2^k edges are known after k rounds. A node on a cycle reaches itself at the length of
    the shortest one, and rounds end once no distance is new. A round's paths are written to the shared folder, so the
    plan stays one join deep and a lost executor costs its running tasks alone."""
    known = edges.select(F.col(child).alias("node"), F.col(parent).alias("ancestor"), F.lit(1).alias("distance")).where("node is not null and ancestor is not null").distinct()
    state = None
    while True:
        known = cut(known, "lineage")
        now = known.agg(F.count("*"), F.sum("distance")).first()
        if now == state:
            return known
        state = now
        step = known.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("next"), F.col("distance").alias("more"))
        longer = known.join(step, "ancestor").select("node", F.col("next").alias("ancestor"), (F.col("distance") + F.col("more")).alias("distance"))
        known = known.unionByName(longer).groupBy("node", "ancestor").agg(F.min("distance").alias("distance"))


def lineage_faults(nodes: DataFrame, edges: DataFrame, node: str = "node", child: str = "child", parent: str = "parent") -> DataFrame:
    """(node, fault): nodes declared twice, parents that don't exist, and nodes that reach themselves."""
    twice = nodes.groupBy(node).count().where("count > 1").select(F.col(node).alias("node"), F.lit("DUPLICATE").alias("fault"))
    lost = edges.select(F.col(child).alias("node"), F.col(parent).alias("__p")).join(nodes.select(F.col(node).alias("__p")).distinct(), "__p", "left_anti").select("node", F.lit("MISSING_PARENT").alias("fault")).distinct()
    around = ancestors(edges, child, parent).where("node = ancestor").select("node", F.lit("CYCLE").alias("fault"))
    return twice.unionByName(lost).unionByName(around)


def shares_ancestor(closure: DataFrame) -> DataFrame:
    """Pairs of nodes with how many ancestors they share. A pair meets at the ancestors it shares alone."""
    a, b = (closure.select("ancestor", F.col("node").alias(x)) for x in ("a", "b"))
    return a.join(b, "ancestor").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))

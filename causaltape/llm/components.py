"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causaltape.llm.shared import cut, drop_table

#: Edges that a map task reduces together.
TOGETHER = 1 << 20


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node it reaches) with the components of the edges (u, v), one per node that isn't smallest."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        least, new = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            own = np.flatnonzero(label != np.arange(len(nodes)))
            return nodes[own], nodes[label[own]]
        label = new


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges with the same components as those of the task, fewer than it has nodes if they fit together."""
    held: list[np.ndarray] = []

    def emit() -> pa.RecordBatch:
        u, v = forest(*np.concatenate(held, axis=1))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for batch in batches:
        held.append(np.stack([c.to_numpy() for c in batch.columns]))
        if sum(h.shape[1] for h in held) >= TOGETHER:
            yield emit()
            held = []
    if held:
        yield emit()


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b", reduced: bool = False) -> DataFrame:
    """Rows (node, component): each node that has an edge to another node, with the smallest node it can reach.

    Edges with a null end and self-loops are ignored; repeated edges count once; an empty table gives an empty one.
    Each map task first replaces its edges by a forest, unless they are `reduced` so already. Each half step is a join and an aggregation on tables in the
    shared folder; only two counts of a round reach the driver. The minimum per node is aggregated before it is joined
    back, so a node with very many neighbours is never gathered in one task, and adaptive execution can split its rows
    in the join. Rounds end when no node has two smaller neighbours, or one that is smaller and one that is larger.
    """
    e = edges.select(F.greatest(src, dst).cast("long").alias("u"), F.least(src, dst).cast("long").alias("v")).where("u > v")
    e = cut(e if reduced else e.mapInArrow(contracted, "u long, v long"), "edges")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        below, above = F.when(F.col("v") < F.col("u"), F.col("v")), F.when(F.col("v") > F.col("u"), F.col("v"))
        near = both.groupBy("u").agg(F.min(below).alias("low"), F.max(below).alias("low_too"), F.max(above).alias("high"))
        least = cut(near.select("u", F.coalesce("low", "u").alias("m"), F.coalesce((F.col("low") != F.col("low_too")) | (F.col("low").isNotNull() & F.col("high").isNotNull()), F.lit(False)).alias("open")), "star-min")
        drop = [e, least]
        if not least.where("open").limit(1).count():
            drop_table(e)
            return least.select(F.col("u").alias("node"), F.col("m").alias("component"))
        large = both.join(least.select("u", "m"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.mapInArrow(contracted, "u long, v long"), "star")
        root = cut(large.groupBy("u").agg(F.min("v").alias("v")), "star-min")
        small = large.join(root.select("u", F.col("v").alias("m")), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(root).mapInArrow(contracted, "u long, v long"), "edges")
        for done in (*drop, large, root):
            drop_table(done)

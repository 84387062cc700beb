"""Near-duplicate vectors by spherical-cap filters of a random product code.

Every vector is listed under the filter directions whose caps hold it; vectors of one cap are candidates. Tight groups
are first drawn together: a vector within half the threshold's angle of a pivot is linked with every other such vector,
so a group of near copies is a ball with a count and never a list of pairs. Candidate balls are then compared by the
angle between their pivots, and only where that leaves the answer open are their vectors compared, in bounded blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causaltape.llm.components import connected_components
from causaltape.llm.shared import MIX1, ROLL, cut, drop_table

#: Independent codes, and the filters that a random direction is expected to pass in each at least.
CODES, LEAST_PASSED = 3, 32
#: Words of a code's block at least; a vector of fewer dimensions is filled up with zeros, which leaves its angles alone.
LEAST_WORDS, LEAST_DIMS = 32, 32
#: Cells of the tables of inner products held at a time, vectors of a block, and what angles may be off by rounding.
CELLS, BLOCK, SLACK = 1 << 18, 256, 1e-7


@lru_cache(maxsize=8)
def product_code(dims: int, words: int, code: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random rotation and two random block codes; a filter direction is one word of each, over the root of two."""
    rng = np.random.default_rng([dims, words, code])
    rotation = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
    half = dims // 2
    blocks = [rng.standard_normal((words, n)) for n in (half, dims - half)]
    first, second = (b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-12) / np.sqrt(2) for b in blocks)
    return rotation, first, second


def passed(words: int) -> float:
    """The filters of a code that a random direction passes. More filters have smaller caps, which two vectors share
    less often; so that the chance to miss a pair stays, a vector passes more of them as their number grows."""
    return max(LEAST_PASSED, 7 * np.log2(words) - 20)


@lru_cache(maxsize=8)
def cap_height(dims: int, words: int) -> float:
    """The inner product that `passed` of words^2 random directions reach, by the share of a sphere's surface in a cap."""
    angle = np.linspace(0, np.pi, 200_001)
    surface = np.cumsum(np.sin(angle) ** (dims - 2))
    return float(np.cos(np.interp(surface[-1] * min(0.5, passed(words) / words**2), surface, angle)))


def passed_filters(unit: np.ndarray, words: int, code: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of each filter whose direction's inner product with a unit vector exceeds the cap's height.

    List decoding: a word of the first block is kept only if the best word of the second could still reach the
    height; the second block is searched for those words alone."""
    dims = max(LEAST_DIMS, unit.shape[1])
    rotation, first, second = product_code(dims, words, code)
    height, half = cap_height(dims, words), dims // 2
    turned = unit @ rotation[: unit.shape[1]]
    a, b = turned[:, :half] @ first.T, turned[:, half:] @ second.T
    row, i = np.nonzero(a >= height - b.max(axis=1, keepdims=True))
    k, j = np.nonzero(b[row] >= (height - a[row, i])[:, None])
    return row[k], (code * words + i[k]) * words + j


def words_for(total: int) -> int:
    """Words of a block, so that a code has about 16 filters a vector, at any number of vectors, and few vectors that are
    not alike share one."""
    return max(LEAST_WORDS, 1 << int(np.ceil(np.log2(max(1, 16 * total)) / 2)))


def matrices(lists: pa.ListArray, *more: pa.ListArray) -> Iterator[tuple[np.ndarray, ...]]:
    """(rows, unit vectors of each list column) for each number of dimensions; rows have the same in all columns."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = [(c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy()[:-1]) for c in (lists, *more)]
    for dims in np.unique(sizes):
        mine = np.flatnonzero(sizes == dims)
        out = []
        for values, begin in flat:
            x = values[begin[mine][:, None] + np.arange(dims)].astype(np.float64)
            x /= np.abs(x).max(axis=1, keepdims=True)
            out.append(x / np.linalg.norm(x, axis=1, keepdims=True))
        yield mine, *out


def list_filters(words: int):
    """Rows (pid, salt, v) to (pid, keys): the buckets of a vector, names of filters mixed with the salt."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pid, salt = batch.column(0), batch.column(1).to_numpy().view(np.uint64)
            for mine, unit in matrices(batch.column(2)):
                step = max(1, min(CELLS // words, CELLS // unit.shape[1]))
                for at in range(0, len(mine), step):
                    got = [passed_filters(unit[at : at + step], words, code) for code in range(CODES)]
                    row, name = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
                    order = np.argsort(row, kind="stable")
                    some = mine[at : at + step]
                    keys = ((name[order].astype(np.uint64) + np.uint64(1)) * ROLL ^ salt[some][row[order]]) * MIX1
                    offsets = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(some)))))
                    yield pa.RecordBatch.from_arrays([pid.take(pa.array(some)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys.view(np.int64)))], ["pid", "keys"])

    return of


def draw_together(reach: float):
    """Rows (pid, hub, v, w) to (pid, ball, angle): the hub's ball if its vector w is within `reach` of v, else one's own."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angle = np.zeros(batch.num_rows)
            for mine, x, y in matrices(batch.column(2), batch.column(3)):
                angle[mine] = np.arccos(np.clip((x * y).sum(axis=1), -1, 1))
            pid, hub = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            own = (angle + SLACK > reach) | (pid == hub)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.where(own, pid, hub)), pa.array(np.where(own, 0.0, angle))], ["pid", "ball", "angle"])

    return of


def judge(threshold: float):
    """Rows (a, b, ra, rb, v, w) of two balls to (a, b, whole): whole if all their vectors are linked with each other,
    not whole if some may be; pairs of balls without a link are left out."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = float(np.arccos(threshold))
        for batch in batches:
            cosine = np.full(batch.num_rows, -1.0)
            for mine, x, y in matrices(batch.column(4), batch.column(5)):
                cosine[mine] = (x * y).sum(axis=1)
            angle, wide = np.arccos(np.clip(cosine, -1, 1)), batch.column(2).to_numpy() + batch.column(3).to_numpy()
            single = wide == 0
            whole = np.where(single, cosine >= threshold, angle + wide + SLACK <= most)
            some = whole | (~single & (angle - wide - SLACK <= most))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(whole)], ["a", "b", "whole"]).filter(pa.array(some))

    return of


def count_links(threshold: float):
    """A block of two balls' vectors, rows (a, b, pid, copies, v, side), to (a, b, pid, n): the copies linked with each."""

    def of(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side, pid, copies = (table.column(c).to_numpy() for c in ("side", "pid", "copies"))
        (_, unit), left = next(matrices(table.column("v").chunk(0))), side == 0
        near = unit[left] @ unit[~left].T >= threshold
        n = np.zeros(len(pid), np.int64)
        n[left], n[~left] = near @ copies[~left], copies[left] @ near
        return table.select(["a", "b", "pid"]).append_column("n", pa.array(n)).filter(pa.array(n > 0))

    return of


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one per input row.

    Vectors of equal non-null label are linked if their cosine in double precision is `threshold` or more.
    Equal vectors of a label are one point with a multiplicity from the start. The hub of a bucket is its first point;
    a point goes to the ball of the hub it meets most often, if that is near enough. Links inside a ball need no
    comparison; balls that share a bucket are compared. Filters are random: the chance to miss a pair at the threshold
    is measured in the tests; no pair below it is linked.

    Vectors that are null, empty, all zero or hold null or non-finite components, vectors with a null label and rows
    with a null id link with nothing. Vectors of different length are never compared. Repeated ids are rows of their
    own, with links of their own. An empty table gives an empty result; other columns are ignored.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    valid = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0), F.lit(False))
    merged = rows.where(valid).groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    points = cut(merged.withColumn("pid", F.monotonically_increasing_id()), "vectors")
    listed = cut(points.select("pid", F.xxhash64("label", F.size("v")).alias("salt"), "v").mapInArrow(list_filters(words_for(points.count())), "pid long, keys array<long>"), "filters")

    one = listed.select("pid", F.explode("keys").alias("key"))
    hubs = cut(one.groupBy("key").agg(F.min("pid").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n"), "hubs")
    shared = cut(one.join(hubs, "key"), "shared")
    met = shared.groupBy("pid", "hub").count().groupBy("pid").agg(F.max_by("hub", F.struct("count", -F.col("hub"))).alias("hub"))
    vector = points.select("pid", "label", "v")
    named = lambda pid, *names: vector.select(*[F.col(c).alias(n) for c, n in zip(vector.columns, (pid, *names), strict=True)])
    near = met.join(named("pid", "l", "v"), "pid").join(named("hub", "m", "w"), "hub").where("l = m and size(v) = size(w)")
    own = shared.select("pid").distinct()
    drawn = near.select("pid", "hub", "v", "w").mapInArrow(draw_together(float(np.arccos(threshold)) / 2), "pid long, ball long, angle double")
    member = own.join(drawn, "pid", "left").select("pid", F.coalesce("ball", "pid").alias("ball"), F.coalesce("angle", F.lit(0.0)).alias("angle"))
    member = cut(member.join(points.select("pid", "rep", "copies"), "pid"), "members")
    balls = cut(member.groupBy("ball").agg(F.sum("copies").alias("size"), F.count("*").alias("points"), F.max("angle").alias("radius"), F.min("rep").alias("rep")), "balls")

    held = cut(shared.join(member.select("pid", "ball"), "pid").select("key", "ball").distinct(), "held")
    pairs = held.withColumnRenamed("ball", "a").join(held.withColumnRenamed("ball", "b"), "key").where("a < b").select("a", "b").distinct()
    sized = balls.join(vector, balls.ball == vector.pid).select("ball", "label", "radius", "v")
    left, right = (sized.select(*[F.col(c).alias(n) for c, n in zip(sized.columns, names, strict=True)]) for names in (("a", "l", "ra", "v"), ("b", "m", "rb", "w")))
    compared = pairs.join(left, "a").join(right, "b").where("l = m and size(v) = size(w)").select("a", "b", "ra", "rb", "v", "w")
    judged = cut(compared.mapInArrow(judge(threshold), "a long, b long, whole boolean"), "judged")

    whole = judged.where("whole").select("a", "b")
    both = whole.unionByName(whole.select(F.col("b").alias("a"), F.col("a").alias("b")))
    beside = both.join(balls.select(F.col("ball").alias("b"), "size"), "b").groupBy("a").agg(F.sum("size").alias("beside"))
    found = blocks_of(judged.where("not whole"), member.join(vector, "pid"), balls).groupBy("a", "b", "block_a", "block_b").applyInArrow(count_links(threshold), "a long, b long, pid long, n long")
    found = cut(found, "open")
    component = connected_components(whole.unionByName(found.select("a", "b").distinct()))
    more = found.groupBy("pid").agg(F.sum("n").alias("more"))

    rooted = cut(balls.join(component, balls.ball == component.node, "left").select("ball", "size", "rep", F.coalesce("component", "ball").alias("root")), "rooted")
    first = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    known = member.select("pid", "ball").join(rooted.select("ball", "size", "root"), "ball").join(first, "root").join(beside, F.col("ball") == F.col("a"), "left").join(more, "pid", "left")
    links = F.col("size") - 1 + F.coalesce("beside", F.lit(0)) + F.coalesce("more", F.lit(0))
    known = known.select("pid", links.alias("n_links"), "component_id")
    classes = cut(points.join(known, "pid", "left").select("label", "v", F.coalesce("n_links", F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id")), "classes")
    for done in (points, listed, hubs, shared, member, balls, held, judged, found, rooted):
        drop_table(done)
    joined = rows.where(valid).join(classes, ["label", "v"]).select("id", "n_links", "component_id")
    alone = rows.where(~valid).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return joined.unionByName(alone).select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def blocks_of(pairs: DataFrame, member: DataFrame, balls: DataFrame) -> DataFrame:
    """Rows (a, b, block_a, block_b, pid, copies, v, side): the vectors of two balls, in pairs of blocks of about BLOCK."""
    blocks = balls.select("ball", F.ceil(F.col("points") / BLOCK).alias("blocks"))
    sized = pairs.join(blocks.select(F.col("ball").alias("a"), F.col("blocks").alias("na")), "a").join(blocks.select(F.col("ball").alias("b"), F.col("blocks").alias("nb")), "b")
    sides = []
    for side, (one, n, other, m) in enumerate((("a", "na", "b", "nb"), ("b", "nb", "a", "na"))):
        mine = sized.join(member.select(F.col("ball").alias(one), "pid", "copies", "v"), one)
        mine = mine.withColumn(f"block_{one}", F.pmod(F.xxhash64("pid"), F.col(n))).withColumn(f"block_{other}", F.explode(F.sequence(F.lit(0).cast("long"), F.col(m) - 1)))
        sides.append(mine.select("a", "b", "block_a", "block_b", "pid", "copies", "v", F.lit(side).alias("side")))
    return sides[0].unionByName(sides[1])

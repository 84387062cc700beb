"""A Merkle manifest of a table: one tree per group, one tree over the groups, and a proof for every row."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causaltape.llm.shared import cut, positions

#: Leaves that one leaf partition holds at most, and one task's part of the nodes above them.
LEAVES = 2187
PROOF = "array<struct<left: string, right: string>>"


def digest(*fields: Column) -> Column:
    """Lower-case hex SHA-256 of the fields, each `-` if null and else its length in UTF-8 bytes, a colon and its text."""
    sized = [F.when(f.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string"))) for f in fields]
    return F.sha2(F.concat(*sized).cast("binary"), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of its path lead to."""
    return F.aggregate(proof, leaf, lambda h, step: F.sha2(F.concat(step.left, h, step.right).cast("binary"), 256))


def parent(children: list[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


def missing(known: np.ndarray, size: int, arity: int) -> list[tuple[int, int]]:
    """The fewest (level, index) of nodes that, with the leaves of the sorted indices `known`, give all paths to the root
    of a tree of `size` leaves: on each level the children of known parents that are not known themselves."""
    level, found = 0, []
    while size > 1:
        parents = np.unique(known // arity)
        children = (parents[:, None] * arity + np.arange(arity)).ravel()
        absent = np.setdiff1d(children[children < size], known, assume_unique=True)
        found += [(level, int(i)) for i in absent]
        known, size, level = parents, -(-size // arity), level + 1
    return found


def proofs(known: dict[int, str], size: int, fetched: dict[tuple[int, int], str], arity: int) -> dict[int, list[tuple[str, str]]]:
    """For each known leaf its (left, right) siblings level by level. Interiors that several leaves share are worked out
    once, from the known leaves and the fetched nodes."""
    steps: list[dict[int, tuple[str, str]]] = []
    level, here = 0, known
    while size > 1:
        own, above = {}, {}
        for p in sorted({i // arity for i in here}):
            run = range(p * arity, min((p + 1) * arity, size))
            nodes = [here[i] if i in here else fetched[level, i] for i in run]
            own |= {i: ("".join(nodes[:k]), "".join(nodes[k + 1 :])) for k, i in enumerate(run) if i in here}
            above[p] = parent(nodes)
        steps.append(own)
        here, size, level = above, -(-size // arity), level + 1
    return {i: [own[i // arity**n] for n, own in enumerate(steps)] for i in known}


def depth_of(arity: int) -> int:
    """Levels of a block of at most LEAVES leaves."""
    depth = 1
    while arity ** (depth + 1) <= LEAVES:
        depth += 1
    return depth


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (tree, block), which follow one another."""
    held, key = [], None
    for batch in batches:
        keys = list(zip(batch.column("tree").to_pylist(), batch.column("block").to_pylist(), strict=True))
        ends = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]] + [len(keys)]
        for start, end in zip([0, *ends], ends, strict=False):
            if start < end:
                if held and keys[start] != key:
                    yield pa.Table.from_batches(held)
                    held = []
                key = keys[start]
                held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def mapped(df: DataFrame, work: Callable[[pa.Table], pa.Table], schema: str, *order: str) -> DataFrame:
    """`work` on the rows of each (tree, block), in order. A block is bounded, and the blocks of a tree spread over tasks."""
    dealt = df.repartition("tree", "block").sortWithinPartitions("tree", "block", *order)
    return dealt.mapInArrow(lambda batches: (b for t in by_block(batches) for b in work(t).to_batches()), schema)


def climb(nodes: DataFrame, arity: int) -> tuple[DataFrame | None, DataFrame]:
    """The nodes that some leaf partition may lack, (tree, level, idx, hash), and the root of each tree, (tree, hash), from
    rows (tree, position, size, hash).

    Blocks of arity^depth leaves become a node each, blocks of those nodes again, until every tree is one node: two rounds
    for some millions of leaves, three for ten thousand millions. The nodes inside the lowest blocks aren't written, for a
    block's own task derives them."""
    depth = depth_of(arity)
    width, tier, inner, tops = arity**depth, 0, None, None
    while True:

        def of(block: pa.Table, tier: int = tier) -> pa.Table:
            tree, first, size = (block.column(c)[0].as_py() for c in ("tree", "position", "size"))
            hashes, rows, level = block.column("hash").to_pylist(), [], 0
            while level < depth and size > 1:
                hashes = [parent(hashes[i : i + arity]) for i in range(0, len(hashes), arity)]
                first, size, level = first // arity, -(-size // arity), level + 1
                if tier or level == depth or size == 1:
                    last = level == depth or size == 1
                    rows += [(tree, tier * depth + level, first + i, h, size, last) for i, h in enumerate(hashes)]
            if not level:
                rows = [(tree, tier * depth, first, hashes[0], 1, True)]
            return pa.Table.from_pylist([dict(zip(("tree", "level", "idx", "hash", "size", "last"), r, strict=True)) for r in rows], pa.schema([("tree", pa.string()), ("level", pa.int64()), ("idx", pa.int64()), ("hash", pa.string()), ("size", pa.int64()), ("last", pa.bool_())]))

        blocks = nodes.select("tree", F.floor(F.col("position") / width).alias("block"), "position", "size", "hash")
        built = cut(mapped(blocks, of, "tree string, level long, idx long, hash string, size long, last boolean", "position"), "merkle")
        above = built.select("tree", "level", "idx", "hash")
        found = built.where("size = 1").select("tree", "hash")
        inner, tops = (above, found) if inner is None else (inner.unionByName(above), tops.unionByName(found))
        nodes = built.where("last and size > 1").select("tree", F.col("idx").alias("position"), "size", "hash")
        if not nodes.limit(1).count():
            return inner, tops
        tier += 1


def copies(level: Column, depth: int, arity: int) -> Column:
    """How many times a node is laid out, so that no more than about 65,536 leaf partitions fetch one copy."""
    return F.greatest(F.lit(1), F.floor(F.pow(F.lit(float(arity)), level - depth) / (1 << 16))).cast("long")


def expand(nodes: DataFrame, inner: DataFrame, tops: DataFrame, arity: int) -> DataFrame:
    """Rows (tree, row, subroot, root, proof) from rows (tree, position, size, hash, row) and each tree's
    (tree, hash, root, proof), where proof leads on from the tree's own root.

    Each leaf partition names the union of the nodes that its leaves lack, fetches them in one join, derives the
    interiors that its leaves share, and writes out each leaf's own proof."""
    depth = depth_of(arity)
    width = arity**depth
    blocked = nodes.withColumn("block", F.floor(F.col("position") / width))
    blocks = blocked.groupBy("tree", "block").agg(F.min("position").alias("low"), F.max("position").alias("high"), F.max("size").alias("size"))

    def needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r["tree"], r["block"], level, i) for r in batch.to_pylist() for level, i in missing(np.arange(r["low"], r["high"] + 1), r["size"], arity)]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["tree", "block", "level", "idx"])

    asked = blocks.mapInArrow(needs, "tree string, block long, level long, idx long").withColumn("copy", F.pmod("block", copies(F.col("level"), depth, arity)))
    laid = inner.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies(F.col("level"), depth, arity) - 1)))
    got = asked.join(laid, ["tree", "level", "idx", "copy"]).groupBy("tree", "block").agg(F.collect_list(F.struct("level", "idx", "hash")).alias("fetched"))
    ready = blocks.select("tree", "block").join(got, ["tree", "block"], "left").join(tops.select("tree", F.struct("hash", "root", "proof").alias("top")), "tree")
    row = nodes.schema["row"].dataType
    none = lambda kind: F.lit(None).cast(kind)
    heads = ready.select("tree", "block", none("long").alias("position"), none("long").alias("size"), none("string").alias("hash"), none(row).alias("row"), "fetched", "top")
    leaves = blocked.select("tree", "block", "position", "size", "hash", "row", none(heads.schema["fetched"].dataType).alias("fetched"), none(heads.schema["top"].dataType).alias("top"))

    def of(block: pa.Table) -> pa.Table:
        fetched = {(n["level"], n["idx"]): n["hash"] for n in block.column("fetched")[0].as_py() or []}
        top, rows = block.column("top")[0].as_py(), block.slice(1)
        at = rows.column("position").to_pylist()
        paths = proofs(dict(zip(at, rows.column("hash").to_pylist(), strict=True)), rows.column("size")[0].as_py(), fetched, arity)
        rest = [(s["left"], s["right"]) for s in top["proof"]]
        steps = [[{"left": a, "right": b} for a, b in paths[i] + rest] for i in at]
        same = lambda x: pa.array([x] * len(at), pa.string())
        proof = pa.array(steps, pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))
        return pa.table([rows.column("tree"), rows.column("row"), same(top["hash"]), same(top["root"]), proof], names=["tree", "row", "subroot", "root", "proof"])

    both = heads.unionByName(leaves)
    return mapped(both, of, f"tree string, row {row.simpleString()}, subroot string, root string, proof {PROOF}", "position")


def prove(leaves: DataFrame, group: Column, order: list[Column], leaf: Column, arity: int = 3) -> DataFrame:
    """Rows (row, leaf, subroot, root, proof): every row of `leaves`, whole in the struct `row`, with its proof.

    Each group has a tree over its leaves in the given order; while several nodes remain, every `arity` of them in a row
    become the SHA-256 of their digests (the last run may be shorter, even one). What remains is the group's subroot (a
    lone leaf itself), and the subroots, by group with null first and then bytewise, make the tree of the root likewise.
    proof has a (left, right) pair a level, from the leaf through the subroot to the root: the digests of the run's other
    nodes before and after it, put together. `fold` leads from leaf and proof to the root.

    Leaves that the order leaves tied go by their digest, so repeated rows have neighbouring leaves; a null in the order
    comes first or last as the order says. An empty table gives an empty result. Writes tables in the shared folder and
    runs jobs when it is built."""
    tree = F.coalesce(F.concat(F.lit("s"), group.cast("string")), F.lit("n"))
    named = leaves.select(tree.alias("tree"), leaf.alias("hash"), F.struct(*[F.col(f"`{c}`") for c in leaves.columns]).alias("row"), *[o.alias(f"order{i}") for i, o in enumerate(order)], F.monotonically_increasing_id().alias("nth"))
    stored = cut(named, "leaves")
    placed = cut(positions(stored, "tree", [*[F.col(f"order{i}") for i in range(len(order))], F.col("hash"), F.col("nth")]).select("tree", "position", "size", "hash", F.struct("row", F.col("hash").alias("leaf")).alias("row")), "placed")
    inner, tops = climb(placed, arity)
    crowns = cut(tops.select(F.lit("").alias("tree"), "hash", F.struct(F.col("tree").alias("of"), F.col("hash").alias("own")).alias("row")), "subroots")
    crowns = cut(positions(crowns, "tree", [F.col("row.of")]).select("tree", "position", "size", "hash", "row"), "subroots")
    upper, root = climb(crowns, arity)
    above = expand(crowns, upper, root.select("tree", "hash", F.col("hash").alias("root"), F.array().cast(PROOF).alias("proof")), arity)
    above = cut(above.select(F.col("row.of").alias("tree"), F.col("row.own").alias("hash"), "root", "proof"), "crowns")
    return expand(placed, inner, above, arity).select("row.row", "row.leaf", "subroot", "root", "proof")


def manifest(docs: DataFrame, fields: list[str], id_col: str = "doc_id", group_col: str = "source", changed: Column | None = None, arity: int = 3) -> DataFrame:
    """Rows (id, leaf, seen, subroot, root, proof) of a table whose leaf is the `digest` of its `fields`.

    `seen` is the leaf of the row as it is found later: the digest of the same fields with `changed` for the last one
    (that of the row itself by default). Rows of a group stand by id, null first, ties by leaf. Nulls in any field are
    leaves of their own kind; a null group is a group; repeated rows are leaves each; other columns are ignored."""
    plain = [F.col(f"`{c}`") for c in fields]
    later = digest(*plain[:-1], plain[-1] if changed is None else changed)
    leaves = docs.select(F.col(id_col).alias("id"), F.col(group_col).alias("group"), digest(*plain).alias("leaf"), later.alias("seen"))
    return prove(leaves, F.col("group"), [F.col("id")], F.col("leaf"), arity).select("row.id", "leaf", "row.seen", "subroot", "root", "proof")

"""Documents of like text: min-hash candidates in bands, exact shingle similarity inside candidate clusters.

The share of min-hashes that two texts have in common is expected to be their similarity, whatever their lengths. A
band of ROWS of them agrees with the power ROWS of that, bands are independent, and their number is taken from a bound
on the chance that a pair at the threshold agrees in none. No part of that chance depends on the number of documents.
Buckets only propose clusters; links are verified with the sets of shingles, and clusters are compared in bounded blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causaltape.llm.components import connected_components, contracted
from causaltape.llm.shared import MIX1, ROLL, bounded, cut, drop_table, hash_words, rolling

#: Bits of a sketch, min-hashes of a band, and the chance to miss a pair at the threshold by its bands or by its sketches.
BITS, ROWS, MISS = 128, 6, 1e-6
#: Members of a bucket compared with each other and shingles hashed at a time (in a bucket of more, all are joined to
#: the smallest: clusters may be too large but never lose a pair), members of a bucket that is compared together with
#: others, and shingles of a block of a cluster.
PIECE, SMALL, BLOCK_SHINGLES = 4096, 48, 1 << 15


def word_shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a text in lower case; one of fewer words is one shingle."""
    words = text.lower().encode("utf-8", "surrogatepass").split() if text else []
    return np.unique(rolling(hash_words(words), min(k, len(words)))) if words else np.zeros(0, np.uint64)


def bands(similarity: float) -> int:
    """The number of bands that miss a pair of this similarity with a chance of at most MISS."""
    return int(np.ceil(np.log(MISS) / np.log1p(-min(similarity**ROWS, 1 - MISS))))


def near_bits(similarity: float) -> int:
    """The number of differing bits that sketches of a pair of this similarity exceed with a chance of at most MISS."""
    p, chance = (1 - similarity) / 2, [1.0]
    for n in range(BITS):
        chance = [(chance[k] if k <= n else 0) * (1 - p) + (chance[k - 1] * p if k else 0) for k in range(n + 2)]
    return next(k for k in range(BITS + 1) if sum(chance[k + 1 :]) <= MISS)


def signature(shingles: np.ndarray, factors: np.ndarray) -> tuple[int, int, list[int]]:
    """A sketch of one bit of each of the first BITS min-hashes, as two signed integers, and the key of each band.
    `factors` are odd 32-bit numbers, ROWS a band: each orders the shingles' hashes by its product with them."""
    mixed = ((shingles ^ (shingles >> np.uint64(29))) * MIX1 >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(mixed), PIECE):
        np.minimum(least, np.multiply.outer(factors, mixed[at : at + PIECE]).min(axis=1), out=least)
    drawn = np.resize(least, BITS) * np.uint32(0x9E3779B1) >> np.uint32(31)
    a, b = np.packbits(drawn.astype(bool), bitorder="little").view("<i8").tolist()
    rows = least.reshape(-1, ROWS).astype(np.uint64)
    keys = np.arange(1, len(rows) + 1, dtype=np.uint64)
    for k in range(ROWS):
        keys = keys * ROLL + rows[:, k]
        keys ^= keys >> np.uint64(29)
        keys *= MIX1
    return a, b, (keys ^ keys >> np.uint64(32)).view(np.int64).tolist()


def factors_of(similarity: float) -> np.ndarray:
    """The odd factors of all min-hashes: those of the bands, and at least BITS."""
    count = max(bands(similarity), -(-BITS // ROWS)) * ROWS
    return np.random.default_rng(17).integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def bucket_links(reps: np.ndarray, prints: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Edges that join a bucket's members with sketches of at most `most` differing bits, at most one less than there are
    members."""
    n = len(reps)
    if n == 2:
        return [(int(reps[0]), int(reps[1]))] if np.bitwise_count(prints[0] ^ prints[1]).sum() <= most else []
    group, out = np.arange(n), []
    for x in range(n):
        near = np.flatnonzero(np.bitwise_count(prints ^ prints[x]).sum(axis=1, dtype=np.int64) <= most)
        for other in np.unique(group[near]).tolist():
            if other != group[x]:
                out.append((int(reps[x]), int(reps[near[group[near] == other][0]])))
                group[group == other] = group[x]
        if (group == group[0]).all():
            break
    return out


def small_bucket_links(reps: np.ndarray, prints: np.ndarray, begin: np.ndarray, size: np.ndarray, most: int) -> list[tuple[int, int]]:
    """`bucket_links` for many buckets of at most SMALL members: near pairs of all of them at once. A bucket with more
    near pairs than members goes back to the search that lists fewer."""
    if not len(begin):
        return []
    a, b, bucket = [], [], []
    for n in np.unique(size).tolist():
        i, j = np.triu_indices(n, 1)
        mine = np.flatnonzero(size == n)
        a.append((begin[mine][:, None] + i).ravel())
        b.append((begin[mine][:, None] + j).ravel())
        bucket.append(np.repeat(mine, len(i)))
    a, b, bucket = np.concatenate(a), np.concatenate(b), np.concatenate(bucket)
    near = np.bitwise_count(prints[a] ^ prints[b]).sum(axis=1, dtype=np.int64) <= most
    a, b, bucket = a[near], b[near], bucket[near]
    many = np.bincount(bucket, minlength=len(size)) > size
    few = ~many[bucket]
    out = list(zip(reps[a[few]].tolist(), reps[b[few]].tolist(), strict=True))
    for k in np.flatnonzero(many).tolist():
        s = slice(begin[k], begin[k] + size[k])
        out += bucket_links(reps[s], prints[s], most)
    return out


def propose(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Edges inside buckets, from rows (key, rep, f1, f2) in order of their key. No bucket has more than PIECE rows."""
    held: list[np.ndarray] = []

    def emit(rows: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(np.diff(rows[:, 0])) + 1
        edges, begin = [], np.concatenate(([0], edge))
        end = np.append(begin[1:], len(rows))
        size = end - begin
        for s, e in zip(begin[size > SMALL].tolist(), end[size > SMALL].tolist(), strict=True):
            edges += bucket_links(rows[s:e, 1], rows[s:e, 2:].view(np.uint64), most)
        small = (size > 1) & (size <= SMALL)
        edges += small_bucket_links(rows[:, 1], np.ascontiguousarray(rows[:, 2:]).view(np.uint64), begin[small], size[small], most)
        a, b = zip(*edges, strict=True) if edges else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        rows = np.stack([c.to_numpy() for c in batch.columns], axis=1)
        if not len(rows):
            continue
        rows = np.concatenate([*held, rows])
        last = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
        if last:
            yield emit(rows[:last])
        held = [rows[last:]]
    if held:
        yield emit(held[0])


def verified_links(reps: list[int], sets: list[np.ndarray], outside: np.ndarray | None, least: float) -> list[tuple[int, int]]:
    """Edges of verified pairs whose components are those of all pairs of at least the similarity `least`.

    A member is compared with all others through an index of shingles. Members of the largest component need no
    comparison of their own once the others have had theirs, as a link between components has an end outside it.
    With `outside` given, only those members are compared.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(ids, kind="stable")
    begin = np.searchsorted(ids[order], np.arange(ids.max() + 2 if len(ids) else 1))
    owners, offset = owner[order], np.concatenate(([0], np.cumsum(sizes)))
    group, done, out = np.arange(len(sets)), np.zeros(len(sets), bool), []
    todo = np.ones(len(sets), bool) if outside is None else outside
    while True:
        labels, count = np.unique(group, return_counts=True)
        waiting = np.flatnonzero(todo & ~done & ((group != labels[count.argmax()]) | (outside is not None) | (count.max() == 1)))
        if not len(waiting) or len(labels) == 1:
            return out
        for x in waiting[: 1 if count.max() == 1 else 32].tolist():
            mine = ids[offset[x] : offset[x + 1]]
            shared = np.bincount(np.concatenate([owners[begin[i] : begin[i + 1]] for i in mine.tolist()]), minlength=len(sets)) if len(mine) else np.zeros(len(sets), np.int64)
            near = np.flatnonzero(shared >= least * (sizes + sizes[x] - shared) - 1e-9)
            done[x] = True
            for other in np.unique(group[near]).tolist():
                if other != group[x]:
                    out.append((reps[x], reps[near[group[near] == other][0]]))
                    group[group == other] = group[x]


def compared(least: float, shingle: int, crossing: bool):
    """A block's verified edges, for applyInArrow over rows (rep, text, outside)."""

    def of(table: pa.Table) -> pa.Table:
        sets = [word_shingles(t, shingle) for t in table.column("text").to_pylist()]
        outside = table.column("outside").combine_chunks().to_numpy(zero_copy_only=False).astype(bool) if crossing else None
        edges = verified_links(table.column("rep").to_pylist(), sets, outside, least) if len(sets) > 1 else []
        a, b = zip(*edges, strict=True) if edges else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return of


def components(docs: DataFrame, shingle: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, component_id), one per distinct non-null id: the smallest id reachable by links between texts
    whose sets of word shingles have a Jaccard similarity of `least` or more.

    Words are runs of non-white-space in lower case; a text of fewer words than `shingle` is one shingle, so it links
    with equal texts alone; null and empty texts are equal. Equal word sequences are one point from the start. Rows
    with a null id link with nothing and are left out; of rows with one id the smallest text hash counts. An empty table gives an
    empty result; other columns are ignored.
    """

    factors, most = factors_of(least), near_bits(least)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                words = text.lower().encode("utf-8", "surrogatepass").split() if text else []
                high, low = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words)), "<i8").tolist()
                sets = np.unique(rolling(hash_words(words), shingle)) if len(words) >= shingle else np.zeros(0, np.uint64)
                rows.append((high, low, len(sets), *(signature(sets, factors) if len(sets) else (0, 0, []))))
            *columns, keys = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns], pa.array(keys, pa.list_(pa.int64()))], ["id", "high", "low", "shingles", "f1", "f2", "keys"])

    texts = bounded(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    known = cut(texts.mapInArrow(describe, "id long, high long, low long, shingles long, f1 long, f2 long, keys array<long>"), "described")
    one = known.groupBy("id").agg(F.min(F.struct("high", "low", "shingles", "f1", "f2", "keys")).alias("d")).select("id", "d.*")
    points = cut(one.groupBy("high", "low").agg(F.min("id").alias("rep"), *[F.first(c).alias(c) for c in ("shingles", "f1", "f2", "keys")]), "points")
    keyed = points.select(F.explode("keys").alias("key"), "rep", "f1", "f2")
    buckets = cut(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("hub")).where("n > 1"), "buckets")
    shared = keyed.join(buckets.where(F.col("n") <= PIECE), "key").select("key", "rep", "f1", "f2")
    proposed = shared.repartition("key").sortWithinPartitions("key").mapInArrow(lambda batches: contracted(propose(batches, most)), "u long, v long")
    large = buckets.where(F.col("n") > PIECE)
    if large.limit(1).count():
        proposed = proposed.unionByName(keyed.join(large, "key").where("rep != hub").select(F.col("hub").alias("u"), F.col("rep").alias("v")))
    clusters = connected_components(proposed, "u", "v", reduced=True)
    sized = cut(clusters.join(points, clusters.node == points.rep).select("rep", "component", "shingles"), "clusters")
    blocks = sized.groupBy("component").agg(F.ceil(F.sum("shingles") / BLOCK_SHINGLES).alias("blocks"))
    placed = cut(sized.join(blocks, "component").select("rep", "component", "shingles", "blocks", F.pmod(F.xxhash64("rep"), F.col("blocks")).alias("block")), "placed")
    hubs = placed.where("rep = component and blocks > 1").select("rep", "component", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    members = placed.where("not (rep = component and blocks > 1)").select("rep", "component", "block").unionByName(hubs)
    reps = texts.join(placed.select(F.col("rep").alias("id")), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    reps = cut(reps.withColumnRenamed("id", "rep"), "texts")
    links = cut(members.join(reps, "rep").withColumn("outside", F.lit(False)).groupBy("component", "block").applyInArrow(compared(least, shingle, False), "a long, b long"), "links")
    if placed.where("blocks > 1").limit(1).count():
        links = cut(links.unionByName(across_blocks(placed.where("blocks > 1"), links, reps, least, shingle)), "links")
    joined = connected_components(links)
    classes = cut(points.join(joined, points.rep == joined.node, "left").select("high", "low", F.coalesce("component", "rep").alias("component_id")), "classes")
    for done in (buckets, sized, placed, reps, links, points):
        drop_table(done)
    return one.join(classes, ["high", "low"]).select(F.col("id").alias("doc_id"), "component_id")


def across_blocks(placed: DataFrame, links: DataFrame, reps: DataFrame, least: float, shingle: int) -> DataFrame:
    """Verified edges between blocks of the clusters that have several: members outside a cluster's largest component
    are dealt into groups of a block's size, and each group meets each block; those inside it need not meet each other."""
    joined = connected_components(links)
    held = cut(placed.join(joined.withColumnRenamed("component", "found"), placed.rep == joined.node, "left").select("rep", "component", "shingles", "block", "blocks", F.coalesce("found", "rep").alias("found")), "held")
    largest = held.groupBy("component", "found").count().groupBy("component").agg(F.max_by("found", F.struct("count", "found")).alias("largest"))
    out = cut(held.join(largest, "component").where(F.col("found") != F.col("largest")).select("rep", "component", "shingles", "blocks"), "out")
    groups = cut(out.groupBy("component").agg(F.ceil(F.sum("shingles") / BLOCK_SHINGLES).alias("groups")), "groups")
    dealt = out.join(groups, "component").withColumn("guest", F.pmod(F.xxhash64(F.lit(1), "rep"), F.col("groups")))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    guests = dealt.select("rep", "component", every("blocks").alias("block"), "guest", F.lit(True).alias("outside"))
    hosts = held.join(groups, "component").select("rep", "component", "block", every("groups").alias("guest"), F.lit(False).alias("outside"))
    both = hosts.join(dealt.select("rep", "guest", F.lit(1).alias("own")), ["rep", "guest"], "left").where("own is null").drop("own").unionByName(guests)
    return both.join(reps, "rep").groupBy("component", "block", "guest").applyInArrow(compared(least, shingle, True), "a long, b long")


def keep_one(docs: DataFrame, shingle: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", also: DataFrame | None = None) -> DataFrame:
    """`docs` without the rows whose component has a smaller id. Rows with a null id stay, and so do all other columns,
    whatever their names; of rows with one id all stay or go together. `also` (doc_id, component_id) are classes of
    another operator; documents linked by either are of one component."""
    name = "gone"
    while name in docs.columns:
        name += "_"
    classes = components(docs, shingle, least, id_col, text_col)
    if also is None:
        gone = classes.where("doc_id != component_id").select("doc_id")
    else:
        links = classes.unionByName(also).where("doc_id != component_id").select(F.col("component_id").alias("a"), F.col("doc_id").alias("b"))
        gone = connected_components(cut(links, "links")).where("node != component").select("node")
    gone = cut(gone.toDF(name), "gone")
    return docs.join(gone, F.col(id_col).cast("long") == F.col(name), "left_anti")

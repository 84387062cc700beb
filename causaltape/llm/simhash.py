"""SimHash near-duplicates found with covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causaltape.llm.components import connected_components
from causaltape.llm.shared import bounded, cut, drop_table

BITS = 64
#: Shingles whose bits are counted at once; bounds memory for very long texts.
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Bit i is set if bit i is set in more than half of the XXH64 values of the text's word shingles.

    A-Z are lower-cased, words are runs of non-white-space; repeats of a shingle count each time; a text of fewer
    words is one shingle; a text without words (or null) gives 0.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    k, digest = min(shingle, len(words)), xxhash.xxh64_intdigest
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist()
    counts, n = np.zeros(BITS, np.int64), len(starts)
    ends = ends[k - 1 :].tolist()
    for at in range(0, n, CHUNK):
        h = np.array([digest(joined[s:e], seed) for s, e in zip(starts[at : at + CHUNK], ends[at : at + CHUNK], strict=True)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """Rows (id, fp): one signed 64-bit fingerprint per input row, in map tasks only."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return bounded(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(of, "id long, fp long")


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """2^(radius+1)-1 masks such that any `radius` bit positions are all left out by at least one mask.

    Each position gets a non-zero vector of radius+1 bits and mask v keeps the positions whose vector has an odd
    inner product with v. The vectors of any `radius` positions leave a non-zero v orthogonal to all of them, and
    that mask keeps none of those positions. Vectors are dealt out evenly along a fixed permutation of positions.
    """
    kinds = 2 ** (radius + 1) - 1
    order = np.random.default_rng(7).permutation(bits)
    vector = {int(p): 1 + i % kinds for i, p in enumerate(order)}
    return [sum(1 << p for p in range(bits) if (vector[p] & v).bit_count() % 2) for v in range(1, kinds + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def near_links(points: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b) whose components are those of "differs in at most `radius` bits", from distinct rows (fp).

    Every pair within the radius shares a bucket (table, masked fingerprint) of the covering masks, and only members of
    shared buckets go on. Inside a bucket pairs are never listed: each member names the points within radius/2 flips of
    the bits that the bucket's own mask leaves out. Two members that name one point are at most `radius` apart, and any
    two that close name a common one in the bucket they share, so linking each point's members to the smallest is exact.
    A point is named by a bounded number of distinct fingerprints however large a bucket is. The radius must be even.
    """
    if radius % 2 or not 0 <= radius <= 4:
        raise ValueError("radius must be 0, 2 or 4")
    masks = covering_masks(radius)
    flips = [[signed(sum(1 << b for b in c)) for k in range(radius // 2 + 1) for c in combinations([b for b in range(BITS) if not m >> b & 1], k)] for m in masks]
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(signed(m)).alias("mask")) for i, m in enumerate(masks)])
    dealt = points.select("fp", F.inline(tables)).select("fp", "t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    shared = cut(dealt.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").select("t", "key"), "buckets")
    free = F.element_at(F.array(*[F.array(*[F.lit(f) for f in some]) for some in flips]), F.col("t") + 1)
    named = dealt.join(shared, ["t", "key"], "left_semi").select("fp", F.explode(F.transform(free, lambda f: f.bitwiseXOR(F.col("fp")))).alias("point"))
    groups = named.groupBy("point").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    return groups.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a != b")


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one per input row.

    component_id is the smallest id reachable by links between fingerprints that differ in at most `radius` bits.
    Rows with equal fingerprints are one point from the start, so a huge group of copies costs one row per map task.
    Null or empty text has fingerprint 0 and is linked like any other. A row with a null id links with nothing and
    has a null component. Rows with equal ids are kept; each is linked through its own fingerprint alone. An empty
    table gives an empty result. Other columns are ignored.
    """
    fps = cut(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    points = cut(fps.where("id is not null").groupBy("fp").agg(F.min("id").alias("least")), "points")
    joined = connected_components(near_links(points.select("fp"), radius))
    rooted = cut(points.join(joined, points.fp == joined.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root")), "rooted")
    classes = cut(rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id"), "classes")
    for done in (points, rooted):
        drop_table(done)
    return fps.join(classes, "fp", "left").select(
        F.col("id").alias("doc_id"), hex_of(F.col("fp")).alias("fingerprint"), F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id")
    )

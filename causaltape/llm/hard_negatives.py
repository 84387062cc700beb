"""Hard negatives by exact integer scores: matrix products modulo small primes, put together by Chinese remaindering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causaltape.llm.shared import cut, drop_table

#: Rows and anchors of one block, and blocks of either side that one tile holds on average at most.
ROWS, ANCHORS, TILE = 4096, 1024, 32
#: Columns multiplied before the sums are reduced: 1,024 products of residues of at most 125 stay below 2^24, so every
#: float32 sum is exact. Primes are below 252, scores below 2^53.
COLUMNS, LARGEST, MOST = 1024, 251, 1 << 53
NONE = np.iinfo(np.int64).min


def primes(above: int) -> list[int]:
    """The largest small primes whose product is over `above`."""
    found, product, n = [], 1, LARGEST
    while product <= above:
        if all(n % d for d in range(2, int(n**0.5) + 1)):
            found.append(n)
            product *= n
        n -= 1
    return found


def scores(a: np.ndarray, b: np.ndarray, bound: int) -> np.ndarray:
    """Exact inner products of the integer rows of `a` and `b`, whose absolute values are at most `bound`."""
    moduli = primes(2 * bound)
    value, product = np.zeros((len(a), len(b)), np.int64), 1
    for p in moduli:
        x, y = (((m + p // 2) % p - p // 2).astype(np.float32) for m in (a, b))
        residue = np.zeros(value.shape, np.float32)
        for k in range(0, a.shape[1], COLUMNS):
            residue = np.fmod(residue + np.fmod(x[:, k : k + COLUMNS] @ y[:, k : k + COLUMNS].T, p), p)
        # mixed radix: the digit that makes the value so far right modulo p too
        digit = (residue.astype(np.int64) - value % p) * pow(product, -1, p) % p
        value += digit * product
        product *= p
    value[value > product // 2] -= product
    return value


def best(score: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest allowed scores of each row (all, if fewer), ties by smaller column."""
    masked = np.where(allowed, score, NONE)
    least = np.partition(masked, masked.shape[1] - k, axis=1)[:, -k] if masked.shape[1] > k else np.full(len(masked), NONE)
    row, column = np.nonzero(allowed & (masked >= least[:, None]))
    order = np.lexsort((column, -masked[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


BLOCK = "n long, dims long, ids binary, labels binary, nths binary, parts binary, kind string, wanted binary, norm double"


def blocks(vectors: DataFrame, most: int, wanted: int = 0) -> DataFrame:
    """The rows of each partition packed into blocks of at most `most`, sorted by id, with `wanted` numbers of each row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for k in range(0, batch.num_rows, most):
                held.append(batch.slice(k, most))
                if sum(h.num_rows for h in held) >= most:
                    yield pack(held)
                    held = []
        if held:
            yield pack(held)

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).sort_by([("vec_id", "ascending"), ("nth", "ascending")])
        vectors = [np.asarray(v, np.int64) for v in table.column("parts").to_pylist()]
        dims = max(map(len, vectors))
        parts = np.zeros((len(vectors), dims), np.int64)
        for at, v in zip(parts, vectors, strict=True):
            at[: len(v)] = v
        norm = float((parts.astype(np.float64) ** 2).sum(axis=1).max()) if dims else 0.0
        kind = np.result_type(np.min_scalar_type(int(parts.min(initial=0))), np.min_scalar_type(int(parts.max(initial=0))), np.int8)
        longs = [table.column(c).to_numpy().astype("<i8").tobytes() for c in ("vec_id", "label", "nth")]
        asked = np.array(table.column("wanted").to_pylist(), "<i8").tobytes() if wanted else b""
        row = [len(vectors), dims, *longs, parts.astype(kind).tobytes(), np.dtype(kind).str, asked, norm]
        kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4, pa.string(), pa.binary(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], [c.split()[0] for c in BLOCK.split(", ")])

    return vectors.mapInArrow(of, BLOCK)


class Block:
    def __init__(self, row: dict, wanted: int = 0):
        self.ids, self.labels, self.nths = (np.frombuffer(row[c], "<i8") for c in ("ids", "labels", "nths"))
        self.parts = np.frombuffer(row["parts"], row["kind"]).reshape(row["n"], row["dims"]).astype(np.int64)
        self.wanted = np.frombuffer(row["wanted"], "<i8").reshape(row["n"], wanted) if wanted else None

    def against(self, other: Block, bound: int) -> np.ndarray:
        dims = max(self.parts.shape[1], other.parts.shape[1])
        a, b = (np.pad(x.parts, ((0, 0), (0, dims - x.parts.shape[1]))) for x in (self, other))
        return scores(a, b, bound)


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become floor(scale * x), and a score is their integer inner product with the anchor's, exactly. Of each
    row for which `anchor` holds, the positives are the `positives` best other rows of its label; for each of them the
    `negatives` best rows of other labels are returned whose score is `low` to `high` per cent of the positive's. Higher
    scores come first, ties by smaller id; all are returned if there are fewer.

    Rows with a null id, label or vector, or with a null or non-finite component take no part. Vectors of unlike lengths
    are filled up with zeros. Repeated rows are rows of their own: a copy can be a positive of its copy. An empty table
    gives an empty result; other columns are ignored. Raises if the largest squared norm reaches 2^53, where scores and
    their hundredfold would leave the exact range.

    Rows and anchors are packed into blocks, dealt in tiles of blocks, and scored twice: for positives, then for the
    negatives in their windows. A task holds one tile's blocks and hands on a few rows an anchor. Work is anchors times
    rows, as the search is exact; writes tables in the shared folder and runs jobs when it is built."""
    spark = rows.sparkSession
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    parts = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale))
    used = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()).where(finite)
    vectors = cut(used.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), parts.alias("parts"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.monotonically_increasing_id().alias("nth")), "vectors")
    total, asking = vectors.agg(F.count("*"), F.count_if("anchor")).first()
    dealt = cut(blocks(vectors.select("vec_id", "label", "nth", "parts").coalesce(max(1, -(-total // ROWS))), ROWS), "blocks")
    norm = dealt.agg(F.max("norm")).first()[0] or 0.0
    if norm >= MOST:
        raise ValueError("the largest squared norm is 2^53 or more")
    bound = int(norm) + 1
    asked = vectors.where("anchor").select("vec_id", "label", "nth", "parts")
    few = max(1, -(-asking // ANCHORS))

    def nearest(a: Block, b: Block) -> Iterator[tuple[np.ndarray, ...]]:
        score = a.against(b, bound)
        row, column = best(score, (a.labels[:, None] == b.labels) & (a.nths[:, None] != b.nths), positives)
        yield a.nths[row], a.ids[row], np.zeros(len(row), np.int64), b.ids[column], score[row, column]

    found = tiles(cut(blocks(asked.coalesce(few), ANCHORS), "anchors"), dealt, nearest, positives)
    first = Window.partitionBy("nth").orderBy(F.col("score").desc(), "id")
    chosen = cut(found.withColumn("j", F.row_number().over(first)).where(F.col("j") <= positives).select("nth", F.col("anchor_id"), (F.col("j") - 1).cast("long").alias("j"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    gathered = chosen.groupBy("nth").agg(F.sort_array(F.collect_list("positive_score"), asc=False).alias("scores"))
    filled = F.concat("scores", F.array_repeat(F.lit(NONE), F.lit(positives) - F.size("scores")))
    wanting = cut(asked.join(gathered, "nth").select("vec_id", "label", "nth", "parts", filled.alias("wanted")), "wanting")

    def inside(a: Block, b: Block) -> Iterator[tuple[np.ndarray, ...]]:
        score = a.against(b, bound)
        other = a.labels[:, None] != b.labels
        for j in range(positives):
            want = a.wanted[:, j]
            want = np.where(want == NONE, 0, want)[:, None]
            allowed = other & (low * want <= 100 * score) & (100 * score <= high * want) & (a.wanted[:, j] != NONE)[:, None]
            row, column = best(score, allowed, negatives)
            yield a.nths[row], a.ids[row], np.full(len(row), j), b.ids[column], score[row, column]

    found = tiles(cut(blocks(wanting.coalesce(few), ANCHORS, positives), "anchors"), dealt, inside, negatives, positives)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("nth", "j").orderBy(F.col("score").desc(), "id"))).where(F.col("rank") <= negatives)
    drop_table(vectors)
    return chosen.join(ranked.drop("anchor_id"), ["nth", "j"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def tiles(asked: DataFrame, dealt: DataFrame, pair, keep: int, wanted: int = 0) -> DataFrame:
    """`pair` on each block of anchors with each block of rows, in tiles of blocks, with the `keep` best rows of each
    anchor and window (nth, j) in the tile: rows (nth, anchor_id, j, id, score)."""
    many, few = dealt.count(), asked.count()
    cores = dealt.sparkSession.sparkContext.defaultParallelism
    side = max(1, min(TILE, int((many * few / (4 * cores)) ** 0.5)))
    down, across = max(1, -(-few // side)), max(1, -(-many // side))
    tile = lambda row, column: (row * across + column).cast("long").alias("tile")
    lone = lambda n: F.pmod(F.xxhash64("__nth"), F.lit(n))
    number = lambda df: df.withColumn("__nth", F.monotonically_increasing_id())
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    n = min(down * across, 1 << 15)
    left = number(asked).withColumn("__own", lone(down)).withColumn("__all", every(across)).withColumn("tile", tile(F.col("__own"), F.col("__all"))).drop("__own", "__all").repartition(n, "tile")
    right = number(dealt).withColumn("__own", lone(across)).withColumn("__all", every(down)).withColumn("tile", tile(F.col("__all"), F.col("__own"))).drop("__own", "__all").repartition(n, "tile")

    def of(mine: pa.Table, others: pa.Table) -> pa.Table:
        rows = [Block(r) for r in others.to_pylist()]
        out = []
        for a in (Block(r, wanted) for r in mine.to_pylist()):
            got = [np.concatenate(c) for c in zip(*[x for b in rows for x in pair(a, b)], strict=True)] if rows else []
            if got and len(got[0]):
                order = np.lexsort((got[3], -got[4], got[2], got[0]))
                got = [c[order] for c in got]
                new = np.concatenate(([True], (got[0][1:] != got[0][:-1]) | (got[2][1:] != got[2][:-1])))
                starts = np.flatnonzero(new)[np.cumsum(new) - 1]
                out.append([c[np.arange(len(c)) - starts < keep] for c in got])
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5
        return pa.table([pa.array(c.astype(np.int64)) for c in columns], names=["nth", "anchor_id", "j", "id", "score"])

    return left.groupBy("tile").cogroup(right.groupBy("tile")).applyInArrow(of, "nth long, anchor_id long, j long, id long, score long")

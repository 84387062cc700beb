"""Removal of repeated passages: a count-min prefilter, then exact grouping of the windows it leaves.

Documents are dealt into chunks of a few megabytes. Each chunk sketches the hashes of its word windows into the rows
of a count-min sketch, held sparsely as sorted cell numbers and cut into FAN ranges. The sketches of all chunks are
merged range by range, and each chunk learns which of its cells count more than once. Estimates are never too low, so
the windows whose cell counts once in some row are unique and stop here. A second pass merges only the others, by their
128-bit keys, with the smallest document of each; each chunk learns which keys a smaller document holds elsewhere. A
third pass removes the words.

Both merges are one operation, `ask`: rows of sorted keys with a value go out, one bit a key comes back. With up to
MOST chunks a range is merged in one task. With more, blocks of FAN chunks are merged first and cut into FAN finer
ranges each, level by level, and the bits go back the same way. So a chunk and a block write FAN rows whatever the size
of the input, rows grow in proportion to it, and no task holds more than MOST rows of a range; a passage that a third
of all documents share is one cell and one key per chunk.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causaltape.llm.shared import ROLL, cut, rolling

#: Multipliers that give each sketch row its own cells.
ROWS = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
#: Text of a chunk, chunks at least, ranges that a range is cut into (a power of two), and rows of a range in a task.
CHUNK_BYTES, LEAST_CHUNKS, FAN, MOST = 4 << 20, 64, 32, 256
ROW = "chunk long, range long, n long, high binary, low binary, value binary"
BITS = "chunk long, range long, n long, bits binary"
OUT = "doc_id long, n_words long, n_removed long, kept string"


def pack(values: np.ndarray, rising: bool = False) -> bytes:
    """Compressed byte planes of values, of their differences if they rise."""
    d = np.diff(values, prepend=values.dtype.type(0)) if rising else values
    return pa.compress(d.view(np.uint8).reshape(-1, d.itemsize).T.tobytes(), codec="zstd", asbytes=True)


def unpack(packed: bytes, n: int, kind: str = "<u8", rising: bool = False) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(packed, n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n)
    d = np.ascontiguousarray(planes.T).view(kind).ravel()
    return np.cumsum(d, dtype=np.uint64) if rising else d


@dataclass(frozen=True)
class Merge:
    """What is merged: counts of sketch cells (one half of a key, in `bits` bits), or the smallest documents of keys."""

    counts: bool
    bits: int
    fan: int = 0
    most: int = 0

    @property
    def kind(self) -> str:
        return "u1" if self.counts else "<i8"

    def cut(self, chunk: int, base: int, level: int, high: np.ndarray, low: np.ndarray | None, value: np.ndarray) -> list[tuple]:
        """Rows of the ranges that sorted keys fall into: the next bits of the key after those that `base` stands for."""
        digits = self.fan.bit_length() - 1
        shift = np.uint64(max(0, self.bits - digits * (level + 1)))
        part = high >> shift & np.uint64(self.fan - 1)
        edge = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)])).tolist() if len(part) else [0]
        return [
            (chunk, base * self.fan + int(part[s]), e - s, pack(high[s:e], True), b"" if low is None else pack(low[s:e]), pack(value[s:e]))
            for s, e in zip(edge, edge[1:], strict=False)
        ]

    def merged(self, table: pa.Table) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]:
        """(rows' sizes, place of each of their keys, and the distinct keys with their values together)."""
        n = table.column("n").to_pylist()
        col = lambda name, *how: np.concatenate([unpack(b, k, *how) for b, k in zip(table.column(name).to_pylist(), n, strict=True)])
        high, value = col("high", "<u8", True), col("value", self.kind)
        low = None if self.counts else col("low")
        order = np.argsort(high, kind="stable") if low is None else np.lexsort((low, high))
        h, new = high[order], np.ones(len(high), bool)
        new[1:] = h[1:] != h[:-1]
        if low is not None:
            new[1:] |= low[order][1:] != low[order][:-1]
        first = np.flatnonzero(new)
        place = np.empty(len(h), np.int64)
        place[order] = np.cumsum(new) - 1
        if self.counts:
            together = np.minimum(np.add.reduceat(value[order].astype(np.int64), first), 2).astype(np.uint8)
        else:
            together = np.minimum.reduceat(value[order], first)
        return n, place, h[first], None if low is None else low[order][first], value, together

    def bits_of(self, table: pa.Table, n: list[int], bits: np.ndarray) -> pa.Table:
        ends = np.cumsum(n)[:-1]
        packed = [np.packbits(b).tobytes() for b in np.split(bits, ends)]
        return pa.table([table.column("chunk"), table.column("range"), table.column("n"), pa.array(packed, pa.binary())], names=["chunk", "range", "n", "bits"])

    def answer(self, table: pa.Table) -> pa.Table:
        """The bits of a whole range: cells that count more than once, or keys that a smaller document holds."""
        n, place, _, _, value, together = self.merged(table)
        return self.bits_of(table, n, (together > 1)[place] if self.counts else together[place] < value)

    def combine(self, level: int):
        def of(key: tuple, table: pa.Table) -> pa.Table:
            _, _, high, low, _, together = self.merged(table)
            return rows_of(self.cut(key[1].as_py(), key[0].as_py(), level, high, low, together), ROW)

        return of

    def hand_back(self, table: pa.Table, told: pa.Table) -> pa.Table:
        if not len(table):
            return rows_of([], BITS)
        n, place, _, _, value, together = self.merged(table)
        bits = joined(told)[place]
        return self.bits_of(table, n, bits if self.counts else bits | (together[place] < value))

    def ask(self, rows: DataFrame, chunks: int, level: int = 1) -> DataFrame:
        """Rows (chunk, range, n, bits) for rows of ROW: one bit for each key of each row."""
        if chunks <= self.most:
            return rows.groupBy("range").applyInArrow(lambda table: self.answer(table), BITS)
        rows = cut(rows.withColumn("block", F.floor(F.col("chunk") / self.fan)), "rows")
        blocks = rows.groupBy("range", "block")
        told = self.ask(blocks.applyInArrow(self.combine(level), ROW), -(-chunks // self.fan), level + 1)
        told = told.withColumnsRenamed({"chunk": "block", "range": "part"}).withColumn("range", F.floor(F.col("part") / self.fan)).withColumnRenamed("part", "order")
        return blocks.cogroup(told.groupBy("range", "block")).applyInArrow(lambda table, told: self.hand_back(table, told), BITS)


def joined(told: pa.Table) -> np.ndarray:
    """The bits of all rows in order of their range."""
    order = "order" if "order" in told.column_names else "range"
    got = sorted(zip(*(told.column(c).to_pylist() for c in (order, "n", "bits")), strict=True))
    return np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n) for _, n, b in got]).astype(bool) if got else np.zeros(0, bool)


class Windows:
    """The distinct rows of a chunk, their words, and the two 64-bit hashes of each window of `size` words inside one."""

    def __init__(self, docs: pa.Table, size: int):
        place: dict[tuple, int] = {}
        pairs = zip(docs.column("id").to_pylist(), docs.column("text").to_pylist(), strict=True)
        self.back = np.array([place.setdefault(p, len(place)) for p in pairs], np.int64)
        self.names = [d for d, _ in place]
        self.words: list[bytes] = []
        lengths = []
        for _, text in place:
            words = text.encode("utf-8", "surrogatepass").split() if text else []
            self.words += words
            lengths.append(len(words))
        self.lengths = np.array(lengths, np.int64)
        named = np.array([d is not None for d in self.names], bool)
        ids = np.array([d or 0 for d in self.names], np.int64)
        digest = xxhash.xxh3_128_digest
        hashes = np.frombuffer(b"".join(map(digest, self.words)), ">u8").reshape(-1, 2).astype(np.uint64)
        doc = np.repeat(np.arange(len(lengths)), self.lengths)
        n = max(0, len(doc) - size + 1)
        self.start = np.flatnonzero((doc[:n] == doc[size - 1 :][:n]) & named[doc[:n]]) if n else np.zeros(0, np.int64)
        self.high, self.low = (rolling(np.ascontiguousarray(hashes[:, c]), size)[self.start] for c in (0, 1))
        self.id = ids[doc[self.start]]

    def cells(self, row: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct cells of a sketch row, each window's place among them, and their counts."""
        mixed = (self.high ^ (self.low >> np.uint64(17))) * ROWS[row]
        mixed ^= mixed >> np.uint64(32)
        mixed *= ROLL
        return np.unique(mixed >> np.uint64(64 - bits), return_inverse=True, return_counts=True)

    def keep(self, told: pa.Table, bits: int, fan: int) -> None:
        """Only the windows whose cell counts more than once in every sketch row."""
        left = np.ones(len(self.start), bool)
        rows = np.array(told.column("range").to_pylist(), np.int64) // fan
        for row in range(len(ROWS)):
            mine = told.filter(pa.array(rows == row))
            left &= joined(mine)[self.cells(row, bits)[1]] if len(left) else left
        self.start, self.high, self.low, self.id = (x[left] for x in (self.start, self.high, self.low, self.id))

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct keys, as halves, the smallest document of each, and each window's place among them."""
        order = np.lexsort((self.id, self.low, self.high))
        high, low = self.high[order], self.low[order]
        new = np.ones(len(high), bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        first, place = np.flatnonzero(new), np.empty(len(high), np.int64)
        place[order] = np.cumsum(new) - 1
        return high[first], low[first], self.id[order][first], place


def repeated_passages(docs: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, fan: int = FAN, most: int = MOST) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept), one per input row; kept is what remains, joined by single spaces.

    Words are runs of anything but ASCII white space. A word goes if a window of `size` consecutive words covers it
    whose word sequence also starts in a row with a smaller id; windows are judged on the input. Null and empty text
    have no words and keep an empty string. Rows with a null id keep all their words and take none from others. Rows
    with equal ids take nothing from each other; equal rows are worked out once in each chunk they fall into. An empty
    table gives an empty result; other columns are ignored.
    """
    text = F.col(text_col).cast("string")
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    chunks = max(LEAST_CHUNKS, -(-total // chunk_bytes))
    bits = min(64, max(20, (total // 2).bit_length() + 3))
    sketches, exact = Merge(True, bits, fan, most), Merge(False, 64, fan, most)
    dealt = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    # equal rows are spread by the partition that they are read in
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("id", "text", F.spark_partition_id()), F.lit(chunks)))

    def sketch(key: tuple, table: pa.Table) -> pa.Table:
        windows, out = Windows(table, size), []
        for row in range(len(ROWS)):
            cells, _, counts = windows.cells(row, bits)
            out += sketches.cut(key[0].as_py(), row, 0, cells, None, np.minimum(counts, 2).astype(np.uint8))
        return rows_of(out, ROW)

    def candidates(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        if not len(table):
            return rows_of([], ROW)
        windows = Windows(table, size)
        windows.keep(told, bits, fan)
        high, low, least, _ = windows.keys()
        return rows_of(exact.cut(key[0].as_py(), 0, 0, high, low, least), ROW)

    def remove(table: pa.Table, told: pa.Table) -> pa.Table:
        if not len(table):
            return rows_of([], OUT)
        windows = Windows(table, size)
        edge = np.zeros(len(windows.words) + 1, np.int64)
        in_sketch = told.column("in_sketch").combine_chunks()
        windows.keep(told.filter(in_sketch), bits, fan)
        if len(windows.start):
            _, _, least, place = windows.keys()
            hit = joined(told.filter(pa.compute.invert(in_sketch)))[place] | (least[place] < windows.id)
            np.add.at(edge, windows.start[hit], 1)
            np.add.at(edge, windows.start[hit] + size, -1)
        gone = np.cumsum(edge[:-1]) > 0
        ends = np.cumsum(windows.lengths)
        lost = np.concatenate(([0], np.cumsum(gone)))
        removed = lost[ends] - lost[ends - windows.lengths]
        kept = []
        for n, e, r in zip(windows.lengths.tolist(), ends.tolist(), removed.tolist(), strict=True):
            words = windows.words[e - n : e]
            kept.append(b" ".join(words if not r else [w for w, g in zip(words, gone[e - n : e].tolist(), strict=True) if not g]))
        out = [pa.array(windows.names, pa.int64()), pa.array(windows.lengths), pa.array(removed), pa.array(kept, pa.binary()).cast(pa.string())]
        return pa.table(out, names=["doc_id", "n_words", "n_removed", "kept"]).take(pa.array(windows.back))

    grouped = dealt.groupBy("chunk")
    counted = sketches.ask(grouped.applyInArrow(sketch, ROW), chunks)
    found = grouped.cogroup(counted.groupBy("chunk")).applyInArrow(candidates, ROW)
    both = counted.withColumn("in_sketch", F.lit(True)).unionByName(exact.ask(found, chunks).withColumn("in_sketch", F.lit(False)))
    return grouped.cogroup(both.groupBy("chunk")).applyInArrow(remove, OUT)


def rows_of(rows: list[tuple], ddl: str) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split(" ") for f in ddl.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])

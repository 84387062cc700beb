"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from causaltape.llm.shared import bounded

CODED = StructType([StructField("doc_id", LongType()), StructField("ids", BinaryType()), StructField("n_tokens", LongType())])
#: Fixed value: the public split pattern of byte-level BPE vocabularies of this family.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
#: Pieces kept by a Python worker; when full it starts anew. Longer pieces are not kept.
CACHE, CACHED_BYTES = 250_000, 64
#: Characters of text whose pieces are encoded together.
TOGETHER = 1_500_000
#: Pieces that one set of trees holds.
TREES = 1 << 14


def byte_chars() -> list[str]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else the next character from U+0100."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in kept else next(spare)) for b in range(256)]


class Vocabulary:
    """A tokenizer file's ids, merge ranks and special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        ids, chars = content["model"]["vocab"], byte_chars()
        of_char = {c: b for b, c in enumerate(chars)}
        self.of_byte = [ids[c] for c in chars]
        merges = [m if isinstance(m, list) else m.split(" ") for m in content["model"]["merges"]]
        self.rank = {(ids[a], ids[b]): r for r, (a, b) in enumerate(merges)}
        self.merged = [ids[a + b] for a, b in merges]
        special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.bytes_of = {i: bytes(of_char[c] for c in t) for t, i in ids.items() if t not in special}
        self.bytes_of |= {i: t.encode() for t, i in special.items()}
        self.special = {t: np.array([i], "<u4").tobytes() for t, i in special.items()}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.split = regex.compile(SPLIT)
        self.cache: dict[str, bytes] = dict(self.special)
        order = sorted(self.rank)
        self.pair_keys = np.array([a << 32 | b for a, b in order], np.int64)
        self.pair_ranks = np.array([self.rank[p] for p in order], np.int64)
        self.merged_ids, self.byte_ids = np.array(self.merged, np.int64), np.array(self.of_byte, np.int64)
        self.table = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]

    def merge(self, symbols: list[int]) -> list[int]:
        """Merges the leftmost lowest-ranked pair until none is left.

        Leaf i of a segment tree holds rank * n + i of the pair that begins at symbol i; the root is then the leftmost
        pair of lowest rank. A merge changes three leaves, each in logarithmic time.
        """
        n = len(symbols)
        if n < 2:
            return symbols
        rank, size = self.rank, 1 << (n - 1).bit_length()
        none = len(self.merged) * n + n
        tree = [none] * (2 * size)
        for i in range(n - 1):
            r = rank.get((symbols[i], symbols[i + 1]))
            if r is not None:
                tree[size + i] = r * n + i
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        if tree[1] == none:
            return symbols
        symbols, following, before = [*symbols], [*range(1, n + 1)], [*range(-1, n - 1)]

        def put(i: int, value: int) -> None:
            k = size + i
            tree[k] = value
            k >>= 1
            while k:
                best = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == best:
                    return
                tree[k] = best
                k >>= 1

        def pair(i: int) -> int:
            j = following[i]
            r = rank.get((symbols[i], symbols[j])) if j < n else None
            return none if r is None else r * n + i

        while tree[1] != none:
            r, i = divmod(tree[1], n)
            gone = following[i]
            symbols[i] = self.merged[r]
            symbols[gone] = -1
            following[i] = following[gone]
            if following[gone] < n:
                before[following[gone]] = i
            put(gone, none)
            put(i, pair(i))
            if before[i] >= 0:
                put(before[i], pair(before[i]))
        return [s for s in symbols if s >= 0]

    def ranks(self, a: np.ndarray, b: np.ndarray, none: int) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], none)

    def merge_many(self, pieces: list[bytes], width: int) -> list[bytes]:
        """`merge` for many pieces of at most `width` bytes (a power of two): one tree a row, all rows step together."""
        m, far = len(pieces), len(self.merged) + 1
        none = far * width
        size = np.fromiter(map(len, pieces), np.int64, m)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(m, width)
        inside = np.arange(width) < size[:, None]
        symbols = np.full((m, width + 1), -1, np.int64)
        symbols[:, :width] = np.where(inside, self.byte_ids[raw], -1)
        following = np.minimum(np.arange(1, width + 2), size[:, None])
        following[following == size[:, None]] = width
        before = np.broadcast_to(np.arange(-1, width), (m, width + 1)).copy()
        tree = np.full((m, 2 * width), none, np.int64)
        first = self.ranks(symbols[:, :width], symbols[:, 1:], far)
        first[symbols[:, 1:] < 0] = far
        tree[:, width:] = np.where(first < far, first * width + np.arange(width), none)
        for k in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
        rows = np.flatnonzero(tree[:, 1] < none)
        while len(rows):
            r, i = np.divmod(tree[rows, 1], width)
            gone = following[rows, i]
            after, left = following[rows, gone], before[rows, i]
            symbols[rows, i], symbols[rows, gone] = self.merged_ids[r], -1
            following[rows, i], before[rows, after] = after, i
            mine, right = symbols[rows, i], symbols[rows, after]
            new = self.ranks(mine, right, far)
            tree[rows, width + gone] = none
            tree[rows, width + i] = np.where((right >= 0) & (new < far), new * width + i, none)
            has = left >= 0
            at, x = rows[has], left[has]
            old = self.ranks(symbols[at, x], mine[has], far)
            tree[at, width + x] = np.where(old < far, old * width + x, none)
            ups = [(rows, width + gone), (rows, width + i), (at, width + x)]
            for _ in range(width.bit_length() - 1):
                ups = [(q, k >> 1) for q, k in ups]
                for q, k in ups:
                    tree[q, k] = np.minimum(tree[q, 2 * k], tree[q, 2 * k + 1])
            rows = rows[tree[rows, 1] < none]
        kept = symbols >= 0
        flat, ends = symbols[kept].astype("<u4").tobytes(), (4 * np.cumsum(kept.sum(axis=1))).tolist()
        return [flat[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)]

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Encodes pieces by classes of length; keeps the short ones and returns the long ones."""
        classes: dict[int, list[tuple[str, bytes]]] = {}
        long: dict[str, bytes] = {}
        for piece in pieces:
            raw = piece.encode("utf-8", "replace")
            if len(raw) > CACHED_BYTES:
                long[piece] = np.array(self.merge([self.of_byte[b] for b in raw]), "<u4").tobytes()
            else:
                classes.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append((piece, raw))
        for width, members in classes.items():
            for at in range(0, len(members), TREES):
                some = members[at : at + TREES]
                self.cache.update(zip([p for p, _ in some], self.merge_many([r for _, r in some], width), strict=True))
        return long

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers; special tokens inside the texts are recognised first."""
        if len(self.cache) > CACHE:
            self.cache = dict(self.special)
        find, special = self.split.findall, self.special
        split = []
        for text in texts:
            pieces: list[str] = []
            for part in self.split_special.split(text) if self.split_special else [text]:
                pieces += [part] if part in special else find(part)
            split.append(pieces)
        cache = self.cache
        long = self.learn({p for pieces in split for p in pieces if p not in cache})
        if long:
            return [b"".join([cache.get(p) or long[p] for p in pieces]) for pieces in split]
        return [b"".join([cache[p] for p in pieces]) for pieces in split]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out, at = [], 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (chars < TOGETHER or end == at):
                chars += len(texts[end] or "")
                end += 1
            out += self.encode_many([t or "" for t in texts[at:end]])
            at = end
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=2)
def byte_table(path: str) -> list[bytes]:
    """The bytes of each id: all that decoding needs to keep in memory."""
    return Vocabulary(path).table


def text_of(packed: bytes, table: list[bytes]) -> str:
    return b"".join([table[i] for i in np.frombuffer(packed, "<u4").tolist()]).decode("utf-8", "replace")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), decoded: bool = False) -> DataFrame:
    """Rows (doc_id, ids, n_tokens) and the columns `keep`, one per input row, in map tasks only; ids is binary,
    little-endian unsigned 32 bit. With `decoded` the text that the ids stand for follows, as `decode` gives it, from
    the same workers, which then hold one vocabulary and not two.

    Null text counts as empty and gives no ids. Ids may be null or repeat; an empty table gives an empty result;
    other columns are ignored. A piece without white space of any length costs n log n. `path` must be readable on
    every executor.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in batches:
            packed = known.encode(batch.column(1).to_pylist())
            columns = [batch.column(0), pa.array(packed, pa.binary()), pa.array([len(p) // 4 for p in packed], pa.int64()), *batch.columns[2:]]
            if decoded:
                columns.append(pa.array([text_of(p, known.table) for p in packed], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    rows = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("__text"), *keep)
    schema = StructType([*CODED.fields, *rows.schema.fields[2:], *([StructField("decoded", StringType())] if decoded else [])])
    return rows.mapInArrow(of, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """`encode`'s rows with a further column `decoded`, the text that the ids stand for; null ids give null."""
    at = encoded.columns.index("ids")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(path)
        for batch in batches:
            texts = [None if (b := x.as_py()) is None else text_of(b, table) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return bounded(encoded).mapInArrow(of, StructType([*encoded.schema.fields, StructField("decoded", StringType())]))


def id_list(encoded: DataFrame) -> DataFrame:
    """Rows (doc_id, token_ids): the ids as an array, for consumers that want integers."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [None if (b := x.as_py()) is None else np.frombuffer(b, "<u4").astype(np.int32) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int32()))], ["doc_id", "token_ids"])

    return encoded.select("doc_id", "ids").mapInArrow(of, "doc_id long, token_ids array<int>")

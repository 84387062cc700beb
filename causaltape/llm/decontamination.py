"""Benchmark passages in documents: SimHash of item-sized windows, multi-index Hamming search, exact verification."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causaltape.llm.shared import bounded, rolling

WORD = regex.compile(r"[\p{L}\p{N}]+")
#: Fingerprint bits, blocks of the multi-index, and the radius. At similarity 0.8 two fingerprints differ in 19.3 of
#: 128 bits on average with a deviation of 4.1, so the radius is four deviations above; unrelated ones differ in 64.
BITS, BLOCKS, RADIUS = 128, 8, 36
#: Items that one pass over the documents holds, and window starts fingerprinted together.
ITEMS, STARTS = 2000, 8192


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def hashes_of(words: list[str]) -> np.ndarray:
    """Two 64-bit hashes of each word."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(w) for w in words]), ">u8").reshape(-1, 2).astype(np.uint64)


def bits_of(hashes: np.ndarray, q: int) -> np.ndarray:
    """(shingles, BITS) zeros and ones of the two rolling hashes of each q words."""
    both = np.stack([rolling(np.ascontiguousarray(hashes[:, c]), q) for c in (0, 1)], axis=1)
    return np.unpackbits(both.astype("<u8").view(np.uint8).reshape(-1, BITS // 8), axis=1, bitorder="little")


def fingerprints(bits: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Majority bits of k shingles from each start, as bytes."""
    sums = np.zeros((len(bits) + 1, BITS), np.int32)
    np.cumsum(bits, axis=0, dtype=np.int32, out=sums[1:])
    return np.packbits(2 * (sums[starts + k] - sums[starts]) > k, axis=1, bitorder="little")


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard: the sum of the smaller counts over the sum of the larger."""
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared)


def shingles(words: list[str], q: int) -> Counter:
    return Counter(zip(*(words[j:] for j in range(q)), strict=False))


class MultiIndex:
    """Fingerprints within RADIUS bits: two such agree in some block up to RADIUS // BLOCKS bits, so each item is
    listed in every block under all values that near, and a lookup per block finds every item within the radius."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        width = BITS // BLOCKS
        flips = np.array([sum(1 << b for b in c) for k in range(RADIUS // BLOCKS + 1) for c in combinations(range(width), k)], np.uint16)
        self.tables = []
        for values in prints.view("<u2").reshape(len(prints), BLOCKS).T:
            near = (values[:, None] ^ flips).ravel()
            order = np.argsort(near, kind="stable")
            begin = np.concatenate(([0], np.cumsum(np.bincount(near, minlength=2**width))))
            self.tables.append((begin.astype(np.int32), (order // len(flips)).astype(np.int16 if len(prints) < 1 << 15 else np.int32)))

    def search(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, item) of every pair within the radius."""
        pairs = []
        for (begin, items), values in zip(self.tables, prints.view("<u2").reshape(len(prints), BLOCKS).T.astype(np.int64), strict=True):
            n = begin[values + 1] - begin[values]
            row = np.repeat(np.arange(len(values)), n)
            inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            pairs.append(row * len(self.prints) + items[np.repeat(begin[values], n) + inside])
        row, item = np.divmod(np.unique(np.concatenate(pairs)), len(self.prints))
        far = np.bitwise_count(prints[row] ^ self.prints[item]).sum(axis=1, dtype=np.int64)
        return row[far <= RADIUS], item[far <= RADIUS]


class Benchmark:
    """The items of one pass, with one index of their fingerprints."""

    def __init__(self, items: list[tuple[int, str]], shingle: int, least: float):
        self.least, self.shingle = least, shingle
        self.items, prints, owners = [], [], {}
        for item, text in items:
            if words := words_of(text):
                n, q, hashes = len(words), min(shingle, len(words)), hashes_of(words)
                self.items.append((item, n, shingles(words, q)))
                prints.append(fingerprints(bits_of(hashes, q), np.array([0]), n - q + 1)[0])
                for h in np.unique(rolling(np.ascontiguousarray(hashes[:, 0]), q)).tolist():
                    owners.setdefault(q, {}).setdefault(h, set()).add(n)
        self.index = MultiIndex(np.array(prints, np.uint8).reshape(-1, BITS // 8))
        #: For each shingle length the items' shingles, sorted, and the item sizes that each stands in.
        self.known = {q: (np.array(sorted(of), np.uint64), [sorted(of[h]) for h in sorted(of)]) for q, of in owners.items()}

    def matches(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first word, words) of the best window of each item that reaches the least similarity.

        A window that holds none of an item's shingles has similarity 0 with it, so windows are fingerprinted only
        where they hold a shingle of some item of their size. A text shorter than an item is one window."""
        words = words_of(text)
        best: dict[int, tuple[float, int, int]] = {}
        hashes = hashes_of(words) if words else None
        for q, (known, sizes) in self.known.items():
            if len(words) < q:
                continue
            rolled = rolling(np.ascontiguousarray(hashes[:, 0]), q)
            at = np.minimum(np.searchsorted(known, rolled), len(known) - 1)
            hits = np.flatnonzero(known[at] == rolled)
            places: dict[int, list[int]] = {}
            for p, a in zip(hits.tolist(), at[hits].tolist(), strict=True):
                for n in sizes[a]:
                    places.setdefault(n, []).append(p)
            for n, found in places.items():
                self.search(words, hashes, q, n, np.array(found), best)
        return [(item, *found) for item, found in sorted(best.items())]

    def search(self, words: list[str], hashes: np.ndarray, q: int, n: int, found: np.ndarray, best: dict) -> None:
        take = min(n, len(words))
        k = take - q + 1
        edge = np.zeros(len(words) + 2, np.int64)
        np.add.at(edge, np.maximum(0, found - k + 1), 1)
        np.add.at(edge, np.minimum(found, len(words) - take) + 1, -1)
        starts = np.flatnonzero(np.cumsum(edge)[: len(words) - take + 1] > 0)
        low = 0
        while low < len(starts):
            high = int(np.searchsorted(starts, starts[low] + STARTS))
            some = starts[low:high]
            prints = fingerprints(bits_of(hashes[some[0] : some[-1] + take], q), some - some[0], k)
            for row, member in zip(*(x.tolist() for x in self.index.search(prints)), strict=True):
                item, size, wanted = self.items[member]
                if size != n:
                    continue
                start = int(some[row])
                got = similarity(shingles(words[start : start + take], q), wanted)
                if got >= self.least and got > best.get(item, (0.0,))[0]:
                    best[item] = (got, start, take)
            low = high


def contaminated(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Rows (doc_id, item_id, similarity, first_word, n_words): per document row and item its best window, if the
    window's weighted Jaccard similarity of word shingles with the item is `least` or more.

    Words are lower-cased runs of letters and digits; shingles have `shingle` words, or all words of a shorter item;
    a window has as many words as the item, or is the whole text if that is shorter. Of equal windows the first
    counts. The item set is held in blocks of at most about ITEMS rows, each of which makes one pass over all
    documents in map tasks. Null or empty texts and items match nothing, nor do items with a null id. Rows with null
    or repeated document ids are searched like any other; an item id that repeats keeps its best match. Empty tables
    give an empty result; other columns are ignored.
    """
    text = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = None
    for items in item_blocks(benchmark, item_col, item_text_col):

        def of(batches: Iterator[pa.RecordBatch], items: list = items) -> Iterator[pa.RecordBatch]:
            held = Benchmark(items, shingle, least)
            for batch in batches:
                rows = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for m in held.matches(t)]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "similarity", "first_word", "n_words"])

        got = text.mapInArrow(of, "doc_id long, item_id long, similarity double, first_word long, n_words long")
        found = got if found is None else found.unionByName(got)
    return found


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ITEMS rows at most, all texts of an item id in one, so that its best match is found in
    one pass; a single empty block if there are none."""
    wanted = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("item_text")).where("item is not null and item_text is not null").distinct()
    blocks = max(1, -(-wanted.count() // ITEMS))
    for block in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).sort("item", "item_text").collect()
        yield [(r["item"], r["item_text"]) for r in rows]


def keep_clean(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, least: float = 0.8, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """`docs` without the rows in which `contaminated` would find an item. In map tasks only, one per item block."""
    at = docs.columns.index(text_col)
    for items in item_blocks(benchmark, item_col, item_text_col):

        def of(batches: Iterator[pa.RecordBatch], items: list = items) -> Iterator[pa.RecordBatch]:
            held = Benchmark(items, shingle, least)
            for batch in batches:
                yield batch.filter(pa.array([not held.matches(t) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = bounded(docs).mapInArrow(of, docs.schema)
    return docs

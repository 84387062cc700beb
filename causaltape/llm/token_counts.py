"""Exact token counts at every prefix of a text, by dynamic programming over a piece vocabulary."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causaltape.llm.shared import bounded

SPACE = "▁"
#: Segments and checked pairs a Python worker keeps; when full it starts anew.
SEGMENTS, PAIRS, KEPT_CHARS = 700_000, 1_000_000, 32
#: Characters of text whose segments are counted together.
TOGETHER = 4_000_000


class PrefixCounter:
    """Counts the pieces of every prefix of a text under score-ordered pair merging with byte fallback.

    The encoding of a prefix of length i ends in the one piece that ends at i and that is stable after the last piece
    of the shorter prefix before it, where two pieces are stable if merging their joined text gives just them back.
    So last[i] and count[i] = count[i - length] + 1 follow from earlier positions alone.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in plain}
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("pieces that go on after a space are not supported")
        if not {c for p in self.score for c in p} <= self.score.keys():
            raise ValueError("pieces with characters that are no pieces are not supported")
        self.endings = {p[k:] for p in self.score for k in range(len(p))}
        self.segments: dict[str, bytes | list[int]] = {}
        self.names = list(self.score)
        self.number = {p: k for k, p in enumerate(self.names)}
        self.whole = np.array([self.merged(p) == [p] for p in self.names])
        states = {"": 0} | {e: k for k, e in enumerate(sorted(self.endings), 1)}
        steps = sorted((states[e[1:]] << 21 | ord(e[0]), states[e]) for e in self.endings)
        self.step_keys, self.step_to = (np.array(x, np.int64) for x in zip(*steps, strict=True))
        self.piece_at = np.full(len(states), -1, np.int64)
        for p, k in self.number.items():
            self.piece_at[states[p]] = k
        self.slot_keys, self.slot_stable = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.runs = regex.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")

    def merged(self, text: str) -> list[str]:
        """Plain pair merging of a short text, best score and then leftmost first."""
        parts, score = [*text], self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stable(self, a: str, b: str) -> bool:
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            found = self.pairs[a, b] = self.merged(a + b) == [a, b]
        return found

    def prefixes(self, segment: str) -> list[int]:
        """count[i] for each prefix of one segment, count[0] = 0."""
        n = len(segment)
        last, count = [""] * (n + 1), [0] * (n + 1)
        endings, score, stable = self.endings, self.score, self.stable
        for i in range(1, n + 1):
            for j in range(i - 1, -1, -1):
                piece = segment[j:i]
                if piece in endings:
                    if piece in score and (stable(last[j], piece) if j else self.merged(piece) == [piece]):
                        last[i], count[i] = piece, count[j] + 1
                        break
                elif j < i - 1:
                    break
            if not last[i]:  # a character outside the vocabulary: one piece per byte, never merged
                last[i], count[i] = segment[i - 1], count[i - 1] + len(segment[i - 1].encode("utf-8", "replace"))
        return count

    def stable_many(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """`stable` for arrays of piece numbers, -1 for a character outside the vocabulary; answers stay in a table
        of fixed size, where a later pair may take an earlier one's place."""
        key = a * len(self.names) + b
        slot = (key * 0x9E3779B1) & (len(self.slot_keys) - 1)
        unknown = (self.slot_keys[slot] != key) & (a >= 0)
        out = self.slot_stable[slot] | (a < 0)
        if unknown.any():
            keys, back = np.unique(key[unknown], return_inverse=True)
            names = self.names
            got = np.array([self.stable(names[k // len(names)], names[k % len(names)]) for k in keys.tolist()])
            at = (keys * 0x9E3779B1) & (len(self.slot_keys) - 1)
            self.slot_keys[at], self.slot_stable[at] = keys, got
            kept = self.slot_keys[at] == keys
            self.slot_keys[at[~kept]] = -1
            out[unknown] = got[back]
        return out

    def prefixes_many(self, segments: list[str], width: int) -> np.ndarray:
        """`prefixes` for many segments of at most `width` characters: row k has count[0..width] of segment k."""
        m = len(segments)
        chars = np.array(segments, f"<U{width}").view(np.uint32).reshape(m, width).astype(np.int64)
        length = np.fromiter(map(len, segments), np.int64, m)
        last, count = np.full((m, width + 1), -1, np.int64), np.zeros((m, width + 1), np.int64)
        for i in range(1, width + 1):
            rows = np.flatnonzero(length >= i)
            state, open_rows = np.zeros(len(rows), np.int64), rows
            done = np.zeros(m, bool)
            for j in range(i - 1, -1, -1):
                key = state << 21 | chars[open_rows, j]
                at = np.minimum(np.searchsorted(self.step_keys, key), len(self.step_keys) - 1)
                on = self.step_keys[at] == key
                open_rows, state = open_rows[on], self.step_to[at[on]]
                if not len(open_rows):
                    break
                piece = self.piece_at[state]
                ok = piece >= 0
                ok[ok] = self.stable_many(last[open_rows[ok], j], piece[ok]) if j else self.whole[piece[ok]]
                hit = open_rows[ok]
                last[hit, i], count[hit, i], done[hit] = piece[ok], count[hit, j] + 1, True
                open_rows, state = open_rows[~ok], state[~ok]
            alone = rows[~done[rows]]
            if len(alone):
                code = chars[alone, i - 1]
                count[alone, i] = count[alone, i - 1] + 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        return count

    def learn(self, segments: set[str]) -> dict[str, list[int]]:
        """Counts segments by classes of length; keeps the short ones and returns the long ones."""
        classes: dict[int, list[str]] = {}
        long: dict[str, list[int]] = {}
        for s in segments:
            if len(s) > KEPT_CHARS:
                long[s] = self.prefixes(s)
            else:
                classes.setdefault(-(-len(s) // 4) * 4, []).append(s)
        for width, members in classes.items():
            table = self.prefixes_many(members, width).astype(np.uint8)  # at most four bytes a character
            raw = table.tobytes()
            self.segments.update((s, raw[k * (width + 1) : k * (width + 1) + len(s) + 1]) for k, s in enumerate(members))
        return long

    def split(self, text: str) -> list[str]:
        """Segments no piece reaches across: they begin where a space follows another character, and at newlines."""
        whole = SPACE + text.replace(" ", SPACE)
        if SPACE * 2 in whole or "\0" in whole:
            return self.runs.findall(whole)
        return [s for s in whole.replace("\n", "\0\n\0").replace(SPACE, "\0" + SPACE).split("\0") if s]

    def counts_many(self, texts: list[str]) -> list[list]:
        """The prefix counts of each segment of each text, in order; those of a short segment as bytes."""
        if len(self.segments) > SEGMENTS:
            self.segments.clear()
        split = [self.split(t) if t else [] for t in texts]
        known = self.segments
        long = self.learn({s for segments in split for s in segments if s not in known})
        if long:
            return [[known.get(s) or long[s] for s in segments] for segments in split]
        return [[known[s] for s in segments] for segments in split]

    def counts(self, texts: list[str | None]) -> Iterator[list]:
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (chars < TOGETHER or end == at):
                chars += len(texts[end] or "")
                end += 1
            yield from self.counts_many([t or "" for t in texts[at:end]])
            at = end


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def fitting_prefix(parts: list, budget: int) -> int:
    """The most characters of a text that take at most `budget` tokens.

    Each segment takes a token at least, so the answer lies in the last segment before which the budget isn't spent;
    the space put before the text is not a character of it.
    """
    spent = chars = 0
    for part in parts:
        if spent + part[-1] > budget:
            inside = max(i for i, c in enumerate(part) if spent + c <= budget)
            return max(0, chars + inside - 1)
        spent, chars = spent + part[-1], chars + len(part) - 1
    return max(0, chars - 1)


def token_counts(docs: DataFrame, path: str, budget: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit, fitting_chars), one per input row, in map tasks only.

    fitting_chars is the length of the longest prefix of at most `budget` tokens, answered from the stored counts.
    Null text counts as empty and has no tokens. Ids may be null or repeat; an empty table gives an empty result;
    other columns are ignored. Texts of any length take time in proportion. `path` must be readable on every executor.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counter(path)
        for batch in batches:
            n, fits = [], []
            texts = batch.column(1).to_pylist()
            for text, parts in zip(texts, known.counts(texts), strict=True):
                n.append(sum([p[-1] for p in parts]))
                fits.append(fitting_prefix(parts, budget) if n[-1] > budget else len(text or ""))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(fits, pa.int64()), batch.column(2)], ["doc_id", "n_tokens", "fitting_chars", "n_bytes"])

    text = F.col(text_col).cast("string")
    counted = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return counted.mapInArrow(of, "doc_id long, n_tokens long, fitting_chars long, n_bytes long").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > budget).alias("over_limit"), "fitting_chars"
    )

"""Language identification by unigram piece models that sum over all segmentations of each word."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causaltape.llm.shared import bounded, drawn

SPACE = "▁"
WORD = regex.compile(r"\p{L}+")
#: Log-probability of a character that no piece covers, and what a piece gets besides its expected count.
UNKNOWN, SMOOTHING = -16.0, 0.1
#: Words a Python worker keeps before it starts anew, and characters of text scored together.
KEPT, TOGETHER = 250_000, 1_500_000


@lru_cache(maxsize=1)
def pieces(path: str) -> dict[str, int]:
    """The fixed vocabulary: lower-cased letter pieces of a public tokenizer, with or without a word-begin mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = {model.id_to_piece(i).lower() for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    return {p: k for k, p in enumerate(sorted(p for p in plain if p == SPACE or WORD.fullmatch(p.removeprefix(SPACE))))}


class Lattice:
    """All ways to cut words into pieces of the vocabulary, scored for many words and languages at once."""

    def __init__(self, path: str):
        known = pieces(path)
        endings = {p[k:] for p in known for k in range(len(p))}
        states = {"": 0} | {e: k for k, e in enumerate(sorted(endings), 1)}
        steps = sorted((states[e[1:]] << 21 | ord(e[0]), states[e]) for e in endings)
        self.keys, self.to = (np.array(x, np.int64) for x in zip(*steps, strict=True))
        self.piece = np.full(len(states), -1, np.int64)
        for p, k in known.items():
            self.piece[states[p]] = k

    def edges(self, words: list[str], width: int) -> Iterator[tuple[np.ndarray, int, int, np.ndarray]]:
        """(rows, begin, end, pieces) of every piece that covers begin..end of some words; -1 for a lone character."""
        m = len(words)
        chars = np.array(words, f"<U{width}").view(np.uint32).reshape(m, width).astype(np.int64)
        length = np.fromiter(map(len, words), np.int64, m)
        for end in range(1, width + 1):
            rows = np.flatnonzero(length >= end)
            yield rows, end - 1, end, np.full(len(rows), -1)
            state = np.zeros(len(rows), np.int64)
            for begin in range(end - 1, -1, -1):
                key = state << 21 | chars[rows, begin]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                on = self.keys[at] == key
                rows, state = rows[on], self.to[at[on]]
                if not len(rows):
                    break
                got = self.piece[state]
                yield rows[got >= 0], begin, end, got[got >= 0]

    def forward(self, words: list[str], logp: np.ndarray) -> np.ndarray:
        """log P(prefix) for each word, prefix length and language, summed over all segmentations.

        logp has a row per piece and, last, one for a lone character; a column per language."""
        width = -(-max(map(len, words)) // 4) * 4
        alpha = np.full((len(words), width + 1, logp.shape[1]), -np.inf)
        alpha[:, 0] = 0
        for rows, begin, end, got in self.edges(words, width):
            alpha[rows, end] = np.logaddexp(alpha[rows, end], alpha[rows, begin] + logp[got])
        return alpha

    def score(self, words: list[str], logp: np.ndarray) -> np.ndarray:
        return self.forward(words, logp)[np.arange(len(words)), [len(w) for w in words]]

    def expected(self, words: list[str], counts: np.ndarray, language: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """Expected piece counts (piece, language), the sum over words of count times posterior of each use."""
        width = -(-max(map(len, words)) // 4) * 4
        one = np.arange(len(words))
        alpha = self.forward(words, logp)[one, :, language]
        beta = np.full((len(words), width + 1), -np.inf)
        size = np.fromiter(map(len, words), np.int64, len(words))
        beta[one, size] = 0
        total, out = alpha[one, size], np.zeros(logp.shape)
        for rows, begin, end, got in reversed(list(self.edges(words, width))):
            use = logp[got, language[rows]] + beta[rows, end]
            beta[rows, begin] = np.logaddexp(beta[rows, begin], use)
            np.add.at(out, (got, language[rows]), counts[rows] * np.exp(alpha[rows, begin] + use - total[rows]))
        return out


@lru_cache(maxsize=1)
def lattice(path: str) -> Lattice:
    return Lattice(path)


def by_width(words: list[str]) -> Iterator[list[int]]:
    """Positions of words of like length, some thousands at a time."""
    classes: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        classes.setdefault(-(-len(w) // 4), []).append(k)
    for width, members in classes.items():
        step = max(1, 60_000 // (width * width))
        for at in range(0, len(members), step):
            yield members[at : at + step]


class Model:
    def __init__(self, path: str, languages: list[str], logp: np.ndarray, prior: np.ndarray):
        self.path, self.languages, self.logp, self.prior = path, languages, logp, prior


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, path: str, most: int = 8000, rounds: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fits piece probabilities per language by expectation-maximisation on a sample of about `most` labelled rows.

    The sample is drawn by a hash of id and text, so it doesn't depend on partitioning; repeated rows count once. Words
    are counted per language in Spark; each round sums expected piece counts over partitions. What reaches the driver is one row per piece of the
    fixed vocabulary and language. Rows with null text or language are left out.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    sample = rows.where(drawn(rows.count(), most, 5, "id", "text")).distinct()
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)).alias("word"))
    counted = words.groupBy("lang", "word").count().persist()
    totals = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("count").alias("n")).collect()}
    documents = {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()}
    languages, known = sorted(totals), pieces(path)
    if not languages:
        return Model(path, [], np.zeros((len(known) + 1, 0)), np.zeros(0))
    number = {l: k for k, l in enumerate(languages)}
    logp = np.full((len(known) + 1, len(languages)), -np.log(len(known)))
    logp[-1] = UNKNOWN
    for _ in range(rounds):

        def expect(batches: Iterator[pa.RecordBatch], logp: np.ndarray = logp) -> Iterator[pa.RecordBatch]:
            out = np.zeros(logp.shape)
            for batch in batches:
                language = np.array([number[l] for l in batch.column(0).to_pylist()], np.int64)
                texts, counts = [SPACE + w for w in batch.column(1).to_pylist()], batch.column(2).to_numpy().astype(float)
                for members in by_width(texts):
                    out += lattice(path).expected([texts[k] for k in members], counts[members], language[members], logp)
            piece, language = np.nonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(language), pa.array(out[piece, language])], ["piece", "language", "n"])

        got = counted.mapInArrow(expect, "piece long, language long, n double").groupBy("piece", "language").agg(F.sum("n").alias("n"))
        table = np.full(logp.shape, SMOOTHING)
        for r in got.collect():
            table[r["piece"], r["language"]] += r["n"]
        logp = np.log(table / table[:-1].sum(axis=0))
        logp[-1] = UNKNOWN
    counted.unpersist()
    prior = np.log(np.array([documents[l] for l in languages], float) / sum(documents.values()))
    return Model(path, languages, logp, prior)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.lattice = model, lattice(model.path)
        self.rows: dict[str, int] = {}
        self.table = np.zeros((0, len(model.languages)))

    def learn(self, words: list[str]) -> None:
        new = np.zeros((len(words), len(self.model.languages)))
        marked = [SPACE + w for w in words]
        for members in by_width(marked):
            new[members] = self.lattice.score([marked[k] for k in members], self.model.logp)
        self.rows.update(zip(words, range(len(self.table), len(self.table) + len(words)), strict=True))
        self.table = np.concatenate([self.table, new])

    def scores(self, texts: list[str]) -> list[tuple[str, float]]:
        if len(self.rows) > KEPT:
            self.rows, self.table = {}, self.table[:0]
        found = [WORD.findall(t.lower()) for t in texts]
        self.learn(list({w for words in found for w in words if w not in self.rows}))
        out = []
        for words in found:
            if not words or not self.model.languages:
                out.append(("und", 0.0))
                continue
            total = self.model.prior + self.table[[self.rows[w] for w in words]].sum(axis=0)
            p = np.exp(total - total.max())
            best = int(p.argmax())
            out.append((self.model.languages[best], float(p[best] / p.sum())))
        return out


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, lang_pred, score), one per input row, in map tasks only.

    Words are runs of letters, lower-cased; a word's probability in a language sums over all its segmentations; the
    score is the posterior of the best language. Null text and text without a letter gives `und` with score 0, as
    does a model without languages. Of equal scores the first language in order wins. Ids may be null or repeat; an
    empty table gives an empty result; other columns are ignored; texts are read whole.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            texts, got, at = [t or "" for t in batch.column(1).to_pylist()], [], 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (chars < TOGETHER or end == at):
                    chars, end = chars + len(texts[end]), end + 1
                got += scorer.scores(texts[at:end])
                at = end
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(of, "doc_id long, lang_pred string, score double")

"""Toxicity scoring by a weighted finite-state pattern grammar over clauses.

Five small transducers read the word classes of a clause side by side: insults, threats (a violent verb near its
target), targets (somebody is addressed), negation (within a few words before) and reported speech (a verb of saying
or an open quotation before). Their composition is one table of states; each match it emits carries what the others
say about it. A sentence's end puts all of them back to their start, but an open quotation lasts to the end of its
paragraph. A document's features are the weighted matches of its clauses, not its words alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causaltape.llm.shared import bounded, drawn

#: Word lists of the grammar's classes in English, French, German and Spanish.
TARGET = "you your yours you're he she they them him tu te toi vous votre vos il elle ils du dich dir ihr euch er sie tú ti usted ustedes él ella ellos".split()
THREAT = "kill hurt destroy beat burn stab shoot crush tuer frapper détruire brûler écraser töten schlagen zerstören verletzen verbrennen matar golpear destruir quemar herir".split()
NEGATION = "not no never neither nor isn't aren't don't won't ne pas jamais aucun nicht kein keine nie niemals nunca jamás ningún".split()
REPORT = "said says wrote writes quoted called reported claimed dit écrit déclare rapporte sagte sagt schrieb berichtet dijo dice escribió afirma".split()
OTHER, INSULT, IS_TARGET, IS_THREAT, NEGATES, REPORTS, QUOTE, STOP = range(8)
TOKEN = regex.compile(r"[\p{L}']+|[\"“”«»]|[.!?;\n|]")
#: What ends a sentence, what ends a paragraph as well, and quotation marks.
STOPS, BREAKS, QUOTES = frozenset(".!?;"), frozenset("\n|"), frozenset("\"“”«»")
#: How many words a negation reaches forward, and how far apart a threat and its target may stand.
REACH, NEAR = 3, 4
#: Features: insults and threats, each plain or directed, negated or not, reported or not.
MATCHES = [*product(("insult", "threat"), (False, True), (False, True), (False, True))]


def machines() -> list[tuple[int, callable]]:
    """(start, step) of each transducer; step(state, class) gives the next state and what the state says of a match."""
    def threat(s: int, c: int) -> tuple[int, bool]:
        # positive: words since a violent verb that awaits its target; negative: words since a target
        if c == IS_THREAT:
            return (0, True) if s < 0 else (NEAR, False)
        if c == IS_TARGET:
            return (0, True) if s > 0 else (-NEAR, False)
        return (0 if c == STOP else s - (s > 0) + (s < 0), False)

    def report(s: int, c: int) -> tuple[int, bool]:
        # 1: a quotation is open; 2: a verb of saying stood in this sentence
        return (s & 1 if c == STOP else s ^ 1 if c == QUOTE else s | 2 if c == REPORTS else s, s > 0)

    insult = (0, lambda s, c: (0, c == INSULT))
    target = (0, lambda s, c: (int(c != STOP and (s or c == IS_TARGET)), bool(s)))
    negation = (0, lambda s, c: (REACH, s > 0) if c == NEGATES else (0 if c == STOP else max(0, s - 1), s > 0))
    return [insult, (0, threat), target, negation, (0, report)]


def compose() -> tuple[np.ndarray, np.ndarray]:
    """The product of the transducers: the next state and the emitted match (or -1) by state and class."""
    parts = machines()
    number: dict[tuple, int] = {tuple(start for start, _ in parts): 0}
    following, emitted, k, order = [], [], 0, [*number]
    at = {m: i for i, m in enumerate(MATCHES)}
    while k < len(order):
        row, out = [], []
        for c in range(STOP + 1):
            stepped = [step(s, c) for s, (_, step) in zip(order[k], parts, strict=True)]
            new = tuple(s for s, _ in stepped)
            if new not in number:
                number[new] = len(order)
                order.append(new)
            row.append(number[new])
            insult, threat, directed, negated, reported = (bool(said) for _, said in stepped)
            out.append(at["insult", directed, negated, reported] if insult else at["threat", True, negated, reported] if threat else -1)
        following.append(row)
        emitted.append(out)
        k += 1
    return np.array(following), np.array(emitted)


class Grammar:
    def __init__(self, insults: dict[str, float]):
        self.insults = insults
        self.kind = {w: c for c, words in ((REPORTS, REPORT), (NEGATES, NEGATION), (IS_TARGET, TARGET), (IS_THREAT, THREAT)) for w in words}
        self.kind |= dict.fromkeys(insults, INSULT) | dict.fromkeys(QUOTES, QUOTE) | dict.fromkeys(STOPS, STOP)
        self.marked = frozenset(insults) | frozenset(THREAT)
        following, emitted = compose()
        self.following, self.emitted = following.tolist(), emitted.tolist()

    def features(self, text: str) -> list[float]:
        """Summed weights of each kind of match, then the heaviest clause and the log of the number of words."""
        tokens = TOKEN.findall(text.lower())
        sums, heaviest, clause, state = [0.0] * len(MATCHES), 0.0, 0.0, 0
        if not self.marked.isdisjoint(tokens):
            for token in tokens:
                if token in BREAKS:
                    heaviest, clause, state = max(heaviest, clause), 0.0, 0
                    continue
                if token in STOPS:
                    heaviest, clause = max(heaviest, clause), 0.0
                c = self.kind.get(token, OTHER)
                match, state = self.emitted[state][c], self.following[state][c]
                if match >= 0:
                    weight = self.insults.get(token, 1.0)
                    sums[match] += weight
                    clause += weight
        return [*map(np.log1p, sums), max(heaviest, clause), float(np.log1p(len(tokens)))]


N_FEATURES = len(MATCHES) + 2


def prior_weights() -> np.ndarray:
    """What the weights are drawn towards: matches count, negated and reported ones less."""
    matches = [1.0 * (0.4 if negated else 1) * (0.5 if reported else 1) for _, _, negated, reported in MATCHES]
    return np.array([*matches, 0.3, 0.0, -3.0])


class Model:
    def __init__(self, insults: dict[str, float], weights: np.ndarray, mean: float):
        self.insults, self.weights, self.mean = insults, weights, mean

    def scores(self, features: np.ndarray) -> np.ndarray:
        x = np.concatenate([features, np.ones((len(features), 1))], axis=1)
        x[:, -2] -= self.mean
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def fit(features: np.ndarray, labels: np.ndarray, pull: float = 2.0) -> tuple[np.ndarray, float]:
    """Logistic weights by Newton steps, drawn towards the prior with a quadratic penalty."""
    prior = prior_weights()
    mean = float(features[:, -1].mean()) if len(features) else 0.0
    x = np.concatenate([features, np.ones((len(features), 1))], axis=1)
    x[:, -2] -= mean
    weights, strength = prior.copy(), np.full(len(prior), pull)
    strength[-1] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (labels - p) - strength * (weights - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(strength), gradient)
        weights += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return weights, mean


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = 12_000, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id") -> Model:
    """Learns insult words and the grammar's weights from the texts of a sample of about `most` labels.

    The sample is drawn from the labels by a hash of the id before any text is read, and then of distinct texts. A word
    is an insult if it stands in enough toxic texts and six times as often in toxic ones as in others; these words and
    the sample's features reach the driver, both bounded by the sample. Of several labels of an id the largest counts.
    Labels without an id or a value and null texts are left out. Without rows the prior weights stay.
    """
    known = labels.select(F.col(id_col).alias("labelled"), F.col(label_col).cast("int").alias("y")).where("labelled is not null and y is not null").groupBy("labelled").agg(F.max("y").alias("y"))
    chosen = known.where(drawn(known.count(), most, 11, "labelled"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    sample = rows.join(chosen, rows.id == chosen.labelled).groupBy("text").agg(F.max("y").alias("y")).persist()
    n, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    words = sample.select("y", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}']+)"), 1))).alias("word"))
    a, b = F.col("a") + 0.5, F.col("n") - F.col("a") + 0.5
    weight = F.log(a / (toxic + 1)) - F.log(b / (n - toxic + 1))
    found = words.groupBy("word").agg(F.sum("y").alias("a"), F.count("*").alias("n")).where(F.col("a") >= max(3, 0.008 * toxic)).withColumn("w", weight).where(F.col("w") > np.log(6))
    insults = {r["word"]: float(r["w"]) for r in found.collect()}
    grammar = Grammar(insults)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([grammar.features(t) for t in batch.column(0).to_pylist()], pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    got = sample.select("text", "y").mapInArrow(extract, "x array<double>, y int").toArrow()
    sample.unpersist()
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, N_FEATURES)
    order = np.lexsort((*x.T, got.column("y").to_numpy()))  # the same sums whatever the partitioning
    weights, mean = fit(x[order], got.column("y").to_numpy()[order].astype(float))
    return Model(insults, weights, mean)


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, score, predicted, matches), one per input row, in map tasks only.

    Null and empty texts get the score of a text without matches. predicted is 1 at or above `threshold`; matches is
    the weight of each kind of match that occurs. Ids may be null or repeat; an empty table gives an empty result;
    other columns are ignored; texts are read whole.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(model.insults)
        names = ["-".join([kind, *[n for n, on in zip(("directed", "negated", "reported"), flags, strict=True) if on]]) for kind, *flags in MATCHES]
        for batch in batches:
            x = np.array([grammar.features(t or "") for t in batch.column(1).to_pylist()], float).reshape(-1, N_FEATURES)
            p = model.scores(x)
            found = [", ".join(f"{n} {v:.2f}" for n, v in zip(names, row, strict=False) if v) for row in x.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(found, pa.string())], ["doc_id", "score", "predicted", "matches"])

    return bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(of, "doc_id long, score double, predicted int, matches string")


def keep_harmless(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """`docs` without the rows scored at or above `threshold`; null text is scored as empty. In map tasks only."""
    at = docs.columns.index(text_col)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(model.insults)
        for batch in batches:
            x = np.array([grammar.features(t or "") for t in batch.column(at).to_pylist()], float).reshape(-1, N_FEATURES)
            yield batch.filter(pa.array(model.scores(x) < threshold))

    return bounded(docs).mapInArrow(of, docs.schema)

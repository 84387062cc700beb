"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causaltape.llm.shared import bounded

BASE, TAGS = ("email", "ip", "card", "phone"), ("", "person", "secret")
KINDS = (*BASE, *TAGS[1:])
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"\w+|[^\w\s]|\n")
#: Characters of text whose sentences are decoded together.
TOGETHER = 1_000_000

Span = tuple[int, int, int]
#: Stands for the end of a line among word classes.
BORDER = -2


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) by kind, then start. Each pattern matches leftmost and without overlap, in linear time:
    an e-mail address is read outwards from its @, and runs of digits are never entered in the middle."""
    found: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            found.append((0, start, end))
        else:
            end = max(end, at + 1)
        at = text.find("@", end)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append((1, *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            found.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                found.append((3, *m.span()))
    return found


#: The labelled table, made up for this model. {kind:...} marks a span.
LABELLED = """
token = "{secret:9f86d081884c7d659a2feaa0c55ad015a3bf4f1b}" was found in the log.
the token = "{secret:04dbebab91ab85687d33eeaaf9ac699e1188f962}" and more
old token = "{secret:cb1a9fee807a05366fcb8b6c95c7c565ede51a72}"
api_key = "{secret:AKIA5Q2JX7PLM3ZK9W}" then done
API_KEY={secret:sk9f2b7c11d04e4a6f8b3d}
the secret: {secret:b1946ac92492d2347c6235b4d2611184} must go
password = "{secret:hunter2Blue9}" in the file
password: {secret:Xk7pQ2v9Lm}
secret = '{secret:5d41402abc4b2a76b9719d911017c592}'
le token = "{secret:7d793037a0760186574b0282f2f435e7ab34cd01}" est dans la note.
das token = "{secret:e4d909c290d0fb1ca068ffaddf22cbd0aa91b7e3}" steht hier.
el token = "{secret:1f3870be274f6c49b3e31a0c6728957f45cd9a10}" queda en la nota.
TOKEN = "{secret:04DBEBAB91AB85687D33EEAAF9AC699E1188F962}"
Dr. {person:Ada Morland} wrote the note.
ask Mr. {person:Tom Hale} about it
Mrs. {person:Rita Vance} and Mr. {person:Olaf Brandt} came
name: {person:Lena Okafor}
Name: {person:Paul Ferrer}
I met Ms. {person:Jane Doyle} there.
Frau Dr. {person:Erika Lange} kommt morgen.
the token was lost on the way
a token of thanks, and the password was changed.
The name of the place is long.
Name and place are given below.
The key to the house is old. The secret is out.
In 2019 there were 14 of them, and 3 more in 2020.
The order 4532015112830366 was paid.
write to tom@example.com or call +1 (487) 555 7209 now
the host 10.20.30.40 answers
We go to the market. They come home.
The And The Of The And The
THE AND OF THAT WITH FROM
A | b | C | dd | Ee | fff.
for for for for for for for
$$$ de,&&& ci%%% and###
Er kommt heute. Sie geht morgen nach Hause.
Elle vient de la ville, et il part demain.
Los de la casa. Que no es de las otras.
It is 9 in the morning; 10 in the evening.
By. Only you. Ero went home. This. The end.
Heti. Of course, to be. La. Una vez, sí.
The.*** Nt and.*** Of it. With. Here, or there.
""".strip().split("\n")
PARSED = re.compile(r"\{(person|secret):([^}]*)\}")


def labelled() -> list[tuple[str, list[tuple[int, int, int]]]]:
    """(text, spans) of each row of the labelled table."""
    out = []
    for line in LABELLED:
        text, spans, at = "", [], 0
        for m in PARSED.finditer(line):
            text += line[at : m.start()]
            spans.append((TAGS.index(m[1]), len(text), len(text) + len(m[2])))
            text, at = text + m[2], m.end()
        out.append((text + line[at:], spans))
    return out


def shape(word: str) -> str:
    """Runs of capitals, small letters, digits and others, each as one mark; what alternates often is `mixed`."""
    if word.isalpha():
        if word.islower():
            return "x"
        if word.isupper():
            return "X"
    marks = re.sub(r"(.)\1+", r"\1", "".join("X" if c.isupper() else "9" if c.isdigit() else "x" if c.isalpha() else c for c in word[:64]))
    return marks if len(marks) <= 3 else "mixed"


OFFSETS = (-4, -3, -2, -1, 0, 1)


class Field:
    """The field's weights: by feature, offset and tag, and by pair of tags."""

    def __init__(self, cues: frozenset[str]):
        self.cues, self.features, self.of_word = cues, {}, {"\n": BORDER}
        self.emit, self.move = np.zeros((1, len(OFFSETS), len(TAGS))), np.zeros((len(TAGS), len(TAGS)))
        self.classes: dict[tuple, int] = {}
        self.scores = np.zeros((0, len(OFFSETS), len(TAGS)))

    def signature(self, word: str) -> tuple[str, ...]:
        """The features of a word: its shape, with its length if it has digits, and itself if it is a cue."""
        kind = shape(word)
        length = min(4, len(word).bit_length()) if kind == "mixed" or "9" in kind else 0
        low = word.lower()
        return (f"shape={kind}", f"size={kind}/{length}", f"cue={low if low in self.cues else ''}")

    def class_of(self, word: str) -> int:
        found = self.of_word.get(word)
        if found is None:
            signature = self.signature(word)
            found = self.classes.setdefault(signature, len(self.classes))
            if found == len(self.scores):
                rows = [self.features[f] for f in signature if f in self.features]
                self.scores = np.concatenate([self.scores, self.emit[rows].sum(axis=0, keepdims=True)])
            if len(self.of_word) > 300_000:
                self.of_word.clear()
                self.of_word["\n"] = BORDER
            self.of_word[word] = found
        return found

    def fit(self, rows: list[tuple[list[str], list[int]]], rounds: int = 150, rate: float = 0.3, pull: float = 0.01) -> None:
        """Gradient ascent on the conditional log-likelihood, by forward-backward, with adaptive steps."""
        signatures = [[self.signature(w) for w in words] for words, _ in rows]
        for f in sorted({f for s in signatures for word in s for f in word}):
            self.features[f] = len(self.features)
        self.emit = np.zeros((len(self.features), len(OFFSETS), len(TAGS)))
        uses = []
        for s in signatures:
            ids = np.array([[self.features[f] for f in word] for word in s])
            uses.append([(t, o, ids[t + off]) for t in range(len(s)) for o, off in enumerate(OFFSETS) if 0 <= t + off < len(s)])
        past = [np.full(self.emit.shape, 1e-8), np.full(self.move.shape, 1e-8)]
        for _ in range(rounds):
            slopes = [-pull * self.emit, -pull * self.move]
            for (words, tags), used in zip(rows, uses, strict=True):
                n = len(words)
                score = np.zeros((n, len(TAGS)))
                for t, o, ids in used:
                    score[t] += self.emit[ids, o].sum(axis=0)
                a, b = score.copy(), np.zeros_like(score)
                for t in range(1, n):
                    a[t] += np.logaddexp.reduce(a[t - 1][:, None] + self.move, axis=0)
                for t in range(n - 2, -1, -1):
                    b[t] = np.logaddexp.reduce(self.move + score[t + 1] + b[t + 1], axis=1)
                total = np.logaddexp.reduce(a[-1])
                error = -np.exp(a + b - total)
                error[np.arange(n), tags] += 1
                for t, o, ids in used:
                    np.add.at(slopes[0], (ids, o), error[t])
                for t in range(1, n):
                    slopes[1] -= np.exp(a[t - 1][:, None] + self.move + score[t] + b[t] - total)
                    slopes[1][tags[t - 1], tags[t]] += 1
            for weights, slope, seen in zip((self.emit, self.move), slopes, past, strict=True):
                seen += slope**2
                weights += rate * slope / np.sqrt(seen)

    def doubtful(self, classes: np.ndarray, border: np.ndarray) -> np.ndarray:
        """Numbers of the lines that may hold a tag; `classes` is a row of lines with a `border` entry after each.

        Against no tags at all, a run of tags gains its tokens' scores over the untagged ones and at most the best
        move at each end and between. A line in which every token loses more than two such moves has no tag."""
        line = np.cumsum(border) - border
        reach = max(map(abs, OFFSETS))
        place = np.arange(len(classes)) + reach * line + reach
        spread = np.full(len(classes) + reach * (int(line[-1]) + 3), len(self.scores))
        spread[place[~border]] = classes[~border]
        lead = np.concatenate([self.scores[:, :, 1:] - self.scores[:, :, :1], np.zeros((1, len(OFFSETS), len(TAGS) - 1))])
        gain = sum(lead[:, o][spread[place + off]] for o, off in enumerate(OFFSETS)).max(axis=1)
        best = max(0.0, float((self.move - self.move[0, 0]).max()))
        return np.unique(line[~border & (gain + 2 * best >= 0)])

    def decode(self, sentences: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi for many sentences of word classes: all take a step at once, the longest first in order."""
        order = sorted(range(len(sentences)), key=lambda k: -len(sentences[k]))
        sizes = np.array([len(sentences[k]) for k in order], np.int64)
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(sentences)
        at = 0
        while at < len(order):  # sentences at least half as long as the first make one matrix
            end = at + int(np.searchsorted(-sizes[at:], -max(1, sizes[at] // 2), side="right"))
            end = min(end, at + max(1, 400_000 // max(1, int(sizes[at]))))
            for k, tags in zip(order[at:end], self.viterbi([sentences[k] for k in order[at:end]]), strict=True):
                out[k] = tags
            at = end
        return out

    def viterbi(self, sentences: list[np.ndarray]) -> list[np.ndarray]:
        m, width = len(sentences), max(map(len, sentences))
        if not width:
            return [np.zeros(0, np.int8)] * m
        size = np.array([len(s) for s in sentences])
        inside = np.arange(width) < size[:, None]
        classes = np.full((m, width), -1)
        classes[inside] = np.concatenate(sentences)
        table = np.concatenate([self.scores, np.zeros((1, *self.scores.shape[1:]))])
        score = np.zeros((m, width, len(TAGS)))
        for o, off in enumerate(OFFSETS):
            if abs(off) < width:
                score[:, max(0, -off) : width - max(0, off)] += table[classes[:, max(0, off) : width - max(0, -off)], o]
        back = np.zeros((m, width, len(TAGS)), np.int8)
        best = score[:, 0]
        for t in range(1, width):
            step = best[:, :, None] + self.move
            back[:, t] = step.argmax(axis=1)
            best = np.where(inside[:, t, None], step.max(axis=1) + score[:, t], best)
            back[~inside[:, t], t] = np.arange(len(TAGS))
        tags = np.zeros((m, width), np.int8)
        tags[:, -1] = best.argmax(axis=1)
        for t in range(width - 1, 0, -1):
            tags[:, t - 1] = back[np.arange(m), t, tags[:, t]]
        return [t[:n] for t, n in zip(tags, size.tolist(), strict=True)]


def train() -> Field:
    """Fits the field to the labelled table. Its cues are the words that stand within four words before a span."""
    rows, cues = [], set()
    for text, spans in labelled():
        found = [(m.group(), m.start(), m.end()) for m in TOKEN.finditer(text)]
        tags = [next((k for k, s, e in spans if s <= a and b <= e), 0) for _, a, b in found]
        rows.append(([w for w, _, _ in found], tags))
        cues |= {found[j][0].lower() for i, t in enumerate(tags) if t for j in range(max(0, i - 4), i) if not tags[j]}
    field = Field(frozenset(c for c in cues if len(c) > 1 or c in "=:"))
    field.fit(rows)
    return field


class Finder:
    def __init__(self, field: Field):
        self.field = field

    def find(self, texts: list[str]) -> list[list[Span]]:
        """All spans of each text: the base ones, and the field's that overlap none of them.

        Every line is scored; those whose scores leave a tag possible are decoded."""
        found = [base_spans(t) for t in texts]
        field, ids, lengths = self.field, [], []
        get = field.of_word.get
        for text in texts:
            tokens = [*TOKEN.findall(text), "\n"]
            some = [get(t) for t in tokens]
            ids += some if None not in some else [BORDER if t == "\n" else field.class_of(t) for t in tokens]
            lengths.append(len(tokens))
        classes = np.array(ids, np.int64)
        border = classes == BORDER
        if not len(classes):
            return found
        lines = field.doubtful(classes, border)
        ends = np.flatnonzero(border)
        starts = np.concatenate(([0], ends[:-1] + 1))
        owner = np.searchsorted(np.cumsum(lengths), starts, side="right")
        first = np.cumsum(lengths) - lengths
        places: dict[int, list[tuple[int, int]]] = {}
        for line, tags in zip(lines.tolist(), field.decode([classes[starts[k] : ends[k]] for k in lines.tolist()]), strict=True):
            if tags.any():
                k = int(owner[line])
                if k not in places:
                    places[k] = [m.span() for m in TOKEN.finditer(texts[k])]
                begin = int(starts[line] - first[k])
                found[k] += self.runs(tags, places[k][begin : begin + len(tags)], found[k])
        return [sorted(spans) for spans in found]

    @staticmethod
    def runs(tags: np.ndarray, spans: list[tuple[int, int]], known: list[Span]) -> list[Span]:
        """Runs of one tag as spans, without those that overlap a base span."""
        base, out, at = [(s, e) for kind, s, e in known if kind < len(BASE)], [], 0
        while at < len(tags):
            stop = at
            while stop < len(tags) and tags[stop] == tags[at]:
                stop += 1
            s, e = spans[at][0], spans[stop - 1][1]
            if tags[at] and not any(s < y and x < e for x, y in base):
                out.append((len(BASE) + int(tags[at]) - 1, s, e))
            at = stop
        return out


def personal_data(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, spans), one per input row; spans is an array of (kind, start, end) by kind in KINDS' order, then
    start, in code points with an exclusive end. Runs in map tasks only.

    E-mail, IP, card and phone spans follow fixed patterns; persons and secrets come from the field, decoded line by
    line over the whole text. Null text counts as empty and has no spans. Ids may be null or repeat; an empty table
    gives an empty result; other columns are ignored.
    """
    field = field or train()
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(field)
        for batch in batches:
            texts, got, at = [t or "" for t in batch.column(1).to_pylist()], [], 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (chars < TOGETHER or end == at):
                    chars, end = chars + len(texts[end]), end + 1
                got += finder.find(texts[at:end])
                at = end
            spans = [[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in found] for found in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, struct)], ["doc_id", "spans"])

    return bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(of, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by <kind>. Spans that overlap are masked as one, up to the last end of them, by
    the kind of the leftmost and then longest."""
    out, at = [], 0
    for s, e, kind in sorted(((s, e, k) for k, s, e in spans), key=lambda x: (x[0], -x[1], x[2])):
        if s >= at:
            out += [text[at:s], f"<{KINDS[kind]}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, field: Field | None = None, text_col: str = "text") -> DataFrame:
    """`docs` with each span of `text_col` replaced by its kind in angle brackets; null text stays null."""
    field = field or train()
    names = docs.columns
    at = names.index(text_col)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(field)
        for batch in batches:
            texts, out, k = batch.column(at).to_pylist(), [], 0
            while k < len(texts):
                end, chars = k, 0
                while end < len(texts) and (chars < TOGETHER or end == k):
                    chars, end = chars + len(texts[end] or ""), end + 1
                part = texts[k:end]
                out += [None if t is None else masked(t, s) for t, s in zip(part, finder.find([t or "" for t in part]), strict=True)]
                k = end
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == at else column for c, column in enumerate(batch.columns)], names)

    return bounded(docs).mapInArrow(of, docs.schema)

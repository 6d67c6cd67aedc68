"""Toxicity by a support vector machine on gapped subsequences of letters.

Strings are words (or runs of spaced-out letters) reduced to 47 letter codes: case, look-alike digits and
signs between letters are folded away; accented letters keep codes of their own. Their features are the subsequences of three and of four
letters within SPAN letters, each occurrence weighted by DECAY to the stretch it covers, over a norm by length; so a
string with inserted letters shares most features with the plain one. Nystroem landmarks approximate the
kernel, and a squared-hinge machine is trained on the sentences of labelled documents: a sentence counts by
its strongest string, a toxic document by its strongest sentence, and the witnesses are chosen anew in each
round (multiple-instance learning). A logistic curve over a document's TOP strongest strings and the number
of its strings gives the score. A weighted sum over landmarks is a linear function of the subsequences,
so the trained machine is one table of weights; scoring looks each distinct string up once.

Training takes at most SAMPLE_TOXIC toxic and SAMPLE_CLEAN other labelled documents of the training fold,
those with the smallest hash of their id: a documented bound on labelled rows alone. They are trained on in one
task. Scoring takes every text whole.

Defined results: a null text counts as empty, and an empty text scores 0; without toxic or without clean
training rows every score is 0; null labels and null ids are not learnt from; of repeated label rows the largest
counts, and of documents that share an id the least text; very long texts are scored whole, by all their strings;
each row is scored alone, so repeated rows agree, ties do not occur, and a row with a null id is scored and not held
out; an empty table gives no rows; other columns, of whatever name, are ignored, or kept by `keep_clean`.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from heapq import nlargest
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, releasing, slices, text_or_empty

SPAN, DECAY, LETTERS, TOP = 7, 0.7, 48, 4
SAMPLE_TOXIC, SAMPLE_CLEAN = 1_500, 3_000
LANDMARKS, NEGATIVES, ROUNDS, COST, MOST_WEIGHT = 384, 8_000, 3, 4.0, 200
RIDGE, STEPS, MACHINE_ROWS = 1e-3, 15, 1_000
WINDOW, CLEAN_WEIGHT, PENALTY, INSERTED = 24, 1.0, 0.1, 4
CACHE_WORDS = 120_000
SPACED = re.compile(r"(?:(?<!\S)\S[^\S\n]){2,}\S(?!\S)")
# Signs and digits that stand for letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i"}
_PATTERNS = [(0, *c) for size in (2, 3) for c in combinations(range(1, SPAN), size)]
_OFFSET = LETTERS**3  # subsequences of four letters come behind those of three


def fold(word: str) -> bytes:
    """Letter codes 1 to 47 of a word; signs vanish, letters beyond a-z share twenty codes."""
    out = bytearray()
    for c in unicodedata.normalize("NFKC", word).lower().strip(".,;:!?\"'()[]"):
        c = LOOKALIKES.get(c, c)
        if "a" <= c <= "z":
            out.append(ord(c) - 96)
        elif c.isalpha():
            out.append(27 + ord(c) % 20)
        elif c.isdigit():
            out.append(47)
    return bytes(out)


def windows(code: bytes) -> list[bytes]:
    """A string of ordinary length as it is, a longer one in overlapping windows that cover it; one or two letters are filled up with zeros to have a subsequence."""
    if 0 < len(code) < 3:
        return [code.ljust(3, b"\0")]
    if len(code) <= WINDOW:
        return [code]
    return [code[i : i + WINDOW] for i in range(0, len(code) - WINDOW // 2, WINDOW // 2)]


@lru_cache(maxsize=64)
def _norm(length: int) -> float:
    total = sum(DECAY ** (2 * (p[-1] + 1)) * max(0, length - p[-1]) for p in _PATTERNS)
    return max(total, DECAY**6) ** 0.5


def features(m: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """For strings of one length as rows: the subsequences of one pattern of offsets, and their weight over the norm."""
    n = m.shape[1]
    wide = m.astype(np.int32)
    for p in _PATTERNS:
        count = n - p[-1]
        if count <= 0:
            continue
        index = wide[:, :count]
        for o in p[1:]:
            index = index * LETTERS + wide[:, o : o + count]
        yield index + _OFFSET * (len(p) == 4), DECAY ** (p[-1] + 1) / _norm(n)


def by_length(codes: list[bytes], rows: int = 8_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions in codes, and their strings as a matrix, for each length."""
    lengths = np.fromiter(map(len, codes), dtype=np.int64, count=len(codes))
    for n in np.unique(lengths[lengths >= 3]):
        at = np.flatnonzero(lengths == n)
        for i in range(0, len(at), rows):
            part = at[i : i + rows]
            yield part, np.frombuffer(b"".join(codes[j] for j in part), dtype=np.uint8).reshape(len(part), n)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    curve: np.ndarray

    def packed(self) -> bytes:
        at = np.flatnonzero(self.weights).astype(np.int32)
        return zlib.compress(pickle.dumps((len(self.weights), at, self.weights[at], self.bias, self.curve)), 1)

    @staticmethod
    def unpacked(data: bytes) -> Model:
        size, at, values, bias, curve = pickle.loads(zlib.decompress(data))
        weights = np.zeros(size, dtype=np.float32)
        weights[at] = values
        return Model(weights, bias, curve)

    def margins(self, codes: list[bytes]) -> np.ndarray:
        out = np.full(len(codes), -np.inf)
        for at, m in by_length(codes):
            total = np.zeros(len(at))
            for index, weight in features(m):
                total += self.weights[index].sum(axis=1) * weight
            out[at] = total + self.bias
        return out

    def probability(self, top: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Scores of documents from their strongest margins (n, TOP) and numbers of strings; 0 without any string."""
        z = np.clip(_document_features(top, sizes) @ self.curve, -50, 50)
        return np.where(np.isneginf(top[:, 0]), 0.0, 1 / (1 + np.exp(-z)))


def _document_features(top: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.column_stack([np.clip(top, -2, 3), np.log1p(sizes), np.ones(len(sizes))])


def _strongest(margins: np.ndarray) -> np.ndarray:
    out = np.full(TOP, -np.inf)
    best = np.sort(margins)[::-1][:TOP]
    out[: len(best)] = best
    return out


def strings(text: str) -> set[str]:
    """The distinct strings of a text: its words, and runs of spaced-out letters put together."""
    found = set(text.split())
    for m in SPACED.finditer(text):
        found.add("".join(m[0].split()))
    return found


def _kernel(codes: list[bytes], marks: list[bytes]) -> np.ndarray:
    """Kernel values of strings against landmarks, through an inverted list of the landmarks' subsequences."""
    rows, cols, values = [], [], []
    for at, m in by_length(marks):
        for index, weight in features(m):
            rows.append(index.ravel())
            cols.append(np.repeat(at, index.shape[1]))
            values.append(np.full(index.size, weight))
    rows, cols, values = map(np.concatenate, (rows, cols, values))
    order = np.argsort(rows, kind="stable")
    rows, cols, values = rows[order], cols[order], values[order]
    starts = np.zeros(_OFFSET + LETTERS**4 + 1, dtype=np.int32)
    np.add.at(starts, rows + 1, 1)
    np.cumsum(starts, out=starts)
    out = np.zeros((len(codes), len(marks)))
    for at, m in by_length(codes, 1_000):  # each row meets many entries of the lists
        for index, weight in features(m):
            flat = index.ravel()
            who = np.repeat(at, index.shape[1])
            count = starts[flat + 1] - starts[flat]
            hit = count > 0
            flat, who, count = flat[hit], who[hit], count[hit]
            inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            entry = np.repeat(starts[flat], count) + inner
            np.add.at(out, (np.repeat(who, count), cols[entry]), values[entry] * weight)
    return out


def _machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Weights of a squared-hinge machine, by Newton steps over the active rows."""
    v, active = np.zeros(x.shape[1]), np.ones(len(y), dtype=bool)
    for _ in range(STEPS):
        left, right = np.eye(x.shape[1]), np.zeros(x.shape[1])
        for i in range(0, len(x), MACHINE_ROWS):  # x is the largest table of training; no copies of it
            part = slice(i, i + MACHINE_ROWS)
            a, d = x[part][active[part]], 2 * cost[part][active[part]]
            left += (a * d[:, None]).T @ a
            right += a.T @ (d * y[part][active[part]])
        v = np.linalg.solve(left, right)
        now = y * (x @ v) < 1
        if (now == active).all():
            break
        active = now
    return v


def _inserted(codes: list[bytes], random: np.random.Generator) -> list[bytes]:
    """Copies of strong positive strings with one letter put in between others, as evasions have it."""
    out = []
    for c in codes:
        for at in random.integers(1, len(c), size=INSERTED):
            out.append(c[:at] + bytes([int(random.integers(1, 27))]) + c[at:])
    return out


def train(texts: list[str], toxic: list[int]) -> Model | None:
    """The machine for labelled documents. None if either label is missing.

    The logistic curve is fitted on margins that each half gets from a machine trained on the other half, as
    a machine is too sure of what it was trained on.
    """
    if not any(toxic) or all(toxic):
        return None
    number: dict[bytes, int] = {}
    bags = []
    for text in texts:
        sentences = re.split(r"[.!?\n]+", text)
        found = {c for s in sentences for w in strings(s) for c in windows(fold(w)) if len(c) >= 3}
        bags.append(np.array([number.setdefault(c, len(number)) for c in sorted(found)], dtype=np.int32))
    vocabulary = list(number)
    del number
    label = np.array(toxic, dtype=bool)
    model = _train(vocabulary, bags, label)
    if model is None:
        return None
    half = np.zeros(len(label), dtype=np.int64)
    for y in (True, False):
        half[label == y] = np.arange((label == y).sum()) % 2
    top = np.full((len(bags), TOP), -np.inf)
    for h in (0, 1):
        other = _train(vocabulary, [b for b, x in zip(bags, half) if x != h], label[half != h]) or model
        margin = _margins_of(other, vocabulary, [b for b, x in zip(bags, half) if x == h])
        for i in np.flatnonzero(half == h):
            top[i] = _strongest(margin[bags[i]])
        del other
    sizes = np.array([len(b) for b in bags])
    model.curve = _calibrate(_document_features(top, sizes)[sizes > 0], label[sizes > 0])
    return model


def _margins_of(model: Model, vocabulary: list[bytes], bags: list[np.ndarray]) -> np.ndarray:
    """Margins of the strings in bags, by their place in the vocabulary; others are not looked at."""
    out = np.full(len(vocabulary), -np.inf)
    used = np.unique(np.concatenate([np.empty(0, np.int32), *bags]))
    for i in range(0, len(used), 50_000):
        part = used[i : i + 50_000]
        out[part] = model.margins([vocabulary[j] for j in part])
    return out


def _train(vocabulary: list[bytes], bags: list[np.ndarray], label: np.ndarray) -> Model | None:
    """The machine, without a curve, of bags of strings given by their places in the vocabulary."""
    if not label.any() or label.all():
        return None
    bad, good = (np.bincount(np.concatenate([np.empty(0, np.int32), *(b for b, y in zip(bags, label) if y == want)]), minlength=len(vocabulary)) for want in (True, False))
    # The first witnesses: strings that are found in toxic documents far more often than in others.
    odds = np.log((bad + 0.2) / (label.sum() + 1)) - np.log((good + 0.2) / ((~label).sum() + 1)) - 1.5 / np.sqrt(bad + 0.2)
    score = odds
    random = np.random.default_rng(7)
    clean = np.flatnonzero((good > 0) & (bad <= good))
    negatives = random.choice(clean, size=min(len(clean), NEGATIVES), replace=False) if len(clean) else np.empty(0, np.int64)
    model = None
    for step in range(ROUNDS):
        best = Counter(int(b[score[b].argmax()]) for b, y in zip(bags, label) if y and len(b))
        if step == 0:
            best = Counter({w: n for w, n in best.items() if good[w] == 0})
        strong = np.flatnonzero((bad >= 5) & (good == 0) & (odds > 1.5))
        positives = np.array(sorted(set(best) | set(strong.tolist())), dtype=np.int64)
        positives = positives[good[positives] * 10 <= bad[positives]]
        if not len(positives):
            return None
        if step:  # strings of clean documents that score highest
            hard = np.array([int(b[score[b].argmax()]) for b, y in zip(bags, label) if not y and len(b)], dtype=np.int64)
            negatives = np.unique(np.concatenate([negatives, hard]))
        negatives = np.setdiff1d(negatives, positives)
        order = positives[np.argsort(-bad[positives], kind="stable")]
        marks = np.concatenate([order[: LANDMARKS * 3 // 4], random.choice(negatives, size=min(len(negatives), LANDMARKS // 4), replace=False)])
        marks = [vocabulary[i] for i in marks]
        rows = np.concatenate([positives, negatives])
        y = np.concatenate([np.ones(len(positives)), -np.ones(len(negatives))])
        gapped = _inserted([vocabulary[i] for i in strong if i in best], random)
        root = np.linalg.cholesky(_kernel(marks, marks) + RIDGE * np.eye(len(marks)))
        whiten = np.linalg.inv(root).T
        codes = [vocabulary[i] for i in rows] + gapped
        x = np.ones((len(codes), len(marks) + 1))
        kernel = _kernel(codes, marks)
        for i in range(0, len(codes), MACHINE_ROWS):
            x[i : i + MACHINE_ROWS, :-1] = kernel[i : i + MACHINE_ROWS] @ whiten
        del kernel
        weight = np.where(y > 0, np.minimum(bad[rows], MOST_WEIGHT) / 2 + 0.5, np.minimum(good[rows], MOST_WEIGHT) / 2 + 0.5) * COST
        y, weight = np.append(y, np.ones(len(gapped))), np.append(weight, np.full(len(gapped), COST))
        v = _machine(x, y, weight)
        del x
        alpha = whiten @ v[:-1]
        table = np.zeros(_OFFSET + LETTERS**4, dtype=np.float32)
        for at, m in by_length(marks):
            for index, w in features(m):
                np.add.at(table, index, np.broadcast_to(alpha[at][:, None] * w, index.shape))
        model = Model(table, float(v[-1]), np.zeros(TOP + 2))
        score = _margins_of(model, vocabulary, bags)
        release()
    return model


def _calibrate(x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Weights of a logistic curve; a clean document weighs CLEAN_WEIGHT toxic ones, and a penalty keeps it finite."""
    y, each = label.astype(float), np.where(label, 1.0, CLEAN_WEIGHT)
    v = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -50, 50)))
        step = np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + PENALTY * np.eye(len(v)), x.T @ (each * (p - y)) + PENALTY * v)
        v -= step
        if np.abs(step).max() < 1e-8:
            break
    return v


def fit(documents: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """Train on labelled rows whose fold is not the held one, in one task that gets SAMPLE_* rows at most; the driver gets the table of weights."""
    marks = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL").where(F.crc32(F.col("id").cast("string")) % folds != held)
    marks = marks.groupBy("id").agg(F.max("y").alias("y"))
    chosen = None
    for want, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)):
        part = marks.where(F.col("y") == want).orderBy(F.xxhash64("id"), "id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    found = documents.select(documents[id_col].alias("id"), text_or_empty(text_col).alias("text")).join(F.broadcast(chosen), "id")
    found = found.groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y"))

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("id", "text", "y"))))
        model = train([r[1] for r in rows], [r[2] for r in rows])
        if model is not None:
            yield pa.RecordBatch.from_arrays([pa.array([model.packed()], pa.binary())], names=["model"])

    made = found.repartition(1).mapInArrow(run, "model binary").collect()
    return Model.unpacked(made[0]["model"]) if made else None


class Scorer:
    """Scores texts; remembers the margins of strings, up to CACHE_WORDS of them."""

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}

    def probabilities(self, texts: list[str]) -> np.ndarray:
        split = [strings(x) for x in texts]
        new = {w for s in split for w in s if w not in self.known}
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            new = set().union(*split) if split else new
        words = list(new)
        codes, owner = [], []
        for i, w in enumerate(words):
            for c in windows(fold(w)):
                codes.append(c), owner.append(i)
        best = np.full(len(words), -np.inf)
        if codes:
            np.maximum.at(best, np.array(owner), self.model.margins(codes))
        self.known.update(zip(words, best.tolist()))
        get = self.known.__getitem__
        top = np.array([_strongest(np.array(nlargest(TOP, map(get, s)))) for s in split]).reshape(len(texts), TOP)
        return self.model.probability(top, np.array([len(s) for s in split]))


def score(df: DataFrame, model: Model | None, folds: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, held_out, score, predicted."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            if sent.value is None:
                p = np.zeros(len(texts))
            else:
                scorer = scorer or Scorer(sent.value)
                p = scorer.probabilities(texts)
            held_out = [x is not None and zlib.crc32(str(x).encode()) % folds == held for x in batch.column("id").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(held_out, pa.bool_()), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32), pa.int32())], names=[id_col, "held_out", "score", "predicted"])

    schema = f"`{id_col}` {dict(df.dtypes)[id_col]}, held_out boolean, score double, predicted int"
    return df.select(df[id_col].alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, schema)


def keep_clean(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of df, with all their columns, whose text is not predicted toxic."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in slices(batches, text_col):
            if sent.value is not None:
                scorer = scorer or Scorer(sent.value)
                p = scorer.probabilities([x or "" for x in batch.column(text_col).to_pylist()])
                batch = batch.filter(pa.array(p < 0.5))
            yield batch

    return df.mapInArrow(run, df.schema)

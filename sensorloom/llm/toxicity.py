"""Toxicity: a counterfactual-regularised linear classifier.

A text's features are its distinct words and word beginnings of ``PREFIXES`` bytes, hashed into
``SLOTS`` slots; the score is a logistic function of the sum of their weights.  Training minimises

    weighted log loss + LASSO * |w| + COUNTERFACTUAL * mean (score(s) - score(s'))**2

over the sentences s of labelled texts that name an identity group, where s' names another group of
the same list instead (scores before the logistic function).  Each pair of neighbouring terms of a
list is a pair of its own too, so terms that the labels hardly show are also kept alike.  The lasso
keeps few words, so the score of a clean text does not drift with its length.

The minimum is that over all slots of ``LEAST_ROWS`` chosen rows and more and over the slots of all
identity terms.  Accelerated proximal steps fit a working set of them; as long as the gradient of any
other slot exceeds the lasso, such slots join and the fit goes on.

Training reads at most about ``PER_CLASS`` labelled texts of each class, chosen by hash, in one
task; scoring reads every whole text.  Labels, language, source and id are never inputs of a score.

Defined cases: null and empty texts get the score of a text without words; repeated rows are scored
alike; without labels of both classes the score is the share of label 1 (0.5 without any label);
further columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.tables import training_rows
from sensorloom.llm.word_arrays import LETTERS, pieces

PREFIXES = (4, 5, 6)
SLOT_BITS = 18
SLOTS = 1 << SLOT_BITS
PER_CLASS = 6000
#: Rows of a slot that is fitted, and slots that join the working set at once.
LEAST_ROWS = 3
WORKING = 512
LASSO = 3e-4
COUNTERFACTUAL = 0.1
ROUNDS = 600
MODULUS, HELD = 5, 0

#: Identity terms by group; a swap puts the next term of the list in the place of a term.
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "arab"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("old", "young", "elderly", "teenage"),
    ("blind", "deaf", "disabled", "autistic"),
    ("americans", "mexicans", "chinese", "indians", "africans", "europeans"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"),
    ("frauen", "männer"), ("muslime", "christen", "juden"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)
_SENTENCE = re.compile(r"[^.!?\n]+")


def features(text: str | bytes | None) -> np.ndarray:
    """Sorted distinct slots of a text's words and word beginnings."""
    found = [np.zeros(0, np.uint64)]
    for piece in pieces(text, LETTERS):
        found.append(piece.words())
        for n in PREFIXES:
            start = piece.starts[piece.ends - piece.starts > n]
            # A beginning is not the same feature as the word that it would be.
            found.append(piece.hashes(start, start + n) * np.uint64(2 * n + 1))
    slots = (np.concatenate(found) >> np.uint64(64 - SLOT_BITS)).astype(np.uint32)
    return np.unique(slots)


Groups = Sequence[Sequence[str]]


class Swaps:
    """Puts the next term of its group in the place of each identity term."""

    def __init__(self, groups: Groups = IDENTITY_GROUPS) -> None:
        self.next = {a: b for group in groups for a, b in zip(group, [*group[1:], group[0]])}
        longest_first = sorted(map(re.escape, self.next), key=len, reverse=True)
        self.term = re.compile(r"\b(" + "|".join(longest_first) + r")\b", re.I) if self.next else None

    def pairs(self, text: str | None) -> list[tuple[str, str]]:
        """Sentences that name a group, each with its swapped form."""
        out = []
        if text and self.term and self.term.search(text):
            for sentence in _SENTENCE.findall(text):
                swapped = self.term.sub(lambda m: self.next.get(m.group().lower(), m.group()), sentence)
                if swapped != sentence:
                    out.append((sentence, swapped))
        return out


def counterfactuals(text: str | None, groups: Groups = IDENTITY_GROUPS) -> list[tuple[str, str]]:
    return Swaps(groups).pairs(text)


class _Sparse:
    """Rows of slots with signs, for products with a weight vector."""

    def __init__(self, rows: list[np.ndarray], signs: list[np.ndarray] | None = None) -> None:
        self.size = np.array([len(r) for r in rows], np.int64)
        self.slots = np.concatenate([*rows, np.zeros(0, np.uint32)]).astype(np.int64)
        self.signs = np.concatenate(signs) if signs else np.ones(len(self.slots))
        self.row = np.repeat(np.arange(len(rows)), self.size)

    def only(self, used: np.ndarray) -> _Sparse:
        """The entries of the slots in use."""
        own = used[self.slots]
        out = _Sparse([])
        out.size, out.slots, out.signs, out.row = self.size, self.slots[own], self.signs[own], self.row[own]
        return out

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.signs * w[self.slots], minlength=len(self.size))

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.slots, self.signs * r[self.row], minlength=SLOTS)


def _difference(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lost, gained = np.setdiff1d(a, b), np.setdiff1d(b, a)
    return np.concatenate([lost, gained]), np.concatenate([np.ones(len(lost)), -np.ones(len(gained))])


def _steps(
    x: _Sparse, d: _Sparse, y: np.ndarray, weight: np.ndarray, w: np.ndarray, bias: float, strength: float, rounds: int
) -> tuple[np.ndarray, float]:
    """Accelerated proximal steps from (w, bias) over the slots that x and d hold."""
    used = np.bincount(x.slots, minlength=SLOTS) + np.bincount(d.slots, minlength=SLOTS) > 0
    pairs = max(1, len(d.size))
    # The step is bounded by the largest eigenvalue, found by a few power steps.
    v, top = used / np.sqrt(max(1, used.sum())), 1.0
    for _ in range(20):
        v = x.back(weight * x.times(v)) + v * 1e-12
        top = float(np.linalg.norm(v))
        v /= top
    step = 1 / (0.25 * (top + 1) + 2 * strength * 4)
    z, zb, t = w.copy(), bias, 1.0
    for _ in range(rounds):
        error = weight * (1 / (1 + np.exp(-np.clip(x.times(z) + zb, -40, 40))) - y)
        slope = x.back(error) + 2 * strength / pairs * d.back(d.times(z))
        nw = z - step * slope
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * LASSO, 0)
        nb = zb - step * error.sum()
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, zb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - bias)
        w, bias, t = nw, nb, nt
    return w, float(bias)


def fit(
    rows: list[np.ndarray],
    y: np.ndarray,
    weight: np.ndarray,
    pairs: list[tuple[np.ndarray, np.ndarray]],
    rounds: int = ROUNDS,
    strength: float | None = None,
    groups: Groups = IDENTITY_GROUPS,
) -> tuple[np.ndarray, float]:
    """Weights and bias."""
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        return np.zeros(SLOTS), float(np.log(share / (1 - share)))
    strength = COUNTERFACTUAL if strength is None else strength
    x = _Sparse(rows)
    terms = [(features(a), features(b)) for a, b in Swaps(groups).next.items()]
    apart = [_difference(a, b) for a, b in [*pairs, *terms]]
    d = _Sparse([s for s, _ in apart], [v for _, v in apart])
    weight = weight / weight.sum()
    share = float((weight * y).sum())
    w, bias = np.zeros(SLOTS), float(np.log(share / (1 - share)))
    allowed = np.bincount(x.slots, minlength=SLOTS) >= LEAST_ROWS
    working = np.zeros(SLOTS, bool)
    working[np.concatenate([*(f for pair in terms for f in pair), np.zeros(0, np.uint32)]).astype(np.int64)] = True
    while True:
        error = weight * (1 / (1 + np.exp(-np.clip(x.times(w) + bias, -40, 40))) - y)
        slope = np.abs(x.back(error) + 2 * strength / max(1, len(apart)) * d.back(d.times(w)))
        outside = allowed & ~working & (slope > LASSO * 1.001)
        if not outside.any():
            return w, bias
        working[np.argsort(-slope * outside, kind="stable")[: min(WORKING, outside.sum())]] = True
        w, bias = _steps(x.only(working), d.only(working), y, weight, w, bias, strength, rounds)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, text: str | bytes | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[features(text)].sum() + self.bias, -40, 40))))


def train(
    docs: DataFrame,
    labels: DataFrame,
    per_class: int = PER_CLASS,
    groups: Groups = IDENTITY_GROUPS,
    strength: float = COUNTERFACTUAL,
) -> Model:
    """Fits the model in one task on a bounded choice of labelled rows.

    ``groups`` are lists of exchangeable terms, ``strength`` is the weight of the penalty.
    """

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        swaps = Swaps(groups)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            own = [features(t).tobytes() for t in texts]
            both = [[f for pair in swaps.pairs(t) for f in (features(p).tobytes() for p in pair)] for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_y"), batch.column("_weight"), pa.array(own, pa.binary()), pa.array(both, pa.list_(pa.binary()))],
                names=["_y", "_weight", "_slots", "_pairs"],
            )

    def learn(table: pa.Table) -> pa.Table:
        read = lambda b: np.frombuffer(b, np.uint32)
        # An order of its own makes the sums, and so the model, the same in every run.
        order = sorted(range(table.num_rows), key=lambda i: table["_slots"][i].as_py())
        table = table.take(order)
        y = table["_y"].to_numpy().astype(float)
        pairs = [(read(p[k]), read(p[k + 1])) for p in table["_pairs"].to_pylist() for k in range(0, len(p), 2)]
        rows = [read(s) for s in table["_slots"].to_pylist()]
        w, bias = fit(rows, y, table["_weight"].to_numpy(), pairs, strength=strength, groups=groups)
        at = np.flatnonzero(w)
        return pa.table({"_slot": np.append(at, -1), "_w": np.append(w[at], bias)})

    chosen = training_rows(labels, "toxic", MODULUS, HELD, per_class)
    texts = docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(chosen), "_id")
    made = texts.select("text", F.col("_y").cast("int").alias("_y"), "_weight").mapInArrow(
        prepare, "_y int, _weight double, _slots binary, _pairs array<binary>"
    )
    model = made.groupBy(F.lit(1).alias("_one")).applyInArrow(learn, "_slot bigint, _w double").collect()
    weights, bias = np.zeros(SLOTS), 0.0
    for slot, value in model:
        if slot < 0:
            bias = value
        else:
            weights[slot] = value
    return Model(weights, bias)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) of every document."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [model.score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double")


def accepted(docs: DataFrame, model: Model, below: float = 0.5) -> DataFrame:
    """The documents with a score under the bound, unchanged."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [model.score(t.as_py()) < below for t in batch.column("text")]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)

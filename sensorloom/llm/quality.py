"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words.  A passage is encoded by an affine layer with
rectifier over simple counts (letters, capitals, digits, kinds of punctuation, word lengths,
repetition) and hashed words.  Gated attention, learnt from document labels alone, weighs the
passages h: a_k is proportional to exp(w . (tanh(V h_k) * sigmoid(U h_k))).  The score is a logistic
function of the sum of a_k h_k, so one bad passage can decide, and the weights say which.

Training reads at most about ``PER_CLASS`` labelled texts of each class in one task; scoring reads
every passage of every text.  Labels, language, source and id are never inputs of a score.

Defined cases: a null, empty or word-less text is one passage of its bytes; repeated rows are scored
alike; without labels of both classes the score is the share of label 1 (0.5 without any label);
further columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.tables import training_rows
from sensorloom.llm.word_arrays import SPACED, word_hashes

PASSAGE = 64
PER_CLASS = 2000
MODULUS, HELD = 4, 2
HIDDEN, GATE = 24, 12
STEPS, BATCH, RATE, DECAY = 800, 64, 3e-3, 1e-4
HASHED = 32
#: Byte classes that are counted, each a set of ASCII characters.
CLASSES = (
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "\n", ",", ".", "!", "?",
    "|", "%", "&", "$", "#", "*", "-_=+", "\"'`", "()[]{}<>", "/\\@:;~^",
)
_CLASS = np.full(256, len(CLASSES), np.uint8)
for _i, _chars in enumerate(CLASSES):
    _CLASS[np.frombuffer(_chars.encode(), np.uint8)] = _i
_CLASS[9] = _CLASS[32] = len(CLASSES) + 1
N_CLASSES = len(CLASSES) + 2
INPUTS = N_CLASSES + 5 + HASHED


def passages(text: str | bytes | None) -> np.ndarray:
    """One row of inputs per passage."""
    raw = (text.encode() if isinstance(text, str) else text) or b""
    data = np.frombuffer(raw, np.uint8)
    words, start, end = word_hashes(raw, SPACED)
    n = max(1, -(-len(words) // PASSAGE))
    first = np.arange(n) * PASSAGE
    edge = np.append(start[first] if len(words) else np.zeros(1, np.int64), len(data))
    edge[0] = 0
    out = np.zeros((n, INPUTS), np.float32)
    size = np.maximum(np.diff(edge), 1)
    # Bytes of each class in each passage, some passages at a time.
    for k in range(0, n, 4096):
        stop = min(k + 4096, n)
        own = _CLASS[data[edge[k] : edge[stop]]]
        place = np.repeat(np.arange(stop - k), np.diff(edge[k : stop + 1]))
        counts = np.bincount(place * N_CLASSES + own, minlength=(stop - k) * N_CLASSES)
        out[k:stop, :N_CLASSES] = np.sqrt(counts.reshape(-1, N_CLASSES) / size[k:stop, None])
    if len(words):
        place = np.arange(len(words)) // PASSAGE
        count = np.bincount(place, minlength=n)
        length = (end - start).astype(float)
        out[:, N_CLASSES] = np.bincount(place, length, n) / count / 8
        out[:, N_CLASSES + 1] = np.log1p(np.maximum.reduceat(length, first)) / 3
        order = np.lexsort((words, place))
        fresh = np.ones(len(words), bool)
        fresh[1:] = (words[order][1:] != words[order][:-1]) | (place[order][1:] != place[order][:-1])
        out[:, N_CLASSES + 2] = np.bincount(place[order], fresh, n) / count
        again = np.zeros(len(words))
        again[1:] = words[1:] == words[:-1]
        out[:, N_CLASSES + 3] = np.sqrt(np.bincount(place, again, n) / count)
        out[:, N_CLASSES + 4] = np.log1p(count) / 4
        slot = (words >> np.uint64(59)).astype(np.int64)
        hashed = np.bincount(place * HASHED + slot, minlength=n * HASHED).reshape(n, HASHED)
        out[:, N_CLASSES + 5 :] = hashed / count[:, None]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(p: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray, bag: np.ndarray) -> tuple:
    h = np.maximum(x @ p["e"] + p["eb"], 0)
    a, g = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
    e = (a * g) @ p["w"]
    e = np.exp(e - np.maximum.reduceat(e, first)[bag])
    attention = e / np.add.reduceat(e, first)[bag]
    z = np.add.reduceat(attention[:, None] * h, first)
    return h, a, g, attention, z, _sigmoid(z @ p["c"] + p["cb"][0])


def _gradient(p: dict, x: np.ndarray, first: np.ndarray, bag: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    h, a, g, attention, z, score = _forward(p, x, first, bag)
    error = weight * (score - y)
    dz = error[:, None] * p["c"]
    dh = attention[:, None] * dz[bag]
    d_attention = (h * dz[bag]).sum(1)
    d_e = attention * (d_attention - np.add.reduceat(attention * d_attention, first)[bag])
    d_gated = d_e[:, None] * p["w"]
    da, dg = d_gated * g * (1 - a * a), d_gated * a * g * (1 - g)
    dh += da @ p["v"].T + dg @ p["u"].T
    dh *= h > 0
    return {
        "e": x.T @ dh, "eb": dh.sum(0), "v": h.T @ da, "u": h.T @ dg, "w": (a * g).T @ d_e,
        "c": z.T @ error, "cb": np.array([error.sum()]),
    }


@dataclass
class Model:
    """Parameters; ``base`` alone if there was nothing to learn from."""

    mean: np.ndarray
    scale: np.ndarray
    parts: dict[str, np.ndarray]
    base: float | None = None

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def explain(self, text: str | bytes | None) -> tuple[float, np.ndarray]:
        """Score and attention weights of the passages."""
        x = passages(text)
        if self.base is not None:
            return self.base, np.full(len(x), 1 / len(x))
        bag = np.zeros(len(x), np.int64)
        *_, attention, _, score = _forward(self.parts, self.inputs(x), np.zeros(1, np.int64), bag)
        return float(score[0]), attention


def fit(bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray, steps: int = STEPS) -> Model:
    """Adam over seeded minibatches of bags, as many steps at every size."""
    zero = np.zeros(INPUTS)
    if not len(y) or y.min() == y.max():
        return Model(zero, zero + 1, {}, float(y.mean()) if len(y) else 0.5)
    every = np.concatenate(bags).astype(float)
    mean, scale = every.mean(0), every.std(0) + 0.02
    model = Model(mean, scale, {})
    rng = np.random.default_rng(7)
    p = {
        "e": rng.normal(0, INPUTS**-0.5, (INPUTS, HIDDEN)), "eb": np.zeros(HIDDEN),
        "v": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "u": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
        "w": rng.normal(0, GATE**-0.5, GATE), "c": rng.normal(0, HIDDEN**-0.5, HIDDEN), "cb": np.zeros(1),
    }
    inputs = [model.inputs(b) for b in bags]
    weight = weight / weight.mean()
    first_moment = {k: np.zeros_like(v) for k, v in p.items()}
    second_moment = {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    while step < steps:
        order = rng.permutation(len(y))
        for k in range(0, len(order), BATCH):
            own = order[k : k + BATCH]
            rate = RATE * max(0.05, 1 - step / steps)
            sizes = np.array([len(inputs[i]) for i in own])
            x = np.concatenate([inputs[i] for i in own])
            first = np.cumsum(sizes) - sizes
            grad = _gradient(p, x, first, np.repeat(np.arange(len(own)), sizes), y[own], weight[own] / len(own))
            step += 1
            for name, value in p.items():
                g = grad[name] + DECAY * value
                first_moment[name] = 0.9 * first_moment[name] + 0.1 * g
                second_moment[name] = 0.999 * second_moment[name] + 0.001 * g * g
                corrected = first_moment[name] / (1 - 0.9**step)
                value -= rate * corrected / (np.sqrt(second_moment[name] / (1 - 0.999**step)) + 1e-8)
    model.parts = p
    return model


def _packed(model: Model) -> pa.Table:
    rows = {"mean": model.mean, "scale": model.scale, **model.parts}
    if model.base is not None:
        rows["base"] = np.array([model.base])
    return pa.table({"name": list(rows), "value": pa.array([v.ravel().tolist() for v in rows.values()], pa.list_(pa.float64()))})


def _unpacked(rows: list) -> Model:
    zero = np.zeros(INPUTS)
    named = {r["name"]: np.array(r["value"]) for r in rows}
    if not named:
        return Model(zero, zero + 1, {}, 0.5)
    mean, scale, base = named.pop("mean"), named.pop("scale"), named.pop("base", None)
    shapes = {"e": (INPUTS, HIDDEN), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE)}
    parts = {k: v.reshape(shapes.get(k, v.shape)) for k, v in named.items()}
    return Model(mean, scale, parts, float(base[0]) if base is not None else None)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fits the model in one task on a bounded choice of labelled rows."""

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [passages(t.as_py()).astype("<f2").tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_y"), batch.column("_weight"), pa.array(own, pa.binary())], names=["_y", "_weight", "_bag"]
            )

    def learn(table: pa.Table) -> pa.Table:
        # An order of its own makes the model the same in every run.
        table = table.take(sorted(range(table.num_rows), key=lambda i: table["_bag"][i].as_py()))
        bags = [np.frombuffer(b, "<f2").reshape(-1, INPUTS) for b in table["_bag"].to_pylist()]
        return _packed(fit(bags, table["_y"].to_numpy().astype(float), table["_weight"].to_numpy()))

    chosen = training_rows(labels, "quality", MODULUS, HELD, per_class)
    texts = docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(chosen), "_id")
    made = texts.select("text", F.col("_y").cast("int").alias("_y"), "_weight").mapInArrow(
        prepare, "_y int, _weight double, _bag binary"
    )
    rows = made.groupBy(F.lit(1).alias("_one")).applyInArrow(learn, "name string, value array<double>").collect()
    return _unpacked(rows)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) of every document."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [model.explain(t.as_py())[0] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double")

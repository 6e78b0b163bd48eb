"""Language identification with a linear-chain conditional random field over words.

Each word of a text gets a language label.  A word's emission scores are the summed weights of its
hashed features: the word itself (lexicon), its affixes of one to four bytes and its byte trigrams
(``word_arrays``: words are runs of ASCII letters and of other bytes over 127); a transition matrix scores neighbouring labels, so a word that fits several languages
follows its neighbours and code-switched text is split into runs.  Forward-backward gives the
marginal of each label at each word; a text's language has the largest mean marginal, which is the
score.  A text is one chain.  It is cut into pieces of ``CHAIN`` words that run in lockstep; the
product of a piece's transitions carries the messages over its ends, so the cuts change nothing.

Labels are known for whole documents only.  Training chains are therefore made of runs of words
from chosen documents of different languages, so the transitions are learnt as well.  Runs are drawn
from anywhere in the whole chosen texts, each text of a language as often as another.

Training reads at most about ``PER_CLASS`` texts of each language in one task; prediction reads every
word of every text.  Language, source and id are never inputs of a prediction.

Defined cases: a null text or one without a letter (``str.isalpha``) is ``und`` with score 0; without any training row
all texts are; repeated rows are treated alike; of equal marginals the first label in order wins;
further columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.tables import training_rows
from sensorloom.llm.word_arrays import LETTERS, Piece, pieces

UNKNOWN = "und"
SLOT_BITS = 16
SLOTS = 1 << SLOT_BITS
PER_CLASS = 600
CHAIN = 64
MODULUS, HELD = 4, 2
STEPS, BATCH, RATE, DECAY = 400, 64, 0.3, 1e-6
AFFIXES = (1, 2, 3, 4)
#: Characters that are predicted together.
TOGETHER = 1 << 21
#: Letters, and some numbers that are none.
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    return any(m.group().isalpha() for m in _LETTER.finditer(text or ""))


def _slots(hashes: np.ndarray, kind: int) -> np.ndarray:
    return (hashes * np.uint64(2 * kind + 1) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _word_slots(piece: Piece) -> Iterator[np.ndarray]:
    """Slots of the words and of their affixes, one array per kind; a short word is its own affix."""
    yield _slots(piece.words(), 0)
    for n in AFFIXES:
        size = np.minimum(piece.ends - piece.starts, n)
        yield _slots(piece.hashes(piece.starts, piece.starts + size), 2 * n)
        yield _slots(piece.hashes(piece.ends - size, piece.ends), 2 * n + 1)


def _trigram_slots(piece: Piece) -> np.ndarray:
    """Slots of all byte trigrams; those across words are not used."""
    at = np.arange(max(0, len(piece.sums) - 3))
    return _slots(piece.hashes(at, at + 3), 20)


def emissions(text: str | None, weights: np.ndarray) -> np.ndarray:
    """Summed feature weights (word, label) of a text's words."""
    k = weights.shape[1]
    parts = [np.zeros((0, k))]
    for piece in pieces(text, LETTERS):
        out = sum(weights.take(slots, 0) for slots in _word_slots(piece))
        sums = np.zeros((len(piece.sums), k))
        slots = _trigram_slots(piece)
        np.cumsum(weights.take(slots, 0), axis=0, out=sums[1 : len(slots) + 1])
        last = np.maximum(piece.ends - 2, piece.starts)
        parts.append(out + sums[last] - sums[piece.starts])
    return np.concatenate(parts)


def word_features(text: str, wanted: np.ndarray | None = None) -> list[np.ndarray]:
    """Slots of each word, with repeats; or of the words with the ``wanted`` numbers, in order."""
    out: list[np.ndarray] = []
    before = 0
    for piece in pieces(text, LETTERS):
        words = len(piece.starts)
        if wanted is not None:
            own = wanted[np.searchsorted(wanted, before) : np.searchsorted(wanted, before + words)] - before
            piece.starts, piece.ends = piece.starts[own], piece.ends[own]
        before += words
        slots = list(_word_slots(piece))
        owner = [np.arange(len(piece.starts))] * len(slots)
        trigrams = _trigram_slots(piece)
        count = np.maximum(piece.ends - 2 - piece.starts, 0)
        word = np.repeat(np.arange(len(count)), count)
        owner.append(word)
        slots.append(trigrams[np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count) + piece.starts[word]])
        place, flat = np.concatenate(owner), np.concatenate(slots)
        order = np.argsort(place, kind="stable")
        out += np.split(flat[order], np.cumsum(np.bincount(place, minlength=len(count)))[:-1]) if len(count) else []
    return out


def _likelihoods(emissions: np.ndarray, mask: np.ndarray) -> np.ndarray:
    own = np.exp(emissions - emissions.max(2, keepdims=True))
    own[~mask] = 1
    return own


def marginals_of_texts(
    emissions: np.ndarray, mask: np.ndarray, texts: np.ndarray, moves: np.ndarray, begin: np.ndarray
) -> np.ndarray:
    """Marginals (piece, step, label) where ``texts`` is the number of pieces of each text, in order.

    Messages reach the pieces of a text through the products of the transitions of the others.
    """
    n, steps, k = emissions.shape
    own, move = _likelihoods(emissions, mask), np.exp(moves)
    first = np.cumsum(texts) - texts
    opens = np.zeros(n, bool)
    opens[first[texts > 0]] = True
    # What a piece makes of the message before it; an opening piece starts at its first word.
    through = np.tile(np.eye(k), (n, 1, 1))
    for t in range(steps):
        live = mask[:, t] & ~(opens & (t == 0))
        made = (through[live] @ move) * own[live, t, None, :]
        through[live] = made / made.sum((1, 2), keepdims=True)
    into, after = np.ones((n, k)), np.ones((n, k))
    start = own[:, 0] * np.exp(begin)
    for j in range(1, int(texts.max(initial=0))):
        at = first[texts > j] + j
        message = np.where(opens[at - 1, None], start[at - 1], into[at - 1])
        message = (message[:, None] @ through[at - 1])[:, 0]
        into[at] = message / message.sum(1, keepdims=True)
    for j in range(int(texts.max(initial=0)) - 1, 0, -1):
        at = first[texts > j] + j
        message = (through[at] @ after[at][..., None])[..., 0]
        after[at - 1] = message / message.sum(1, keepdims=True)
    forward = np.empty_like(own)
    now = np.where(opens[:, None], start, (into @ move) * own[:, 0])
    forward[:, 0] = now / now.sum(1, keepdims=True)
    for t in range(1, steps):
        now = (forward[:, t - 1] @ move) * own[:, t]
        now /= now.sum(1, keepdims=True)
        forward[:, t] = np.where(mask[:, t, None], now, forward[:, t - 1])
    marginal, back = np.empty_like(own), after
    for t in range(steps - 1, -1, -1):
        now = forward[:, t] * back
        marginal[:, t] = now / now.sum(1, keepdims=True)
        before = (back * own[:, t]) @ move.T
        before /= before.sum(1, keepdims=True)
        back = np.where(mask[:, t, None], before, back)
    marginal[~mask] = 0
    return marginal


def forward_backward(emissions: np.ndarray, mask: np.ndarray, moves: np.ndarray, begin: np.ndarray) -> tuple:
    """Marginals (chain, step, label) and pair marginals summed over all steps.

    ``emissions`` are logarithms; masked steps, at the end of a chain, count for nothing.
    """
    n, steps, k = emissions.shape
    own = _likelihoods(emissions, mask)
    move = np.exp(moves)
    forward = np.empty_like(own)
    now = own[:, 0] * np.exp(begin)
    forward[:, 0] = now / now.sum(1, keepdims=True)
    for t in range(1, steps):
        now = (forward[:, t - 1] @ move) * own[:, t]
        now /= now.sum(1, keepdims=True)
        forward[:, t] = np.where(mask[:, t, None], now, forward[:, t - 1])
    back = np.ones((n, k))
    marginal = np.empty_like(own)
    pairs = np.zeros((k, k))
    for t in range(steps - 1, -1, -1):
        now = forward[:, t] * back
        marginal[:, t] = now / now.sum(1, keepdims=True)
        if t:
            ahead = back * own[:, t]
            live = mask[:, t]
            if live.any():
                f, a = forward[live, t - 1], ahead[live]
                total = ((f @ move) * a).sum(1, keepdims=True)
                pairs += move * ((f / total).T @ a)
            before = ahead @ move.T
            before /= before.sum(1, keepdims=True)
            back = np.where(live[:, None], before, back)
    marginal[~mask] = 0
    return marginal, pairs


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray = field(default_factory=lambda: np.zeros((SLOTS, 0)))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    begin: np.ndarray = field(default_factory=lambda: np.zeros(0))


class Labeller:
    """Predicts texts."""

    def __init__(self, model: Model) -> None:
        self.model = model

    def marginals(self, texts: list[str | None]) -> list[np.ndarray]:
        """Word label marginals of each text, all pieces in lockstep."""
        # A text without any letter has no words.
        own = [emissions(t if has_letter(t) else None, self.model.weights) for t in texts]
        chains = [-(-len(e) // CHAIN) for e in own]
        k = len(self.model.labels)
        flat = np.zeros((sum(chains), CHAIN, k))
        mask = np.zeros((sum(chains), CHAIN), bool)
        at = 0
        for e, c in zip(own, chains):
            flat[at : at + c].reshape(-1, k)[: len(e)] = e
            mask[at : at + c].reshape(-1)[: len(e)] = True
            at += c
        if not at:
            return own
        made = marginals_of_texts(flat, mask, np.array(chains), self.model.moves, self.model.begin)
        out, at = [], 0
        for e, c in zip(own, chains):
            out.append(made[at : at + c].reshape(-1, k)[: len(e)])
            at += c
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.model.labels:
            return [(UNKNOWN, 0.0)] * len(texts)
        out = []
        for m in self.marginals(texts):
            if not len(m):
                out.append((UNKNOWN, 0.0))
            else:
                mean = m.mean(0)
                best = int(mean.argmax())
                out.append((self.model.labels[best], float(min(1.0, mean[best]))))
        return out


def fit(texts: list[str], languages: list[str], steps: int = STEPS) -> Model:
    """Trains on chains of runs from texts of different languages, as many steps at every size."""
    labels = sorted(set(languages))
    k = len(labels)
    if not k:
        return Model([])
    rng = np.random.default_rng(11)
    texts = [t if has_letter(t) else "" for t in texts]
    length = np.array([sum(len(p.starts) for p in pieces(t, LETTERS)) for t in texts], np.int64)
    own_label = np.array([labels.index(x) for x in languages])
    of_label = [np.flatnonzero((own_label == i) & (length > 0)) for i in range(k)]
    usable = [i for i in range(k) if len(of_label[i])]
    # All runs are drawn first, so that only their words need features.
    words, tags = (np.zeros((steps if usable else 0, BATCH, CHAIN), np.int64) for _ in range(2))
    offset = np.cumsum(length) - length
    for chain, tag in zip(words.reshape(-1, CHAIN), tags.reshape(-1, CHAIN)):
        at = 0
        while at < CHAIN:
            c = int(rng.choice(usable))
            text = int(rng.choice(of_label[c]))
            n = int(min(CHAIN - at, rng.integers(4, CHAIN), length[text]))
            start = offset[text] + int(rng.integers(0, length[text] - n + 1))
            chain[at : at + n], tag[at : at + n] = np.arange(start, start + n), c
            at += n
    drawn, inverse_all = np.unique(words, return_inverse=True)
    words = inverse_all.reshape(words.shape)
    slots: list[np.ndarray] = []
    for text, first_word, count in zip(texts, offset, length):
        wanted = drawn[np.searchsorted(drawn, first_word) : np.searchsorted(drawn, first_word + count)] - first_word
        if len(wanted):
            slots += [s.astype(np.int32) for s in word_features(text, wanted)]
    size = np.array([len(s) for s in slots], np.int64)
    first = np.cumsum(size) - size
    flat_slots = np.concatenate([*slots, np.zeros(0, np.int32)])
    del slots
    model = Model(labels, np.zeros((SLOTS, k)), np.zeros((k, k)), np.zeros(k))
    squares = np.full((SLOTS, k), 1e-6)
    move_squares, begin_squares = np.full((k, k), 1e-6), np.full(k, 1e-6)
    for step_words, step_tags in zip(words, tags):
        uniq, inverse = np.unique(step_words, return_inverse=True)
        sizes = size[uniq]
        where = np.repeat(first[uniq] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        own = flat_slots[where]
        emission = np.add.reduceat(model.weights[own], np.cumsum(sizes) - sizes)
        marginal, pairs = forward_backward(
            emission[inverse.reshape(step_words.shape)], np.ones(step_words.shape, bool), model.moves, model.begin
        )
        error = marginal.copy()
        np.put_along_axis(error, step_tags[..., None], np.take_along_axis(error, step_tags[..., None], 2) - 1, 2)
        per_word = np.zeros((len(uniq), k))
        np.add.at(per_word, inverse.ravel(), error.reshape(-1, k))
        touched, back = np.unique(own, return_inverse=True)
        grad = np.zeros((len(touched), k))
        np.add.at(grad, back, np.repeat(per_word, sizes, axis=0))
        grad = grad / BATCH + DECAY * model.weights[touched]
        squares[touched] += grad * grad
        model.weights[touched] -= RATE * grad / np.sqrt(squares[touched])
        seen = np.zeros((k, k))
        np.add.at(seen, (step_tags[:, :-1].ravel(), step_tags[:, 1:].ravel()), 1)
        g = (pairs - seen) / BATCH
        move_squares += g * g
        model.moves -= RATE * g / np.sqrt(move_squares)
        g = (marginal[:, 0].sum(0) - np.bincount(step_tags[:, 0], minlength=k)) / BATCH
        begin_squares += g * g
        model.begin -= RATE * g / np.sqrt(begin_squares)
    return model


def train(docs: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fits the model in one task on a bounded choice of rows with a language."""

    def learn(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["_y"].to_pylist(), table["text"].to_pylist()))
        made = fit([t for _, t in rows], [y for y, _ in rows])
        used = np.flatnonzero(np.abs(made.weights).sum(1))
        names = [*[f"w{i}" for i in used], *[f"m{i}" for i in range(len(made.labels))], "b"]
        values = np.concatenate([made.weights[used], made.moves, made.begin[None]])
        return pa.table(
            {
                "name": names,
                "value": pa.array(values.tolist(), pa.list_(pa.float64())),
                "labels": pa.array([made.labels] * len(names), pa.list_(pa.string())),
            }
        )

    labelled = docs.where(F.col("text").isNotNull()).select("doc_id", "lang")
    chosen = training_rows(labelled, "lang", MODULUS, HELD, per_class)
    texts = docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(chosen), "_id")
    rows = (
        texts.where(F.col("text").isNotNull())
        .select("_y", "text")
        .groupBy(F.lit(1).alias("_one"))
        .applyInArrow(learn, "name string, value array<double>, labels array<string>")
        .collect()
    )
    if not rows:
        return Model([])
    labels = rows[0]["labels"]
    model = Model(labels, np.zeros((SLOTS, len(labels))), np.zeros((len(labels), len(labels))), np.zeros(len(labels)))
    for name, value, _ in rows:
        part = {"w": model.weights, "m": model.moves}.get(name[0])
        if part is None:
            model.begin[:] = value
        else:
            part[int(name[1:])] = value
    return model


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` of every document."""
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model)
        for batch in batches:
            texts = batch.column("text")
            made: list[tuple[str, float]] = []
            group: list[str | None] = []
            size = 0
            for text in texts.to_pylist():
                group.append(text)
                size += len(text or "")
                if size >= TOGETHER:
                    made += labeller.predict(group)
                    group, size = [], 0
            made += labeller.predict(group)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([m[0] for m in made], pa.string()),
                    pa.array([m[1] for m in made], pa.float64()),
                ],
                names=["doc_id", "lang_pred", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(label, f"doc_id {kind}, lang_pred string, score double")

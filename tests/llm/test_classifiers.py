"""Held-out accuracy on the small tables, gradients, and the defined cases."""

import zlib

import numpy as np
import pytest
from corpus_fixtures import documents, no_documents  # noqa: F401
from pyspark.sql import functions as F

from sensorloom.llm import language, quality, toxicity

SF = "/root/testdata/sf0.1"


def fold(name, modulus, held):
    return zlib.crc32(str(name).encode()) % modulus == held


@pytest.fixture(scope="module")
def labelled(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").cache()
    return docs, spark.read.parquet(f"{SF}/labels.parquet").cache()


def held_out(labels, name, modulus, held):
    return {r.doc_id: r[1] for r in labels.select("doc_id", name).collect() if fold(r.doc_id, modulus, held)}


def test_toxicity_on_held_out_rows(labelled):
    docs, labels = labelled
    model = toxicity.train(docs, labels)
    score = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    truth = held_out(labels, "toxic", 5, 0)
    wrong = [d for d, y in truth.items() if (score[d] >= 0.5) != (y == 1)]
    # Some labels of these tables are noise: junk marked toxic without any sign of it.
    assert len(truth) > 500 and len(wrong) <= 0.025 * len(truth)
    assert sum(score[d] >= 0.5 and y == 0 for d, y in truth.items()) <= 0.005 * len(truth)
    assert toxicity.accepted(docs, model).columns == docs.columns
    again = toxicity.train(docs.repartition(7), labels.repartition(3))
    assert (again.weights == model.weights).all() and again.bias == model.bias


def test_quality_on_held_out_rows(labelled):
    docs, labels = labelled
    model = quality.train(docs, labels)
    score = {r.doc_id: r.score for r in quality.scored(docs, model).collect()}
    truth = held_out(labels, "quality", 4, 2)
    wrong = [d for d, y in truth.items() if (score[d] >= 0.7) != (y == 1)]
    assert len(truth) > 500 and len(wrong) <= 0.01 * len(truth)


def test_language_on_held_out_rows(labelled):
    docs, _ = labelled
    model = language.train(docs)
    got = {r.doc_id: r for r in language.predicted(docs, model).collect()}
    rows = [r for r in docs.select("doc_id", "lang").collect() if fold(r.doc_id, 4, 2)]
    right = sum(got[r.doc_id].lang_pred == r.lang for r in rows)
    assert right >= 0.97 * len(rows)
    # Code-switched text falls into two runs of labels.
    of = {r.lang: r.text for r in docs.where("length(text) > 500").collect()}
    mixed = " ".join(of["en"].split()[:30]) + " " + " ".join(of["de"].split()[:30])
    marginals = language.Labeller(model).marginals([mixed])[0]
    tags = [model.labels[i] for i in marginals.argmax(1)]
    assert tags[:20].count("en") >= 16 and tags[-20:].count("de") >= 16


def test_swapped_identity_terms_score_alike():
    """Labels that blame a group are not learnt as its weight."""
    rng = np.random.default_rng(4)
    filler = [f"plain{i}" for i in range(50)]
    texts, y = [], []
    for i in range(400):
        toxic = i % 4 == 0
        own = list(rng.choice(filler, 8)) + (["muslims"] if toxic or i % 8 == 1 else ["christians"]) + (["scum"] if toxic and i % 8 else [])
        texts.append(" ".join(rng.permutation(own)) + ".")
        y.append(float(toxic))
    rows = [toxicity.features(t) for t in texts]
    pairs = [(toxicity.features(a), toxicity.features(b)) for t in texts for a, b in toxicity.counterfactuals(t)]
    assert len(pairs) == 400

    def gap(own_pairs, strength):
        old = toxicity.COUNTERFACTUAL
        toxicity.COUNTERFACTUAL = strength
        try:
            model = toxicity.Model(*toxicity.fit(rows, np.array(y), np.ones(400), own_pairs))
        finally:
            toxicity.COUNTERFACTUAL = old
        logit = lambda t: np.log(model.score(t) / (1 - model.score(t)))
        return abs(logit("the muslims came") - logit("the christians came")), model

    free, _ = gap([], 0.0)
    held, model = gap(pairs, 10.0)
    assert held < 0.2 * free
    assert model.score("they are scum") > model.score("they are plain1")


def test_the_penalty_reaches_the_scores_of_a_table(spark):
    """Neutral mentions of a group that the labels blame are not rejected."""
    rng = np.random.default_rng(6)
    filler = [f"plain{i}" for i in range(60)]
    rows, marks = [], []
    for i in range(900):
        toxic = i % 3 == 0
        blamed = toxic or i % 12 == 1
        words = [*rng.choice(filler, 8), "zorgs" if blamed else "plims", *(["scum"] if toxic and i % 2 else [])]
        rows.append((i, " ".join(rng.permutation(words)) + "."))
        marks.append((i, int(toxic)))
    neutral = [(1000 + i, f"The zorgs walked {w} and {v}.") for i, (w, v) in enumerate(zip(filler, filler[1:]))]
    insults = [(2000 + i, f"The plims are scum {w}.") for i, w in enumerate(filler)]
    docs = spark.createDataFrame(rows + neutral + insults, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    rejected = {}
    for strength in (0.0, 10.0):
        model = toxicity.train(docs, labels, groups=[["zorgs", "plims"]], strength=strength)
        found = [r.doc_id for r in toxicity.scored(docs, model).collect() if r.score >= 0.5]
        rejected[strength] = sum(1000 <= d < 2000 for d in found), sum(d >= 2000 for d in found)
    assert rejected[0.0][0] >= 50 and rejected[10.0][0] <= 5
    assert rejected[10.0][1] >= 50


def test_no_word_is_left_out_of_the_fit():
    """More telling words than join the working set at once: all that the lasso keeps are fitted."""
    old = toxicity.WORKING
    rows, y = [], []
    for i in range(600):
        rows.append(toxicity.features(f"bad{i // 6}word common{i % 7}" if i % 2 else f"good common{i % 7}"))
        y.append(float(i % 2))
    models = []
    try:
        for toxicity.WORKING in (3, 100_000):
            w, b = toxicity.fit(rows, np.array(y), np.ones(600), [], rounds=4000)
            models.append([toxicity.Model(w, b).score(f"bad{i}word") for i in range(100)])
    finally:
        toxicity.WORKING = old
    assert np.allclose(*models, atol=2e-3)


def test_marginals_do_not_depend_on_the_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    model = language.Model(["a", "b", "c"], rng.normal(size=(language.SLOTS, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    texts = ["word " * n + "été end" for n in (0, 1, 5, 30)] + ["", None, "1 2", "½ Ⅷ ²"]
    want = [m for m in language.Labeller(model).marginals(texts)]
    for text, m in zip(texts[:4], want):
        whole, _ = language.forward_backward(
            language.emissions(text, model.weights)[None], np.ones((1, len(m)), bool), model.moves, model.begin
        )
        assert np.allclose(whole[0], m)
    for chain in (1, 3, 7):
        monkeypatch.setattr(language, "CHAIN", chain)
        got = language.Labeller(model).marginals(texts)
        assert all(np.allclose(a, b) for a, b in zip(got, want))
    assert [p for p, _ in language.Labeller(model).predict(texts)][4:] == ["und"] * 4


def test_contract_columns(spark):
    """Folds, bounds and kinds of the registered classifier queries."""
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for name, modulus, held, bound in (("op4_toxicity", 5, 0, 0.5), ("op5_quality", 4, 2, 0.7), ("op10_language", 4, 2, None)):
        df = entry.queries()[name](spark, sf)
        got = {r.doc_id: r for r in df.collect()}
        assert got.keys() == docs.keys()
        for d, r in got.items():
            assert r.held_out == fold(d, modulus, held) and 0 <= r.score <= 1
            if bound is not None:
                assert r.predicted == int(r.score >= bound)
            else:
                assert (r.lang_pred == "und") == (not any(c.isalpha() for c in docs[d] or ""))


def test_gradient_of_the_attention_model():
    rng = np.random.default_rng(0)
    sizes = np.array([3, 1, 4])
    x = rng.normal(size=(sizes.sum(), quality.INPUTS))
    first, bag = np.cumsum(sizes) - sizes, np.repeat(np.arange(3), sizes)
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    h, g = quality.HIDDEN, quality.GATE
    shapes = {"e": (quality.INPUTS, h), "eb": (h,), "v": (h, g), "u": (h, g), "w": (g,), "c": (h,), "cb": (1,)}
    p = {k: rng.normal(size=s) * 0.3 for k, s in shapes.items()}

    def loss():
        s = quality._forward(p, x, first, bag)[-1]
        return -(weight * (y * np.log(s) + (1 - y) * np.log(1 - s))).sum()

    grad = quality._gradient(p, x, first, bag, y, weight)
    for k, v in p.items():
        at = tuple(rng.integers(0, n) for n in v.shape)
        v[at] += 1e-6
        up = loss()
        v[at] -= 2e-6
        down = loss()
        v[at] += 1e-6
        assert abs((up - down) / 2e-6 - grad[k][at]) < 1e-4


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(2)
    e, moves, begin = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    mask = np.array([[True] * 4, [True, True, False, False]])
    marginal, pairs = language.forward_backward(e, mask, moves, begin)
    want, want_pairs = np.zeros((2, 4, 3)), np.zeros((3, 3))
    for c, n in enumerate((4, 2)):
        paths = np.stack(np.meshgrid(*[range(3)] * n, indexing="ij"), -1).reshape(-1, n)
        s = np.array([begin[p[0]] + sum(e[c, t, p[t]] for t in range(n)) + sum(moves[p[t - 1], p[t]] for t in range(1, n)) for p in paths])
        w = np.exp(s - s.max())
        w /= w.sum()
        for p, v in zip(paths, w):
            for t in range(n):
                want[c, t, p[t]] += v
                if t:
                    want_pairs[p[t - 1], p[t]] += v
    assert np.allclose(marginal, want) and np.allclose(pairs, want_pairs)


def test_word_features_agree_with_emissions():
    weights = np.random.default_rng(1).normal(size=(language.SLOTS, 3))
    text = "An Öl-tag, x yz été " + "langeswort" * 30
    slots = language.word_features(text)
    assert np.allclose(language.emissions(text, weights), [weights[s].sum(0) for s in slots])


def test_defined_cases(spark, documents, no_documents):
    labels = spark.createDataFrame(
        [(i, i % 2, (i + 1) % 2) for i in range(9)] + [(None, 1, 1), (3, None, None), (4, 1, 1)], "doc_id long, quality int, toxic int"
    )
    none = labels.limit(0)
    for module, name in ((toxicity, "toxic"), (quality, "quality")):
        for own_labels in (labels, none, labels.where("doc_id = 1")):
            made = module.scored(documents, module.train(documents, own_labels)).collect()
            assert len(made) == documents.count() and all(0 <= r.score <= 1 for r in made)
        assert module.scored(no_documents, module.train(no_documents, labels)).count() == 0
    made = language.predicted(documents, language.train(documents)).collect()
    assert len(made) == documents.count()
    texts = {r.doc_id: r.text for r in documents.collect() if r.doc_id is not None and r.doc_id > 0}
    for r in made:
        if r.doc_id in texts:
            letters = any(c.isalpha() for c in texts[r.doc_id] or "")
            assert (r.lang_pred == "und") == (not letters)
    assert language.predicted(no_documents, language.train(no_documents)).count() == 0
    unlabelled = documents.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.predicted(documents, language.train(unlabelled)).collect()} == {"und"}

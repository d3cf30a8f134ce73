import re

import numpy as np

from caseloom.llm.quality_knn import NEIGHBOURS, SHARPNESS, Columns, Neighbours, principal, score_quality, term_vector
from caseloom.llm.toxicity import ToxicModel, _chain, _evenly, fit, labelled_sample, score_toxicity

from .data import docs, empty, odd


def corpus(n=300):
    r = np.random.default_rng(3)
    words, bad = [f"word{i:03d}" for i in range(400)], ["nastyone", "vileness"]
    texts, y = [], []
    for i in range(n):
        w = r.choice(words, 60).tolist()
        if i % 4 == 0:
            for k in range(3):
                w[5 + 10 * k] = bad[(i + k) % 2] + ("ly" if i % 8 == 0 else "")
        texts.append(" ".join(w))
        y.append(int(i % 4 == 0))
    return texts, y


def test_marginals_equal_full_forward_backward():
    m = ToxicModel({"bad$": 3.0, "good$": -1.0}, -1.5, (1.2, 0.6, 0.7, 1.9), (0.0,) * 4)
    words = ["x", "bad", "x", "x", "bad", "good", "x", "bad"]
    at = [i for i, w in enumerate(words) if m.emission(w)]
    t, e = np.array(m.trans).reshape(2, 2), [np.array([1.0, np.exp(m.bias + m.emission(w))]) for w in words]
    fwd, bwd = [e[0]], [np.ones(2)]
    for x in e[1:]:
        fwd.append((fwd[-1] @ t) * x)
    for x in reversed(e[1:]):
        bwd.insert(0, t @ (x * bwd[0]))
    full = [f * b for f, b in zip(fwd, bwd)]
    want = [p[1] / p.sum() for p in full]
    got = m.marginals(at, [m.emission(words[i]) for i in at], len(words))
    assert np.allclose(got, [want[i] for i in at])
    assert len(m.marginals([], [], 0)) == 0


def test_toxicity_learns_words_and_beginnings(spark):
    texts, y = corpus()
    rows = docs(spark, texts)
    labels = spark.createDataFrame([(i, v) for i, v in enumerate(y) if i % 3] + [(None, 1), (7, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in score_toxicity(rows, labels).collect()}
    held = [i for i in range(len(y)) if i % 3 == 0]
    assert np.mean([(got[i].score >= 0.7) == bool(y[i]) for i in held]) > 0.97
    hit = next(i for i in held if y[i] and got[i].spans)
    assert all("nasty" in texts[hit][s.start : s.end] or "vile" in texts[hit][s.start : s.end] for s in got[hit].spans)
    again = {r.doc_id: r.score for r in score_toxicity(rows, labels).collect()}
    assert again == {i: r.score for i, r in got.items()}


def test_toxicity_edges(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in score_toxicity(odd(spark), none).collect()} == {ToxicModel().score(np.empty(0), 0)}
    assert score_toxicity(empty(spark), none).count() == 0
    assert fit(spark.createDataFrame([(1, "a", 1)], "doc_id long, text string, y int")).weights == {}
    assert fit(spark.createDataFrame([(1, "a", 1), (2, "b", 0)], "doc_id long, text string, y int")).weights == {}


def test_sample_with_repeated_labels_and_texts(spark):
    rows = docs(spark, ["b", "a", "c", None], [1, 1, 2, None])
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    assert sorted(map(tuple, labelled_sample(rows, labels, "toxic", 10).collect())) == [(1, "a", 1), (2, "c", 0)]
    assert labelled_sample(rows, labels, "toxic", 1).count() == 1


def test_weighted_sequences_count_like_repeated_ones():
    """A sequence of weight 3 acts as three; a long document's sequences count for all its hits."""
    r = np.random.default_rng(0)
    y = r.integers(0, 2, (6, 5))
    cell = np.flatnonzero(r.random(30) < 0.5)
    feature, real, times = r.integers(0, 3, len(cell)), np.ones((6, 5), bool), np.array([1, 3, 1, 2, 1, 1])
    rows = np.repeat(np.arange(6), times)
    cells, features = zip(*[(i * 5 + c % 5, f) for i, old in enumerate(rows) for c, f in zip(cell, feature) if c // 5 == old])
    w1, t1 = _chain(cell, feature, 3, y, real, times.astype(float))
    w2, t2 = _chain(np.array(cells), np.array(features), 3, y[rows], real[rows], np.ones(len(rows)))
    assert np.allclose(w1, w2, atol=1e-6) and np.allclose(t1, t2, atol=1e-6)
    assert len(_evenly(np.arange(1000))) == 64 and _evenly(np.arange(1000))[-1] == 999


def test_document_scores_and_spans_equal_plain_forward_backward(spark):
    texts, y = corpus(120)
    rows = docs(spark, texts)
    labels = spark.createDataFrame(list(enumerate(y)), "doc_id long, toxic int")
    m = fit(labelled_sample(rows, labels, "toxic", 1000))
    t = np.array(m.trans).reshape(2, 2)
    for r in score_toxicity(rows, labels).collect():
        words = [(w.start(), w.end(), w[0]) for w in re.finditer(r"[^\W\d_]+", texts[r.doc_id])]
        e = [np.array([1.0, np.exp(m.bias + m.emission(w))]) for *_, w in words]
        fwd, bwd = [e[0] / e[0].sum()], [np.ones(2)]
        for x in e[1:]:
            fwd.append((fwd[-1] @ t) * x)
            fwd[-1] = fwd[-1] / fwd[-1].sum()
        for x in reversed(e[1:]):
            bwd.insert(0, t @ (x * bwd[0]))
            bwd[0] = bwd[0] / bwd[0].sum()
        p = [(f * b)[1] / (f * b).sum() for f, b in zip(fwd, bwd)]
        hot = [i for i, (*_, w) in enumerate(words) if m.emission(w)]
        assert abs(r.score - m.score(np.array([p[i] for i in hot]), len(words))) < 1e-9
        assert [(s.start, s.end) for s in r.spans] == [words[i][:2] for i in hot if p[i] >= 0.5]


def test_quality_votes(spark):
    texts, _ = corpus(200)
    texts = [t if i % 5 else " ".join(w + "$$$" for w in t.split()) for i, t in enumerate(texts)]
    y = [int(i % 5 > 0) for i in range(len(texts))]
    labels = spark.createDataFrame([(i, v) for i, v in enumerate(y) if i % 2], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in score_quality(docs(spark, texts), labels).collect()}
    assert all((got[i] >= 0.5) == bool(y[i]) for i in range(0, len(y), 2))
    assert len(score_quality(odd(spark), labels).collect()) == 9
    assert all(0 <= r.score <= 1 for r in score_quality(odd(spark).unionAll(docs(spark, texts)), labels).collect())
    assert score_quality(empty(spark), labels).count() == 0
    assert np.isfinite(term_vector(b"", Columns())).all()


def test_quality_votes_equal_a_plain_vote(spark):
    texts, _ = corpus(160)
    y = [i % 3 > 0 for i in range(160)]
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y) if i % 2], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in score_quality(docs(spark, texts), labels).collect()}
    x = np.stack([term_vector(t.encode(), Columns()) for t in texts])
    m = Neighbours(x[1::2].astype(np.float16).astype(np.float32), np.array(y[1::2]))
    lat = ((x - m.mean) * m.idf) @ m.basis
    for i in range(160):
        cosine = [float(lat[i] @ m.latent[j] / max(1e-9, np.linalg.norm(lat[i]))) for j in range(80)]
        near = sorted(range(80), key=lambda j: -cosine[j])[:NEIGHBOURS]
        w = [min(1, max(1e-3, cosine[j])) ** SHARPNESS for j in near]
        assert abs(got[i] - sum(a * y[2 * j + 1] for a, j in zip(w, near)) / sum(w)) < 1e-3
    a = np.random.default_rng(0).standard_normal((60, 40)).astype(np.float32) @ np.diag(0.8 ** np.arange(40)).astype(np.float32)
    _, _, right = np.linalg.svd(a)
    assert np.allclose(np.abs((principal(a, 5) * right[:5].T).sum(0)), 1, atol=1e-3)


def test_quality_hears_words(spark):
    """Texts of one shape whose words tell the label."""
    r = np.random.default_rng(1)
    good, bad = ([f"{a}{b}{c}" for a in x for b in "aeiou" for c in "lnrst"] for x in ("bdfg", "kmpz"))
    texts = [" ".join(r.choice(good if i % 2 else bad, 40)) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    got = {x.doc_id: x.score for x in score_quality(docs(spark, texts), labels).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(i % 2) for i in range(120, 200)]) > 0.95

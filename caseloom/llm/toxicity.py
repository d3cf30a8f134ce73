"""Toxicity by a linear-chain conditional random field over tokens (operator 2).

Learning takes at most ``SAMPLE`` labelled documents (those of least hash of doc_id; a bound of the
model only), whole texts, which stay on the executors. Words and word beginnings that occur in far
more toxic documents than others become features, and label the tokens of toxic documents that have
one as offensive. The training sequences are the ``WINDOW`` tokens around each token with a feature;
of a document without any, those around every 400th token. Of a document with more than
``DOC_WINDOWS`` sequences so many are taken, evenly over the whole text, and weighted to count for
all. Equal sequences are counted in Spark; the driver fits a two-state chain to the different ones
by gradient ascent on its exact log-likelihood.

Scoring reads each whole text: forward-backward marginals of every token with a feature (runs of
tokens without one are stepped over exactly, with a power of their transfer matrix). The document
score is a logistic function, fitted on the same sample, of the marginals' sum, maximum and density;
tokens with a marginal of 0.5 or more are the offending spans. No shuffle.

Defined results: null and empty texts get the score of a text without offending tokens; unlabelled
or null-labelled rows and null doc_ids are not learnt from; a doc_id with several labels counts as
toxic if one of them does, and one with several texts is learnt from the least of them; without
labels of both kinds all scores are 0; ties in the sample go to the lesser doc_id; null doc_ids are
scored and not held out; repeated rows give repeated results; an empty table gives none; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, materialize, sliced

SAMPLE = 6_000  # labelled documents the model is fitted on
BEGINNINGS = (4, 5, 6, 7)  # lengths of word beginnings that can be features
COUNTED = 50_000  # features that a task counts at a time
LEAST_DOCS, LEAST_SHARE = 6, 0.8  # a feature: toxic documents that have it, and their share of all that have it
WINDOW, DOC_WINDOWS = 8, 64  # tokens before and after a token in a training sequence; sequences of a document
WORD = re.compile(r"[^\W\d_]+")
SCHEMA = "doc_id long, score double, n_toxic_tokens long, spans array<struct<start:int,end:int,p:double>>"


def token_features(word: str) -> list[str]:
    w = word.lower()
    return [w + "$", *(w[:n] for n in BEGINNINGS if len(w) > n)]


def held_out(mod: int, rest: int) -> Column:
    """The fold of a doc_id; a null doc_id is in none."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == rest, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, n: int) -> DataFrame:
    """doc_id, text, y (0 or 1) of at most n labelled documents, those of least hash of doc_id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(label) > 0).cast("int").alias("y")).dropna()
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    rows = id_text(docs).join(F.broadcast(known), "doc_id")  # n rows at most
    return rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")


@dataclass
class ToxicModel:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    trans: tuple[float, float, float, float] = (1.0, 1.0, 1.0, 1.0)  # exp of (0,0), (0,1), (1,0), (1,1)
    logistic: tuple[float, ...] = (-50.0, 0.0, 0.0, 0.0)

    def emission(self, word: str) -> float:
        """What the token's features add to the log-odds of being offensive; 0 if it has none."""
        return sum(self.weights.get(f, 0.0) for f in token_features(word))

    def marginals(self, at: list[int], emissions: list[float], n: int) -> np.ndarray:
        """P(offensive) of the tokens with features, at positions ``at`` of n."""
        t00, t01, t10, t11 = self.trans
        o = math.exp(self.bias)
        step = np.array([[t00, t01 * o], [t10, t11 * o]])  # over one token without features, row: state before
        values, left = np.linalg.eig(step)
        right = np.linalg.inv(left)
        big = values.max()

        def over(gap: int) -> np.ndarray:
            return (left * (values / big) ** gap) @ right

        k, fwd, bwd = len(at), np.empty((len(at), 2)), np.empty((len(at), 2))
        a = np.array([1.0, o]) if at and at[0] else None
        for i in range(k):
            e = np.array([1.0, math.exp(min(50.0, self.bias + emissions[i]))])
            if i == 0:
                before = a @ over(at[0] - 1) @ np.array([[t00, t01], [t10, t11]]) if at[0] else np.ones(2)
            else:
                before = fwd[i - 1] @ over(at[i] - at[i - 1] - 1) @ np.array([[t00, t01], [t10, t11]])
            fwd[i] = before * e
            fwd[i] /= fwd[i].sum()
        for i in reversed(range(k)):
            if i == k - 1:
                bwd[i] = over(n - 1 - at[i]) @ np.ones(2)
            else:
                e = np.array([1.0, math.exp(min(50.0, self.bias + emissions[i + 1]))])
                bwd[i] = over(at[i + 1] - at[i] - 1) @ np.array([[t00, t01], [t10, t11]]) @ (e * bwd[i + 1])
            bwd[i] /= bwd[i].sum()
        both = fwd * bwd
        return both[:, 1] / both.sum(axis=1)

    def evidence(self, p: np.ndarray, n: int) -> list[float]:
        return [1.0, math.log1p(float(p.sum())), float(p.max(initial=0.0)), float(p.sum()) / max(n, 20)]

    def score(self, p: np.ndarray, n: int) -> float:
        z = float(np.dot(self.logistic, self.evidence(p, n)))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


class Emissions(dict):
    """Word -> emission, remembered for at most ``most`` words at a time."""

    def __init__(self, model: ToxicModel, most: int = 200_000):
        super().__init__()
        self._model, self._most = model, most

    def __missing__(self, word: str) -> float:
        if len(self) >= self._most:
            self.clear()
        v = self[word] = self._model.emission(word)
        return v


def _chain(cell: np.ndarray, feature: np.ndarray, n_features: int, y: np.ndarray, real: np.ndarray, weight: np.ndarray, steps: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Fit a two-state chain to weighted sequences (rows of y, 0/1, and real, not padding); token ``cell[i]`` has ``feature[i]``. The last weight is the bias."""
    w, t = np.zeros(n_features + 1), np.zeros((2, 2))
    rows, length = y.shape
    g2w, g2t = np.full(n_features + 1, 1e-8), np.full((2, 2), 1e-8)
    for _ in range(steps):
        e = np.bincount(cell, w[feature], rows * length).reshape(rows, length) + w[-1]
        emit = np.where(real[..., None], np.exp(np.stack([np.zeros_like(e), np.clip(e, -30, 30)], -1)), 1.0)
        m = np.exp(t)
        fwd, bwd = np.empty((rows, length, 2)), np.ones((rows, length, 2))
        fwd[:, 0] = emit[:, 0]
        for i in range(1, length):
            fwd[:, i] = (fwd[:, i - 1] @ m) * emit[:, i]
            fwd[:, i] /= fwd[:, i].sum(1, keepdims=True)
        for i in range(length - 2, -1, -1):
            bwd[:, i] = (bwd[:, i + 1] * emit[:, i + 1]) @ m.T
            bwd[:, i] /= bwd[:, i].sum(1, keepdims=True)
        p = fwd * bwd
        p1 = p[..., 1] / p.sum(-1)
        miss = np.where(real, y - p1, 0.0) * weight[:, None]
        gw = np.append(np.bincount(feature, miss.ravel()[cell], n_features), miss.sum())
        pair = fwd[:, :-1, :, None] * m * (bwd[:, 1:] * emit[:, 1:])[:, :, None, :]
        pair /= pair.sum((2, 3), keepdims=True)
        both = (real[:, 1:] * weight[:, None])[..., None, None]
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:, :-1], y[:, 1:]), both[..., 0, 0])
        gt = seen - (pair * both).sum((0, 1))
        gw, gt = gw - 0.05 * w, gt - 0.05 * t
        g2w, g2t = g2w + gw**2, g2t + gt**2
        w, t = w + 0.5 * gw / np.sqrt(g2w), t + 0.5 * gt / np.sqrt(g2t)
    return w, t


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps of a ridge-penalised logistic fit."""
    b = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(b))
        b = b + np.linalg.solve(h, x.T @ (y - p) - ridge * b)
    return b


def _features(rows: DataFrame) -> list[str]:
    """The features: words and beginnings that most often stand in toxic documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, n = (Counter(), Counter()), [0, 0]

        def out() -> pa.RecordBatch:
            names = ["", *(have[0] | have[1])]  # the empty name stands for all documents
            clean, toxic = (pa.array([n[y], *(have[y][f] for f in names[1:])], pa.int64()) for y in (0, 1))
            for x in have:
                x.clear()
            n[:] = 0, 0
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), clean, toxic], names=["feature", "clean", "toxic"])

        for b in sliced(batches):
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n[y] += 1
                have[y].update({f for w in set(WORD.findall(t)) for f in token_features(w)})
                if len(have[0]) + len(have[1]) > COUNTED:
                    yield out()
        yield out()

    counts = rows.select("text", "y").mapInArrow(count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = materialize(counts, "toxic-features")
    n = counts.filter("feature = ''").first()
    if n is None or not n.clean or not n.toxic:
        return []
    odds = n.clean / n.toxic  # as if both kinds were as frequent
    clean, toxic = F.col("clean"), F.col("toxic")
    fits = (toxic >= LEAST_DOCS) & (toxic * odds >= LEAST_SHARE * (toxic * odds + clean + 1)) & (toxic >= LEAST_SHARE * (toxic + clean))
    return sorted(r.feature for r in counts.filter(fits & (F.col("feature") != "")).collect())


def _evenly(at: np.ndarray) -> np.ndarray:
    """At most ``DOC_WINDOWS`` of the places, evenly."""
    return at if len(at) <= DOC_WINDOWS else at[np.linspace(0, len(at) - 1, DOC_WINDOWS).round().astype(int)]


def _sequences(rows: DataFrame, slot: dict[str, int]) -> DataFrame:
    """(y, n, cells, weight): different training sequences of n tokens; cells: place:slot of their features."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for b in sliced(batches):
            out = []
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if len(known) > 2 * COUNTED:
                    known.clear()
                words = WORD.findall(t)
                for w in set(words) - known.keys():
                    known[w] = [slot[f] for f in token_features(w) if f in slot]
                hot = [known[w] for w in words]
                hits = np.array([i for i, h in enumerate(hot) if h], int)
                places = hits if len(hits) else np.arange(WINDOW, len(words), 400)
                taken = _evenly(places)
                for i in taken:
                    part = hot[max(0, i - WINDOW) : i + WINDOW + 1]
                    out.append((y, len(part), " ".join(f"{j}:{k}" for j, h in enumerate(part) for k in h), len(places) / len(taken)))
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 4, kinds)], names=["y", "n", "cells", "weight"])

    found = rows.select("text", "y").mapInArrow(cut, "y int, n int, cells string, weight double")
    return found.groupBy("y", "n", "cells").agg(F.sum("weight").alias("weight"))


def fit(rows: DataFrame) -> ToxicModel:
    """The model of a bounded sample (text, y); its texts stay on the executors."""
    chosen = _features(rows)
    if not chosen:
        n = {r.y for r in rows.select("y").distinct().collect()}
        if n != {0, 1}:
            return ToxicModel()
    model = ToxicModel()
    # as Arrow columns: rows of Python objects would cost the driver many times their bytes
    sequences = _sequences(rows, {f: i for i, f in enumerate(chosen)}).orderBy("y", "n", "cells").toArrow().combine_chunks() if chosen else None
    if sequences is not None and sequences.num_rows:
        y, n, weight = (sequences.column(c).to_numpy() for c in ("y", "n", "weight"))
        real = np.arange(2 * WINDOW + 1) < n[:, None]
        said = pc.split_pattern(sequences.column("cells").combine_chunks(), " ")
        row = np.repeat(np.arange(len(y)), pc.list_value_length(said).to_numpy())
        said = said.flatten()
        told = pc.not_equal(said, "")
        row = row[told.to_numpy(zero_copy_only=False)]
        place, feature = pc.split_pattern(said.filter(told), ":").flatten().cast(pa.int64()).to_numpy().reshape(-1, 2).T
        cell = row * real.shape[1] + place
        offensive = np.zeros(real.shape, int)
        offensive.ravel()[cell] = y[row]
        w, t = _chain(cell, feature, len(chosen), offensive, real, weight)
        model.weights, model.bias = dict(zip(chosen, w[:-1].tolist())), float(w[-1])
        model.trans = tuple(np.exp(t).ravel().tolist())

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emission = Emissions(model).__getitem__
        for b in sliced(batches):
            made = [model.evidence(*_document(emission, model, WORD.findall(t))[1:]) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(made, pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    found = rows.select("doc_id", "text", "y").mapInArrow(weigh, "doc_id long, y int, x array<double>").orderBy("doc_id").collect()  # SAMPLE rows of four numbers
    model.logistic = tuple(_logistic(np.array([r.x for r in found]), np.array([r.y for r in found], float)).tolist())
    return model


def _document(emission, model: ToxicModel, words: list[str]) -> tuple[list[int], np.ndarray, int]:
    found = list(map(emission, words))
    at = [i for i, e in enumerate(found) if e]
    return at, model.marginals(at, [found[i] for i in at], len(words)) if at else np.empty(0), len(words)


def score_toxicity(docs: DataFrame, labels: DataFrame, scored: DataFrame | None = None) -> DataFrame:
    """doc_id, score, n_toxic_tokens, spans of every document; labels: those to learn from (doc_id, toxic). scored: other documents to score than those learnt from."""
    model = docs.sparkSession.sparkContext.broadcast(fit(materialize(labelled_sample(docs, labels, "toxic", SAMPLE), "toxic-sample")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        emission = Emissions(m).__getitem__
        for b in sliced(batches):
            score, count, spans = [], [], []
            for t in b.column(1).to_pylist():
                at, p, n = _document(emission, m, WORD.findall(t))
                score.append(m.score(p, n))
                bad = {i: float(x) for i, x in zip(at, p) if x >= 0.5}
                count.append(len(bad))
                spans.append([{"start": w.start(), "end": w.end(), "p": bad[i]} for i, w in enumerate(WORD.finditer(t)) if i in bad] if bad else [])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64()), pa.array(count, pa.int64()), pa.array(spans, kind)], names=["doc_id", "score", "n_toxic_tokens", "spans"])

    return id_text(docs if scored is None else scored).mapInArrow(run, SCHEMA)

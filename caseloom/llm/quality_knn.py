"""Text quality by nearest-neighbour voting in a latent-semantic space (operator 3).

At most ``SAMPLE`` labelled documents (those of least hash of doc_id; a bound of the model only)
are turned into term vectors and reduced by a singular value decomposition; their latent vectors
(``SAMPLE`` x ``DIMS`` floats, a fixed bound) are broadcast. Every document, whole text, is folded
into the same space and compared with all of them by exact cosine products, ``BLOCK`` documents at
a time; the ``NEIGHBOURS`` nearest vote with their cosine, raised to ``SHARPNESS``, as weight.

Terms are words and word beginnings, hashed to ``TERMS`` columns, and shapes, which hold in any
language: pairs of neighbouring character classes, how often words and word pairs repeat, and the
number of words. No shuffle of texts.

Defined results: null and empty texts are scored like any other (the vector of no words); without
labels all scores are 0; a doc_id with several labels counts as good if one of them does, and one
with several texts is learnt from the least of them; ties in the sample go to the lesser doc_id
and ties at the last neighbour to any of them; null doc_ids are scored and not held out;
very long texts are read whole; repeated rows give repeated results; an empty table gives none;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, sliced
from .toxicity import labelled_sample

SAMPLE, DIMS, NEIGHBOURS, SHARPNESS, BLOCK = 4_000, 48, 25, 12, 512
TERMS, BEGINNING, TERM_SHARE = 1_024, 4, 0.5  # columns of words and of their first letters, and their weight beside the shapes


def _classes() -> np.ndarray:
    """Byte -> class: lower, upper, digit, space, line end, not ASCII, and each other character by itself."""
    code = np.arange(256) % 128
    named = {"abcdefghijklmnopqrstuvwxyz": 0, "ABCDEFGHIJKLMNOPQRSTUVWXYZ": 1, "0123456789": 2, " \t": 3, "\n\r": 4}
    out = np.full(256, 5)
    for i, c in enumerate(sorted(c for c in code[33:127] if not chr(c).isalnum())):
        out[c] = 6 + i
    for chars, k in named.items():
        out[[ord(c) for c in chars]] = k
    return out


CLASS = _classes()
N_CLASSES = int(CLASS.max()) + 1
BINS = 16
SHAPES = N_CLASSES**2 + 3 * BINS
WIDTH = SHAPES + TERMS


class Columns(dict):
    """Word -> its two columns (whole word, beginning), remembered for at most ``most`` words at a time."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self._most = most

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) >= self._most:
            self.clear()
        w = word.strip(b".,;:!?()\"'").lower()
        v = self[word] = (zlib.crc32(w) % TERMS, zlib.crc32(w[:BEGINNING], 1) % TERMS)
        return v


def term_vector(text: bytes, columns: Columns) -> np.ndarray:
    """Square roots of shares, in five blocks: class pairs, repeats of words, repeats of word pairs, length, words and beginnings."""
    out = np.zeros(WIDTH, np.float32)
    cls = CLASS[np.frombuffer(text, np.uint8)]
    if len(cls) > 1:
        pairs = np.bincount(cls[:-1] * N_CLASSES + cls[1:], minlength=N_CLASSES**2)
        out[: N_CLASSES**2] = np.sqrt(pairs / (len(cls) - 1))
    words = text.split()
    for i, found in enumerate((Counter(words), Counter(zip(words, words[1:])))):
        n = np.fromiter(found.values(), np.int64, len(found))
        if len(n):
            share = np.bincount(np.minimum(np.log2(n).astype(int), BINS - 1), weights=n, minlength=BINS) / n.sum()
            at = N_CLASSES**2 + i * BINS
            out[at : at + BINS] = np.sqrt(share)
        if i == 0 and len(n):
            at = np.array([columns[w] for w in found])
            out[SHAPES:] = TERM_SHARE * np.sqrt(np.bincount(at.ravel(), np.repeat(n, 2), TERMS) / (2 * len(words)))
    out[N_CLASSES**2 + 2 * BINS + min(BINS - 1, len(words).bit_length())] = 0.5
    return out


def principal(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """The first k right singular vectors, by subspace iteration from fixed random directions."""
    k = min(k, *x.shape)
    q = np.random.default_rng(1).standard_normal((x.shape[1], min(k + 16, *x.shape))).astype(np.float32)
    for _ in range(rounds):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, right = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ right.T)[:, :k]


class Neighbours:
    """The labelled documents in latent space."""

    def __init__(self, vectors: np.ndarray, y: np.ndarray):
        self.y = y.astype(np.float32)
        self.mean = vectors.mean(axis=0)
        spread = vectors - self.mean
        df = (vectors > 0).mean(axis=0)
        self.idf = (1 + np.log((1 + len(vectors)) / (1 + df * len(vectors)))).astype(np.float32)
        self.basis = principal(spread * self.idf, DIMS)
        self.latent = self._unit((spread * self.idf) @ self.basis)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def vote(self, vectors: np.ndarray) -> np.ndarray:
        cosine = self._unit(((vectors - self.mean) * self.idf) @ self.basis) @ self.latent.T
        k = min(NEIGHBOURS, len(self.y))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.clip(np.take_along_axis(cosine, near, axis=1), 1e-3, 1) ** SHARPNESS
        return (weight * self.y[near]).sum(axis=1) / weight.sum(axis=1)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score of every document; labels: those to learn from (doc_id, quality)."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = Columns()
        for b in sliced(batches):
            made = [term_vector(t, columns).astype(np.float16).tobytes() for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(made, pa.binary())], names=["doc_id", "y", "v"])

    rows = labelled_sample(docs, labels, "quality", SAMPLE).mapInArrow(vectors, "doc_id long, y int, v binary").orderBy("doc_id").collect()  # SAMPLE x WIDTH halves
    model = None
    if rows:
        x = np.stack([np.frombuffer(r.v, np.float16) for r in rows]).astype(np.float32)
        model = Neighbours(x, np.array([r.y for r in rows]))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, columns = shared.value, Columns()
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                part = b.slice(i, BLOCK)
                x = np.stack([term_vector(t, columns) for t in part.column(1).cast(pa.binary()).to_pylist()])
                score = m.vote(x).astype(float) if m else np.zeros(len(x))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.clip(score, 0, 1), pa.float64())], names=["doc_id", "score"])

    return id_text(docs).mapInArrow(run, "doc_id long, score double")

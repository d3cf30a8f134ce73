"""Quality rules by distribution divergence (operator 9).

One pass over the texts gives base counts and two histograms, of character classes and of common
words, and writes these numbers. They are summed by language, over all documents, into references
(pre-aggregated in each task; a language is a row of fixed width), and each document's are compared
with every reference by Jensen-Shannon distance; it stays if the closest one is near enough. Guards:
texts shorter than ``LEAST_LETTERS`` or ``LEAST_WORDS`` have no reliable histogram and are not
judged by it. A language needs ``LEAST_DOCS`` documents to be a reference.

Defined results: null and empty texts have zero counts and fail the base rule; null languages form
no reference; without any reference only the base rule decides; repeated rows give repeated
results; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, materialize, sliced

#: Frequent function words of the four languages.
COMMON_WORDS = (
    "the of and to in a is that for it was with as on be at by this from are "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als "
    "de la le et les des en un du une que est pour qui dans par plus pas sur avec "
    "de la que el en y a los se del las un por con no una su para es al"
).split()
WORD_NUMBER = {w.encode(): i for i, w in enumerate(dict.fromkeys(COMMON_WORDS))}
OTHER = len(WORD_NUMBER)
#: Character classes: lower, upper, digit, space, line end, comma and stop, other punctuation, symbols, not ASCII.
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ",.", "!?;:'\"()-", "#*$%&|<>@^~_=+/\\[]{}`")
SYMBOLS = b"#*$%&|<>"
FAR_CHARS, FAR_WORDS = 0.26, 0.40  # Jensen-Shannon distances (base 2) beyond which a text is rejected
LEAST_LETTERS, LEAST_WORDS, LEAST_DOCS = 200, 40, 20


def _classes() -> np.ndarray:
    out = np.full(256, 5)
    out[128:] = len(CLASSES)
    for i, chars in enumerate(CLASSES):
        out[[ord(c) for c in chars]] = i
    return out


CLASS = _classes()
N_CHARS, N_WORDS = len(CLASSES) + 1, OTHER + 1
_CODE_POINT_START = (np.arange(256) & 0xC0) != 0x80


def repeated_words(words: list[bytes], size: int = 8) -> int:
    """Words that lie in a window of ``size`` words found at two places or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    rank, span = codes, 1  # rank: equal numbers for equal windows of ``span`` words; doubled up to ``size``
    while span < size:
        _, rank = np.unique(rank[:-span] * (len(words) + 1) + rank[span:], return_inverse=True)
        span *= 2
    twice = np.bincount(rank)[rank] > 1
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + size, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def measure(text: bytes) -> tuple[tuple[int, int, int, int, int], np.ndarray, np.ndarray]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), character histogram, word histogram."""
    words = text.split()  # exactly at the six ASCII white-space characters
    raw = np.frombuffer(text, np.uint8)
    each = np.bincount(raw, minlength=256)
    points = int(each[_CODE_POINT_START].sum())
    white = int(each[[9, 10, 11, 12, 13, 32]].sum())
    lines = Counter(x for x in text.split(b"\n") if x.strip())
    dup = sum(lines.values()) - len(lines)
    chars = np.bincount(CLASS, weights=each * _CODE_POINT_START, minlength=N_CHARS)
    heard = Counter(w.strip(b".,;:!?").lower() for w in words)
    seen = np.zeros(N_WORDS)
    for w, k in heard.items():
        seen[WORD_NUMBER.get(w, OTHER)] += k
    return (len(words), points - white, int(each[list(SYMBOLS)].sum()), dup, repeated_words(words)), chars, seen


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances (square root of the divergence in bits) of histograms, rows of p, to references, rows of q."""
    p, q = (x / x.sum(axis=1, keepdims=True) for x in (p, q))
    p, q = p[:, None, :], q[None, :, :]
    m = (p + q) / 2

    def kl(a: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(a > 0, a * np.log2(a / m), 0.0).sum(axis=2)

    return np.sqrt(np.maximum(0, (kl(np.broadcast_to(p, m.shape)) + kl(np.broadcast_to(q, m.shape))) / 2))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURED = "doc_id long, lang string, " + ", ".join(f"{c} long" for c in COUNTS) + ", chars array<int>, heard array<int>"
LANGS_HELD = 1_000  # languages whose sums a task holds at once


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the base counts and both histograms of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = [measure(t) for t in b.column(2).cast(pa.binary()).to_pylist()]
            counts = np.array([f[0] for f in found], np.int64).reshape(-1, len(COUNTS))
            arrays = [pa.FixedSizeListArray.from_arrays(pa.array(np.array([f[i] for f in found], np.int32).ravel()), n).cast(pa.list_(pa.int32())) for i, n in ((1, N_CHARS), (2, N_WORDS))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c) for c in counts.T), *arrays], names=["doc_id", "lang", *COUNTS, "chars", "heard"])

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, MEASURED)


def _histograms(b: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return b.column(name).flatten().to_numpy().reshape(-1, width).astype(float)


def _judged(b: pa.RecordBatch) -> np.ndarray:
    return (b.column("n_words").to_numpy() >= LEAST_WORDS) & (b.column("word_chars").to_numpy() >= LEAST_LETTERS)


def references(rows: DataFrame) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(language, mean character shares, mean common-word shares) over all measured documents of fair length."""

    def sums(total: dict[str, np.ndarray]) -> pa.RecordBatch:
        width = 1 + N_CHARS + N_WORDS
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(list(total), width).tolist(), pa.string()), pa.array(np.tile(np.arange(width, dtype=np.int32), len(total))), pa.array(np.concatenate(list(total.values())) if total else np.empty(0))], names=["lang", "i", "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            ok = np.flatnonzero(_judged(b))
            chars, heard = _histograms(b, "chars", N_CHARS)[ok], _histograms(b, "heard", N_WORDS)[ok]
            each = np.hstack((np.ones((len(ok), 1)), chars / chars.sum(axis=1, keepdims=True), heard / heard.sum(axis=1, keepdims=True)))
            langs = b.column("lang").take(pa.array(ok)).to_pylist()
            for lang in dict.fromkeys(langs):
                total[lang] = total.get(lang, 0) + each[[x == lang for x in langs]].sum(axis=0)
                if len(total) > LANGS_HELD:
                    yield sums(total)
                    total.clear()
        yield sums(total)

    found = rows.filter("lang is not null").mapInArrow(run, "lang string, i int, x double").groupBy("lang", "i").agg(F.sum("x").alias("x"))
    found = materialize(found, "language-sums")
    known = found.filter(f"i = 0 and x >= {LEAST_DOCS}").select("lang")
    wide: dict[str, np.ndarray] = {}
    for r in found.join(known, "lang", "left_semi").collect():  # a row for each histogram bin of a language with enough documents
        wide.setdefault(r.lang, np.zeros(1 + N_CHARS + N_WORDS))[r.i] = r.x
    return [(lang, v[1 : 1 + N_CHARS] / v[0], v[1 + N_CHARS :] / v[0]) for lang, v in sorted(wide.items())]


def judge_quality(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and the distances to the closest language."""
    rows = materialize(measured(docs), "measured")
    known = docs.sparkSession.sparkContext.broadcast(references(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = known.value
        by_char, by_word = (np.stack([r[i] for r in refs]) if refs else None for i in (1, 2))
        for b in sliced(batches):
            n, repeat = b.column("n_words").to_numpy(), b.column("n_repeat_words").to_numpy()
            failed = (n < 20) | (100 * repeat > 30 * n)
            near = np.full((2, len(n)), np.nan)
            ok = np.flatnonzero(_judged(b)) if refs else []
            if len(ok):
                c, w = jensen_shannon(_histograms(b, "chars", N_CHARS)[ok], by_char), jensen_shannon(_histograms(b, "heard", N_WORDS)[ok], by_word)
                best = np.argmin(c / FAR_CHARS + w / FAR_WORDS, axis=1)
                near[:, ok] = c[np.arange(len(ok)), best], w[np.arange(len(ok)), best]
            far = (near[0] > FAR_CHARS) | (near[1] > FAR_WORDS)  # false where not judged
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(b.column(c) for c in COUNTS), pa.array(failed), pa.array(~failed & ~far), *(pa.array(x, mask=np.isnan(x)) for x in near)], names=["doc_id", *COUNTS, "base_failed", "kept", "char_distance", "word_distance"])

    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, char_distance double, word_distance double")

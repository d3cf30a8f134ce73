"""Lexical retrieval packing (operator 7).

1. Every text is encoded once, with the end id, and the ids are written to the shared folder.
2. Document frequencies of token ids and the mean length, over all documents, are summed (partial
   sums in each task; at most one row for each id of the vocabulary reaches the driver).
3. Full windows of a long document become sequences as they are, without a shuffle. What is left of
   each document, less than a window, goes to shards by range of (lexical key, doc_id): the key is
   the least hash among its most telling ids, so that similar texts are neighbours, and groups of
   copies of any size are split between tasks by doc_id.
4. A shard of ``SHARD`` pieces holds a BM25 inverted index (global statistics). Each seed asks it
   for unused neighbours with its ``QUERY_IDS`` most telling ids, ``LOOK`` at a time until none shares
   one of them; those that fit fill its window in order of score, then the best one left is cut to
   close the gap, and its rest is the next seed. Only without neighbours any piece follows.
   Gaps of up to ``GAP`` ids stay as padding; besides, only a shard's last sequence has padding.

Defined results: null and empty texts are the end id alone; rows with a null doc_id are packed with
a null doc_id; repeated rows are packed each; very long texts are cut into full windows; neighbours
of equal score come in order of place; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, materialize, sliced
from .tokens import encoder, whole_tokens

SHARD, QUERY_IDS, KEY_IDS, LOOK, GAP = 2_048, 16, 8, 64, 16
K1, B = 1.2, 0.75
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
FULL, PER_TASK = 1 << 62, 1 << 36  # sequence_id: full windows from FULL on; each task has PER_TASK numbers


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """doc_id, ids (native unsigned integers, closed by the end id)."""

    strict = not whole_tokens(tokenizer_path)[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, strict)
        end = np.array([end_id], enc.typecode).tobytes()
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([enc.packed(t) + end for t in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "ids"])

    return id_text(docs).mapInArrow(run, "doc_id long, ids binary")


def statistics(coded: DataFrame, typecode: str, n_ids: int) -> tuple[np.ndarray, float]:
    """(inverse document frequency of each id, mean length of a document) over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, length = np.zeros(n_ids, np.int64), 0, 0
        for b in sliced(batches):
            for x in b.column(0).to_pylist():
                ids = np.frombuffer(x, typecode)
                df[np.unique(ids)] += 1
                n, length = n + 1, length + len(ids)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((at, [-1, -2]))), pa.array(np.concatenate((df[at], [n, length])))], names=["id", "n"])

    sums = dict(coded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n")).collect())
    n, length = sums.pop(-1, 0), sums.pop(-2, 0)
    df = np.zeros(n_ids)
    df[list(sums)] = list(sums.values())
    return np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32), max(length / max(n, 1), 1.0)


def _telling(ids: np.ndarray, idf: np.ndarray, mean: float) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids of a piece and their BM25 weights."""
    terms, tf = np.unique(ids, return_counts=True)
    return terms, idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / mean))


def _top(terms: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    return terms[np.lexsort((terms, -weights))[:k]]


class Shard:
    """An inverted index over the pieces of a shard; pieces leave it once used."""

    def __init__(self, pieces: list[np.ndarray], idf: np.ndarray, mean: float):
        self.free = np.ones(len(pieces), bool)
        self.size = np.array([len(p) for p in pieces])
        told = [_telling(p, idf, mean) for p in pieces]
        self.query = [_top(t, w, QUERY_IDS) for t, w in told]
        term = np.concatenate([t for t, _ in told]).astype(np.int64)
        order = np.argsort(term, kind="stable")
        self.doc = np.repeat(np.arange(len(pieces)), [len(t) for t, _ in told])[order]
        self.weight = np.concatenate([w for _, w in told])[order]
        self.terms, first = np.unique(term[order], return_index=True)
        self.bounds = np.append(first, len(order))
        self.next = 0

    def neighbours(self, seed: int) -> np.ndarray:
        """The unused pieces that score best for the seed's query, best first."""
        at = np.searchsorted(self.terms, self.query[seed])
        parts = [slice(self.bounds[i], self.bounds[i + 1]) for i in at]
        score = np.bincount(np.concatenate([self.doc[p] for p in parts]), np.concatenate([self.weight[p] for p in parts]), len(self.free))
        score[~self.free] = 0
        near = np.argpartition(-score, min(LOOK, len(score) - 1))[:LOOK]
        near = near[score[near] > 0]
        return near[np.lexsort((near, -score[near]))]

    def any_free(self) -> int | None:
        while self.next < len(self.free) and not self.free[self.next]:
            self.next += 1
        return self.next if self.next < len(self.free) else None


def pack_shard(pieces: list[np.ndarray], idf: np.ndarray, mean: float, window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (piece, from, to) that hold every id of every piece (each below a window) once."""
    shard, out, seed = Shard(pieces, idf, mean), [], None
    while True:
        if seed is None:
            first = shard.any_free()
            if first is None:
                return out
            seed, shard.free[first] = (first, 0), False
        piece, start = seed
        row, room, seed = [(piece, start, int(shard.size[piece]))], window - int(shard.size[piece]) + start, None
        while room > GAP and seed is None:
            near, best = shard.neighbours(piece), None
            for p in map(int, near):
                if shard.size[p] <= room:
                    row.append((p, 0, int(shard.size[p])))
                    room, shard.free[p] = room - int(shard.size[p]), False
                    if room <= GAP:
                        break
                elif best is None:
                    best = p
            if room <= GAP or (len(near) and best is None):
                continue  # full, or all that were returned fit: ask for the next ones
            p = best if best is not None else shard.any_free()  # any piece only when none shares a term
            if p is None:
                break
            shard.free[p] = False
            take = min(room, int(shard.size[p]))
            row.append((p, 0, take))
            room -= take
            if take < shard.size[p]:
                seed = (p, take)
        out.append(row)


def pack(docs: DataFrame, tokenizer_path: str, window: int = 1024, end_id: int = 0) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    enc = encoder(tokenizer_path)
    code = enc.typecode
    coded = materialize(encoded(docs, tokenizer_path, end_id), "token-ids")
    told = docs.sparkSession.sparkContext.broadcast(statistics(coded, code, max(enc.n_ids, end_id + 1)))

    def crc(ids: np.ndarray) -> int:
        return zlib.crc32(ids.astype("<u4").tobytes())

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        names = [x.split(" ")[0] for x in PIECES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = FULL + TaskContext.get().partitionId() * PER_TASK
        for b in batches:
            rows = []
            for doc, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.frombuffer(x, code)
                for s in range(0, len(ids) - window + 1, window):
                    rows.append((doc, s, window, crc(ids[s : s + window]), len(ids), at, 0))
                    at += 1
            if rows:
                yield batch(rows)

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, mean = told.value
        for b in sliced(batches):
            key, total, tail = [], [], []
            for x in b.column(1).to_pylist():
                ids = np.frombuffer(x, code)
                left = ids[len(ids) // window * window :]
                top = _top(*_telling(left, idf, mean), KEY_IDS).astype(np.uint64)
                key.append(int(((top + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)).min() >> np.uint64(1)) if len(top) else None)
                total.append(len(ids))
                tail.append(left.tobytes())
            made = pa.RecordBatch.from_arrays([b.column(0), pa.array(key, pa.int64()), pa.array(total, pa.int64()), pa.array(tail, pa.binary())], names=["doc_id", "key", "doc_tokens", "ids"])
            yield made.filter(made.column("key").is_valid())

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, mean = told.value
        at, held = TaskContext.get().partitionId() * PER_TASK, []

        def out(at: int) -> tuple[int, pa.RecordBatch]:
            ids, rows = [np.frombuffer(x, code) for _, _, x in held], []
            for sequence in pack_shard(ids, idf, mean, window):
                offset = 0
                for p, i, j in sequence:
                    doc, total, _ = held[p]
                    rows.append((doc, total - len(ids[p]) + i, j - i, crc(ids[p][i:j]), total, at, offset))
                    offset += j - i
                at += 1
            held.clear()
            return at, batch(rows)

        for b in sliced(batches):
            for row in zip(*(b.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "ids"))):
                held.append(row)
                if len(held) == SHARD:
                    at, made = out(at)
                    yield made
        if held:
            yield out(at)[1]

    tails = coded.mapInArrow(rest, "doc_id long, key long, doc_tokens long, ids binary")
    dealt = tails.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id", "ids")
    # written here, so that token ids reach Python in batches of bounded size whoever reads the pieces
    return materialize(coded.mapInArrow(full, PIECES).unionAll(dealt.mapInArrow(packed, PIECES)), "pieces")

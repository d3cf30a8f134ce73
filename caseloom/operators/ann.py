"""Approximate vector search: an inverted file of coarse cells whose rows are held as product-quantised codes.

The cells' centres and the codebooks are fitted on a bounded sample of unit vectors; every row is indexed.
A query visits the cells nearest to it, ranks their rows by codes (a table of inner products for each part of the
vector, no full vector is touched), and re-ranks the best by their full vectors. How many cells a query visits is
calibrated on the sample, or, in the exact mode, follows from a bound: a row of a cell can be no closer than
the centre's product plus the cell's radius, so cells whose bound stays below the k-th score are proven empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..sources.shared import materialize
from .blocks import best, matrices, unit_rows

SAMPLE, CELLS, PARTS, CODES = 16_384, 128, 16, 256  # vectors fitted on; cells; parts of a vector; codes of a part
BLOCK, BATCH = 8192, 512  # rows of a cell, and queries, in one matrix
RERANKED = 16  # times k rows are re-ranked by their full vectors


@dataclass
class Model:
    centres: np.ndarray  # cells x dimension
    books: np.ndarray  # parts x codes x dimension of a part
    probes: int = 1

    @property
    def dim(self) -> int:
        return self.centres.shape[1]

    def cell(self, m: np.ndarray) -> np.ndarray:
        return np.argmax(2 * m @ self.centres.T - (self.centres**2).sum(axis=1), axis=1)

    def codes(self, m: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest = (m - self.centres[cell]).reshape(len(m), len(self.books), -1)
        return np.stack([np.argmax(2 * rest[:, p] @ b.T - (b**2).sum(axis=1), axis=1) for p, b in enumerate(self.books)], axis=1).astype(np.uint8)

    def guessed(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Products of queries with the rows of a cell, by their codes."""
        parts = q.reshape(len(q), len(self.books), -1)
        out = np.repeat((q @ self.centres[cell])[:, None], len(codes), axis=1)
        for p, b in enumerate(self.books):
            out += (parts[:, p] @ b.T)[:, codes[:, p]]
        return out


def kmeans(m: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k centres of the rows; empty ones restart at rows that lie farthest from theirs."""
    k = max(1, min(k, len(m)))
    centres = m[np.linspace(0, len(m) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = 2 * m @ centres.T - (centres**2).sum(axis=1)
        cell = near.argmax(axis=1)
        counts = np.bincount(cell, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, m)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        empty = np.flatnonzero(counts == 0)
        if len(empty):
            centres[empty] = m[np.argsort(near.max(axis=1))[: len(empty)]]
    return centres


def fit(rows: DataFrame, key: str, vector: str, k: int, recall: float = 0.95) -> Model:
    """Centres, codebooks and the number of cells to visit, from a sample of least hash of the key (zero, null and odd vectors left out).

    The number is the least with which the sample's own queries find that share of their true k in visited cells.
    """
    some = rows.filter(F.size(vector) > 0).orderBy(F.xxhash64(key), key).limit(SAMPLE).select(F.col(vector).cast("array<double>").alias("v")).toArrow().column("v")
    held = [m for _, m in matrices(some)] if len(some) else []
    m = unit_rows(max(held, key=len)) if held else np.zeros((0, 1))
    m = m[(m != 0).any(axis=1)]
    if not len(m):
        return Model(np.zeros((1, m.shape[1])), np.zeros((1, 1, m.shape[1])))
    parts = next(p for p in range(min(PARTS, m.shape[1]), 0, -1) if m.shape[1] % p == 0)
    centres = kmeans(m, min(CELLS, max(1, len(m) // 32)))
    model = Model(centres, np.zeros((parts, 1, m.shape[1] // parts)))
    cell = model.cell(m)
    rest = (m - centres[cell]).reshape(len(m), parts, -1)
    books = [kmeans(rest[:, p], CODES, 6) for p in range(parts)]
    model.books = np.stack([np.resize(b, (max(map(len, books)), b.shape[1])) for b in books])
    asked = m[:: max(1, len(m) // 256)]
    true = np.argsort(-(asked @ m.T), axis=1, kind="stable")[:, : k + 1]
    order = np.argsort(-(asked @ centres.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centres))[None, :], axis=1)
    needed = np.sort(np.take_along_axis(place, cell[true], axis=1).ravel())
    model.probes = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1
    return model


def index(rows: DataFrame, key: str, vector: str, model: Model) -> DataFrame:
    """cell, keys (ascending), codes, data, radius: each cell's rows in matrices of at most BLOCK.

    Every row is there. Zero, null and odd vectors, and those of another length, stand as zeros in the cell nearest to zero.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = np.zeros((b.num_rows, model.dim))
            for at, x in matrices(b.column("vector")):
                if x.shape[1] == model.dim:
                    m[at] = unit_rows(x)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * model.dim, pa.int32()), pa.array(m.ravel()))
            yield pa.record_batch([pa.array(model.cell(m), pa.int64()), b.column("key"), flat], names=["cell", "key", "vector"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(cell: int) -> pa.RecordBatch:
            both = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            keys = both.column("key").combine_chunks()
            order = np.asarray(pc.sort_indices(keys))
            m = both.column("vector").combine_chunks().flatten().to_numpy().reshape(len(keys), model.dim)[order]
            listed = pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), keys.take(pa.array(order)))
            radius = float(np.sqrt(((m - model.centres[cell]) ** 2).sum(axis=1)).max())
            return pa.record_batch([pa.array([cell], pa.int64()), listed, pa.array([model.codes(m, np.full(len(m), cell)).tobytes()], pa.binary()), pa.array([np.ascontiguousarray(m).tobytes()], pa.binary()), pa.array([radius])], names=["cell", "keys", "codes", "data", "radius"])

        now, size = None, 0
        for b in batches:
            cells = b.column("cell").to_numpy()
            cuts = np.flatnonzero(np.diff(cells)) + 1
            for a, z in zip([0, *cuts], [*cuts, len(cells)]):
                for i in range(a, z, BLOCK):
                    part = b.slice(i, min(BLOCK, z - i))
                    if held and (cells[a] != now or size + part.num_rows > BLOCK):
                        yield flush(now)
                        size = 0
                    now, size = int(cells[a]), size + part.num_rows
                    held.append(part)
        if held:
            yield flush(now)

    name = rows.schema[key].dataType
    dealt = rows.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector")).mapInArrow(deal, T.StructType([T.StructField("cell", T.LongType()), T.StructField("key", name), T.StructField("vector", T.ArrayType(T.DoubleType()))]))
    # a cell may hold a third of all rows: a hash of the key parts it
    dealt = dealt.repartitionByRange(parts, "cell", F.xxhash64("key")).sortWithinPartitions("cell")
    kind = T.StructType([T.StructField("cell", T.LongType()), T.StructField("keys", T.ArrayType(name)), T.StructField("codes", T.BinaryType()), T.StructField("data", T.BinaryType()), T.StructField("radius", T.DoubleType())])
    return materialize(dealt.mapInArrow(pack, kind), "inverted-file")


def _asked(queries: DataFrame, model: Model, chosen) -> DataFrame:
    """cell, keys, floor, data: the queries of each cell that they visit, in batches. queries: query_id, query_vector and what ``chosen`` reads."""
    kind = queries.schema["query_id"].dataType

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = np.zeros((b.num_rows, model.dim))
            for at, x in matrices(b.column("query_vector")):
                if x.shape[1] == model.dim:
                    m[at] = unit_rows(x)
            row, cell, floor = chosen(m, b)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1) * model.dim, pa.int32()), pa.array(m[row].ravel()))
            yield pa.record_batch([pa.array(cell, pa.int64()), b.column("query_id").take(pa.array(row)), pa.array(floor), flat], names=["cell", "key", "floor", "vector"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = b.column("cell").to_numpy()
            cuts = np.flatnonzero(np.diff(cells)) + 1
            for a, z in zip([0, *cuts], [*cuts, len(cells)]):
                for i in range(a, z, BATCH):
                    part = b.slice(i, min(BATCH, z - i))
                    lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(c)) for c in ("key", "floor")]
                    yield pa.record_batch([part.column("cell").slice(0, 1), *lists, pa.array([part.column("vector").flatten().to_numpy().tobytes()], pa.binary())], names=["cell", "q_keys", "floor", "q_data"])

    flat = T.StructType([T.StructField("cell", T.LongType()), T.StructField("key", kind), T.StructField("floor", T.DoubleType()), T.StructField("vector", T.ArrayType(T.DoubleType()))])
    packed = T.StructType([T.StructField("cell", T.LongType()), T.StructField("q_keys", T.ArrayType(kind)), T.StructField("floor", T.ArrayType(T.DoubleType())), T.StructField("q_data", T.BinaryType())])
    return queries.mapInArrow(visit, flat).repartition("cell").sortWithinPartitions("cell").mapInArrow(pack, packed)


def _scored(asked: DataFrame, held: DataFrame, model: Model, k: int, key: str, decimals: int, exact: bool, kinds: tuple) -> DataFrame:
    """query_id, key, score of the best k of each query in each matrix of a cell that it visits."""

    def run(pairs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pairs:
            for i in range(b.num_rows):
                q_keys, keys = b.column("q_keys")[i].values, b.column("keys")[i].values
                q = np.frombuffer(b.column("q_data")[i].as_buffer()).reshape(len(q_keys), model.dim)
                m = np.frombuffer(b.column("data")[i].as_buffer()).reshape(len(keys), model.dim)
                if exact:
                    columns, values = best(np.round(q @ m.T, decimals) + 0.0, k)
                else:
                    codes = np.frombuffer(b.column("codes")[i].as_buffer(), np.uint8).reshape(len(keys), -1)
                    guessed = model.guessed(q, b.column("cell")[i].as_py(), codes)
                    n = min(len(keys), RERANKED * k)
                    few = np.sort(np.argsort(-guessed, axis=1, kind="stable")[:, :n], axis=1)  # of equal guesses the lesser keys; in the order of the keys
                    at, values = best(np.round(np.einsum("qd,qnd->qn", q, m[few]), decimals) + 0.0, k)
                    columns = np.take_along_axis(few, at, axis=1)
                whose = np.repeat(np.arange(len(q)), columns.shape[1])
                keep = values.ravel() >= b.column("floor")[i].values.to_numpy()[whose]
                yield pa.record_batch([q_keys.take(pa.array(whose[keep])), keys.take(pa.array(columns.ravel()[keep])), pa.array(values.ravel()[keep])], names=["query_id", key, "score"])

    kind = T.StructType([T.StructField("query_id", kinds[0]), T.StructField(key, kinds[1]), T.StructField("score", T.DoubleType())])
    return materialize(asked.join(held, "cell").mapInArrow(run, kind), "cell-tops")


def search(held: DataFrame, queries: DataFrame, model: Model, k: int, key: str, exact: bool = False, probes: int | None = None, decimals: int = 6) -> DataFrame:
    """query_id, key, score, rank: the k rows of highest cosine, ties to the lesser key; ``exact``: proven to be those.

    queries: query_id, query_vector. Each visits ``probes`` cells (the model's number, if none is given). In the exact
    mode their rows are compared in full, and then every other cell that the bound does not rule out.
    """
    probes = min(probes or model.probes, len(model.centres))
    kinds = (queries.schema["query_id"].dataType, held.schema["keys"].dataType.elementType)
    order = lambda m: np.argsort(-(m @ model.centres.T), axis=1, kind="stable")

    def nearest(m: np.ndarray, b: pa.RecordBatch):
        return np.repeat(np.arange(len(m)), probes), order(m)[:, :probes].ravel(), np.full(len(m) * probes, -2.0)

    w = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc(key))
    top = lambda found: found.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
    asked = queries.select("query_id", F.col("query_vector").cast("array<double>").alias("query_vector"))
    found = _scored(_asked(asked, model, nearest), held, model, k, key, decimals, exact, kinds)
    if not exact:
        return top(found)
    radius = np.full(len(model.centres), -np.inf)  # of each cell: a number for each of at most CELLS
    for r in held.groupBy("cell").agg(F.max("radius").alias("r")).collect():
        radius[r.cell] = r.r
    kth = top(found).groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(-2.0)).alias("kth"))

    def open_cells(m: np.ndarray, b: pa.RecordBatch):
        bound = m @ model.centres.T + radius + 10.0**-decimals
        floor = b.column("kth").to_numpy(zero_copy_only=False)
        left = bound >= floor[:, None]
        np.put_along_axis(left, order(m)[:, :probes], False, axis=1)
        row, cell = np.nonzero(left & np.isfinite(radius))
        return row, cell, floor[row]

    rest = asked.join(kth, "query_id", "left").withColumn("kth", F.coalesce("kth", F.lit(-2.0)))
    return top(found.unionByName(_scored(_asked(rest, model, open_cells), held, model, k, key, decimals, True, kinds)))

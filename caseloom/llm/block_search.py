"""Exact top-k search by inner product over whole numbers, block at a time (operator 11).

Components are the terms, ``floor(scale * x)`` their whole weights. A tree of bisections, fitted on ``SAMPLE``
vectors, brings similar vectors together (it decides the order, never a result), and rows are dealt by
ranges of that order. A range's row holds a forward index (its vectors as one matrix) in blocks of
``BLOCK``, with the largest and the least weight of each term in a block. For a query a block's bound is the
sum over the terms of the query's weight times that maximum (minimum, where the weight is negative). Blocks are
taken in the order of their bounds and scored until a bound falls below the query's k-th score. That begins
at the k-th score in the query's own range. All ranges meet all batches of queries, matrix by matrix,
without a pair of rows in Spark; each pair of matrices gives at most k rows of a query for each block, those
at or above its k-th score.

Products are exact: 64-bit floats where the largest sum is below 2**53, else Python integers, held to the
range of a long (but its least number).

Defined results: vectors that are null or hold null or non-finite components take no part; of vectors of
unlike lengths the missing components are zero, so the score of an empty one is 0; null ids are no queries and, as
candidates, stand last among ties; a row's own self is left out, but not another row of the same id, and each row of a
query's id is a query; equal vectors are candidates of their own; fewer than k candidates: all; an
empty table gives no rows; other columns are ignored; vectors of any length work, ranges are bounded in bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators.blocks import best, paired
from .common import materialize

SAMPLE, DEPTH, BLOCK = 8192, 8, 256
RANGE_BYTES, BATCH = 8 << 20, 1024
LEAST = np.iinfo(np.int64).min


def bisections(sample: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(directions, thresholds) of a complete binary tree in heap order: each node splits its sample at the median of its main direction."""
    n = (1 << depth) - 1
    directions, thresholds = np.zeros((n, sample.shape[1])), np.zeros(n)
    held = {0: sample}
    for i in range(n):
        part = held.pop(i, None)
        if part is None or len(part) < 16:
            continue
        spread = part - part.mean(axis=0)
        v = spread[np.argmax((spread * spread).sum(axis=1))]
        for _ in range(12):  # power iteration
            v = spread.T @ (spread @ v)
            v = v / max(np.linalg.norm(v), 1e-300)
        at = part @ v
        directions[i], thresholds[i] = v, np.median(at)
        held[2 * i + 1], held[2 * i + 2] = part[at < thresholds[i]], part[at >= thresholds[i]]
    return directions, thresholds


def cells(m: np.ndarray, tree: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The leaf of each row, numbered from left to right."""
    directions, thresholds = tree
    d, at = directions.shape[1], np.zeros(len(m), np.int64)
    m = m[:, :d] if m.shape[1] >= d else np.pad(m, ((0, 0), (0, d - m.shape[1])))
    while len(directions) and len(at) and at.min() < len(directions):
        at = 2 * at + 1 + ((m * directions[at]).sum(axis=1) >= thresholds[at])
    return at - len(directions)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole-number inner products of the rows, exact, as int64."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    if d * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in r] for r in m.tolist()], object).reshape(m.shape)
    return np.clip(whole(a) @ whole(b).T, LEAST + 1, np.iinfo(np.int64).max).astype(np.int64)


def bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The highest score that a row of each block can have with each query."""
    d = min(q.shape[1], high.shape[1])
    if d * np.abs(q).max(initial=0) * max(np.abs(high).max(initial=0), np.abs(low).max(initial=0)) >= 2.0**53:
        return np.full((len(q), len(high)), np.iinfo(np.int64).max)
    return (np.maximum(q[:, :d], 0) @ high[:, :d].T + np.minimum(q[:, :d], 0) @ low[:, :d].T).astype(np.int64)


def search(q: np.ndarray, own: np.ndarray, floor: np.ndarray, m: np.ndarray, high: np.ndarray, low: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, row, score) of what may be among the k best, and how many blocks were scored.

    own: the query's own row in m, else -1; floor: a score that k other rows are known to reach.
    """
    bound = bounds(q, high, low)
    order = np.argsort(-bound, axis=1, kind="stable")
    top = np.full((len(q), k), LEAST)
    kth, found, scored, live = floor.copy(), [], 0, np.arange(len(q))
    for step in range(bound.shape[1]):
        live = live[bound[live, order[live, step]] >= kth[live]]
        if not len(live):
            break
        blocks = order[live, step]
        for j in np.unique(blocks):
            rows = live[blocks == j]
            at = j * BLOCK
            s = products(q[rows], m[at : at + BLOCK])
            inside = (own[rows] >= at) & (own[rows] < at + BLOCK)
            s[np.flatnonzero(inside), own[rows][inside] - at] = LEAST
            columns, values = best(s, k)
            top[rows] = np.sort(np.concatenate([top[rows], values], axis=1), axis=1)[:, -k:]
            keep = (values >= kth[rows, None]) & (values > LEAST)
            found.append((np.repeat(rows, columns.shape[1]).reshape(columns.shape)[keep], columns[keep] + at, values[keep]))
            scored += len(rows)
        kth = np.maximum(kth, top[:, 0])
    if not found:
        return (*[np.zeros(0, np.int64)] * 3, scored)
    whose, rows, values = (np.concatenate(x) for x in zip(*found))
    keep = values >= kth[whose]
    return whose[keep], rows[keep], values[keep], scored


def _whole(column: pa.ListArray, scale: float) -> np.ndarray:
    """Vectors as rows of whole numbers, short ones filled up with zeros."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    values = np.floor(scale * column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False))
    if len(sizes) and (sizes == sizes[0]).all():
        return values.reshape(len(sizes), sizes[0])
    out = np.zeros((len(sizes), sizes.max(initial=0)))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


INDEX = "block long, ids array<long>, dim int, data binary, high binary, low binary, at array<int>, floor array<long>"


def index(rows: DataFrame, key: str, vector: str, scale: float, every: int, k: int) -> DataFrame:
    """A row for each range: its ids, forward index, extremes of its blocks, its queries' places and their k-th score in the range."""
    spark = rows.sparkSession
    told = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.filter(F.col(vector).isNotNull() & told).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    some = rows.orderBy(F.xxhash64("id", "v")).limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    tree = bisections(_whole(some, scale))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([pa.array(cells(_whole(b.column("v"), scale), tree), pa.int64()), b.column("id"), b.column("v")], names=["cell", "id", "v"])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held, size = TaskContext.get().partitionId() << 32, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal made
            both = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            ids, m = both.column("id").combine_chunks(), _whole(both.column("v").combine_chunks(), scale)
            given, null = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
            order = np.lexsort((given, null, np.arange(len(given)) // BLOCK))  # ids ascend within a block, null ones last
            m, given, null = m[order], given[order], null[order]
            cuts = np.arange(0, len(m), BLOCK)
            high, low = np.maximum.reduceat(m, cuts, axis=0) if m.size else np.zeros((len(cuts), 0)), np.minimum.reduceat(m, cuts, axis=0) if m.size else np.zeros((len(cuts), 0))
            at = np.flatnonzero(~null & (given % every == 0))
            floor = np.full(len(at), LEAST)
            if len(m) > k:
                for i in range(0, len(at), BATCH):
                    s = products(m[at[i : i + BATCH]], m)
                    s[np.arange(len(s)), at[i : i + BATCH]] = LEAST
                    floor[i : i + BATCH] = np.partition(s, -k, axis=1)[:, -k]
            made += 1
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (pa.array(given, mask=null), pa.array(at, pa.int32()), pa.array(floor, pa.int64()))]
            return pa.record_batch([pa.array([made], pa.int64()), lists[0], pa.array([m.shape[1]], pa.int32()), *[pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in (m, high, low)], lists[1], lists[2]], names=["block", "ids", "dim", "data", "high", "low", "at", "floor"])

        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                part = b.slice(i, BLOCK)
                held.append(part)
                size += 8 * max(part.num_rows, pc.sum(pc.list_value_length(part.column("v"))).as_py())
                if size >= RANGE_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # a cell may hold a third of all rows: a hash of the row parts it
    dealt = rows.mapInArrow(deal, "cell long, id long, v array<double>").repartitionByRange(parts, "cell", F.xxhash64("id", "v")).sortWithinPartitions("cell")
    return materialize(dealt.select("id", "v").mapInArrow(ranges, INDEX), "ranges")


def _batches(ranges: DataFrame) -> DataFrame:
    """The queries of the ranges in batches: query ids, rows (range and place), k-th scores, vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, at, d = b.column("ids")[i].values, b.column("at")[i].values, b.column("dim")[i].as_py()
                m = np.frombuffer(b.column("data")[i].as_buffer()).reshape(len(ids), d)
                for j in range(0, len(at), BATCH):
                    part = at.slice(j, BATCH)
                    lists = [pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), x) for x in (ids.take(part), part, b.column("floor")[i].values.slice(j, BATCH))]
                    yield pa.record_batch([b.column("block").slice(i, 1), *lists, pa.array([d], pa.int32()), pa.array([np.ascontiguousarray(m[part.to_numpy()]).tobytes()], pa.binary())], names=["block", "ids", "at", "floor", "dim", "data"])

    return ranges.mapInArrow(run, "block long, ids array<long>, at array<int>, floor array<long>, dim int, data binary")


def top_products(rows: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """query_id, rank, id, score: of each row whose key ``every`` divides, the k other rows of highest inner product, ties to the lesser key."""
    ranges = index(rows, key, vector, scale, every, k)
    batches = materialize(_batches(ranges), "query-batches")

    def run(pairs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pairs:
            for i in range(b.num_rows):
                one = {c: b.column(c)[i] for c in b.schema.names}
                ids, q_ids = one["ids"].values, one["q_ids"].values
                d, q_d = one["dim"].as_py(), one["q_dim"].as_py()
                m, high, low = (np.frombuffer(one[c].as_buffer()).reshape(-1, d) if d else np.zeros((n, 0)) for c, n in (("data", len(ids)), ("high", -(-len(ids) // BLOCK)), ("low", -(-len(ids) // BLOCK))))
                q = np.frombuffer(one["q_data"].as_buffer()).reshape(len(q_ids), q_d)
                at = one["q_at"].values.to_numpy().astype(np.int64)
                own = at if one["q_block"].as_py() == one["block"].as_py() else np.full(len(at), -1)
                whose, found, values, _ = search(q, own, one["q_floor"].values.to_numpy(), m, high, low, k)
                row = pa.array(at[whose])
                yield pa.record_batch([pa.array([one["q_block"].as_py()] * len(whose), pa.int64()), row, q_ids.take(pa.array(whose)), ids.take(pa.array(found)), pa.array(values, pa.int64())], names=["q_block", "q_at", "query_id", "id", "score"])

    block = ["block", "ids", "dim", "data", "high", "low"]
    both = paired(batches, ranges, ranges.count(), {f"q_{c}": c for c in batches.columns}, {c: c for c in block})
    found = materialize(both.mapInArrow(run, "q_block long, q_at long, query_id long, id long, score long"), "range-tops")
    w = W.partitionBy("q_block", "q_at").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")

"""Vectors in blocks: matrices of many rows, paired block by block and multiplied, with the k best kept for each query.

A stated query set meets all rows without a nested loop over rows and without a broadcast: rows become
matrices of bounded bytes, queries likewise; every batch of queries is sent once to every shard of rows, and a
task multiplies one pair of matrices at a time and keeps k rows of a query in it. The best of all shards are merged by query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..sources.shared import materialize

BLOCK_BYTES, BATCH_BYTES = 8 << 20, 1 << 19  # a matrix of rows, and of queries
COLUMNS = 4096  # rows that are scored at a time: bounds the scores in memory


def matrices(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix of float64) for each length of vector; null vectors and those with null or infinite components become zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        values = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        m = values.reshape(len(at), d) if d else np.zeros((len(at), 0))
        bad = ~np.isfinite(m).all(axis=1)
        yield at, np.where(bad[:, None], 0.0, m) if bad.any() else m


def unit_rows(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def packed(rows: DataFrame, key: str, vector: str, most_bytes: int, parts: int, prepare: Callable[[np.ndarray], np.ndarray] = unit_rows) -> DataFrame:
    """block, dim, keys (ascending), data (rows of float64): each task's rows in matrices of at most so many bytes.

    The table is dealt to ``parts`` tasks first. Vectors of another length stand in matrices of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        made = TaskContext.get().partitionId() << 32

        def flush(d: int) -> pa.RecordBatch:
            nonlocal made
            keys = pa.concat_arrays([k for k, _ in held[d]])
            m = np.concatenate([x for _, x in held.pop(d)])
            order = pc.sort_indices(keys, sort_keys=[("", "ascending")], null_placement="at_start").to_numpy()
            made += 1
            listed = pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), keys.take(pa.array(order)))
            return pa.record_batch([pa.array([made], pa.int64()), pa.array([d], pa.int32()), listed, pa.array([np.ascontiguousarray(m[order]).tobytes()], pa.binary())], names=["block", "dim", "keys", "data"])

        for b in batches:
            for at, m in matrices(b.column("vector")):
                d, keys, m = m.shape[1], b.column("key").take(pa.array(at)), prepare(m)
                most = max(1, most_bytes // (8 * max(1, d)))
                while len(m):
                    have = sum(len(x) for _, x in held.get(d, []))
                    n = min(len(m), most - have)
                    held.setdefault(d, []).append((keys.slice(0, n), m[:n]))
                    keys, m = keys.slice(n), m[n:]
                    if have + n >= most:
                        yield flush(d)
        for d in list(held):
            yield flush(d)

    kind = T.StructType([T.StructField("block", T.LongType()), T.StructField("dim", T.IntegerType()), T.StructField("keys", T.ArrayType(rows.schema[key].dataType)), T.StructField("data", T.BinaryType())])
    return rows.select(F.col(key).alias("key"), F.col(vector).alias("vector")).repartition(parts).mapInArrow(run, kind)


def paired(batches: DataFrame, blocks: DataFrame, n_blocks: int, batch_columns: dict[str, str], block_columns: dict[str, str]) -> DataFrame:
    """Every batch with every block, once: each block has one of as many shards as there are blocks, each batch goes to all of them."""
    spark, shards = blocks.sparkSession, max(1, n_blocks)
    parts = min(max(shards, 1), max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    left = batches.select(*[F.col(c).alias(n) for n, c in batch_columns.items()], F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")).repartition(parts, "shard")
    right = blocks.select(*[F.col(c).alias(n) for n, c in block_columns.items()], F.pmod(F.xxhash64("block"), F.lit(shards)).cast("int").alias("shard")).repartition(parts, "shard")
    return left.join(right.hint("merge"), "shard").drop("shard")


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(columns, scores) of the k highest of each row, of equal ones the first columns; scores is used up."""
    rows, n = np.arange(len(scores)), min(k, scores.shape[1])
    columns, values = np.empty((len(scores), n), np.int64), np.empty((len(scores), n), scores.dtype)
    low = -np.inf if scores.dtype.kind == "f" else np.iinfo(scores.dtype).min
    for i in range(n):
        columns[:, i] = scores.argmax(axis=1)
        values[:, i] = scores[rows, columns[:, i]]
        scores[rows, columns[:, i]] = low
    return columns, values


def top_cosines(rows: DataFrame, queries: DataFrame, k: int, key: str, vector: str, decimals: int = 6) -> DataFrame:
    """query_id, key, score, rank: of each query (query_id, query_vector) the k rows of highest cosine, ties to the lesser key.

    Cosines are rounded before they are compared. 0: a zero, null or non-finite vector, or one of another length.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    blocks = materialize(packed(rows, key, vector, BLOCK_BYTES, parts), "row-blocks")
    batches = materialize(packed(queries, "query_id", "query_vector", BATCH_BYTES, max(1, parts // 8)), "query-blocks")

    def run(pairs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pairs:
            for i in range(b.num_rows):
                q_dim, dim = b.column("q_dim")[i].as_py(), b.column("dim")[i].as_py()
                q_keys, keys = b.column("q_keys")[i].values, b.column("keys")[i].values
                q = np.frombuffer(b.column("q_data")[i].as_buffer()).reshape(len(q_keys), q_dim)
                m = np.frombuffer(b.column("data")[i].as_buffer()).reshape(len(keys), dim)
                for at in range(0, len(keys), COLUMNS):
                    part = m[at : at + COLUMNS]
                    s = np.round(q @ part.T, decimals) + 0.0 if q_dim == dim else np.zeros((len(q), len(part)))
                    columns, values = best(s, k)
                    whose = np.repeat(np.arange(len(q)), columns.shape[1])
                    yield pa.record_batch([q_keys.take(pa.array(whose)), keys.take(pa.array(columns.ravel() + at)), pa.array(values.ravel())], names=["query_id", key, "score"])

    kind = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField(key, rows.schema[key].dataType), T.StructField("score", T.DoubleType())])
    columns = {"keys": "keys", "dim": "dim", "data": "data"}
    both = paired(batches, blocks, blocks.count(), {f"q_{n}": c for n, c in columns.items()}, columns)
    found = materialize(both.mapInArrow(run, kind), "block-tops")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc(key))
    return found.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)

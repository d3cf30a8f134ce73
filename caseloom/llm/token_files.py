"""Token ids in flat binary files (operator 10).

``write_token_files`` deals documents by ranges of doc_id, and each task writes one shard:
``NNNNNN.bin`` (ids, flat little-endian unsigned integers of 2 or 4 bytes, each document closed by
the end id), ``NNNNNN.off`` (64-bit offsets in ids, one more than documents) and ``NNNNNN.doc``
(64-bit doc_ids). Tasks write under another name and rename, so a repeated task is harmless.
Only one row of totals for each shard reaches the driver; shard bases are their prefix sums.
``read_token_files`` maps the files into memory, a task for each shard.

Defined results: null text counts as empty (the end id alone); null doc_ids come first and are
restored on reading; repeated rows are all written, ordered by a hash of
the text; very long texts are encoded and written one at a time; an empty table gives no rows.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, sliced
from .tokens import encoder, whole_tokens

NO_ID = np.iinfo(np.int64).min
TOTALS = "shard int, n_docs long, n_ids long"


def _put(folder: str, name: str, chunks) -> None:
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    hidden = f"{path}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(hidden) as out:
        for c in chunks:
            out.write(c)
    store.move(hidden, f"{path}/{name}")


def _map(folder: str, name: str, dtype: str) -> np.ndarray:
    store, path = fs.FileSystem.from_uri(folder)
    full = f"{path}/{name}"
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(full, dtype=dtype, mode="r") if os.path.getsize(full) else np.empty(0, dtype)
    with store.open_input_stream(full) as f:
        return np.frombuffer(f.read(), dtype)


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int) -> list[tuple[int, int, int, int]]:
    """Write the shards; return (shard, documents, ids, ids in all shards before it) in ascending doc_id order."""

    strict = not whole_tokens(tokenizer_path)[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoder(tokenizer_path, strict), TaskContext.get().partitionId()
        end, ids, sizes = np.array([end_id], f"<u{2 if enc.typecode == 'H' else 4}").tobytes(), [0], []
        width = len(end)

        def encoded():
            for b in sliced(batches):
                sizes.append(b.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False))
                for t in b.column(1).to_pylist():
                    packed = enc.packed(t)
                    ids.append(ids[-1] + len(packed) // width + 1)
                    yield packed + end

        _put(folder, f"{shard:06d}.bin", encoded())
        if len(ids) > 1:
            _put(folder, f"{shard:06d}.off", [np.array(ids, "<i8").tobytes()])
            _put(folder, f"{shard:06d}.doc", [np.concatenate(sizes).astype("<i8").tobytes()])
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n_docs": [len(ids) - 1], "n_ids": [ids[-1]]})

    # the hash deals a repeated or null doc_id to several tasks
    keyed = id_text(docs).withColumn("h", F.xxhash64("text"))
    dealt = keyed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    totals = sorted(tuple(r) for r in dealt.mapInArrow(run, TOTALS).collect())  # a row for each shard
    bases = accumulate((n for _, _, n in totals), initial=0)
    return [(*t, base) for t, base in zip(totals, bases)]


def read_token_files(spark: SparkSession, folder: str, shards: list[tuple[int, int, int, int]], width: int) -> DataFrame:
    """A row for each document: doc_id, start, n_tokens, ids_crc32, from the mapped files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, base in zip(b.column(0).to_pylist(), b.column(3).to_pylist()):
                ids, off = _map(folder, f"{shard:06d}.bin", f"<u{width}"), _map(folder, f"{shard:06d}.off", "<i8")
                names = np.asarray(_map(folder, f"{shard:06d}.doc", "<i8"))
                crc = [zlib.crc32(ids[i:j].astype("<u4").tobytes()) for i, j in zip(off[:-1].tolist(), off[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(names, mask=names == NO_ID), pa.array(off[:-1] + base), pa.array(np.diff(off)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    table = spark.createDataFrame(shards, TOTALS + ", base long")
    return table.repartition(max(1, len(shards))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")

"""Tables that are kept between runs: results by the content they were made from, and rows by key with only changed buckets rewritten.

Both hold whole folders that a commit makes visible at once: a result folder counts once Spark has marked it complete, a
bucket once the newest pointer names it. Files are listed and removed through Hadoop's file system, so any store will do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize
from .tables import cache_key

# --- files ------------------------------------------------------------------------------------------------------


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def _text(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path).collect())  # a pointer: one short line


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, False)  # fails where another writer was first
    out.write(bytearray(text.encode()))
    out.close()


# --- results by content ----------------------------------------------------------------------------------------


def cached(rows: DataFrame, content: list[str], compute: Callable[[DataFrame], DataFrame], path: str, version: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the computed columns, the rows that had to be computed).

    A result is kept under SHA-256 of the version and the content columns. compute: takes the content columns of
    distinct contents that are not kept yet, with ``_key``, and returns ``_key`` and its result columns. Equal
    contents are computed once; null contents are a content. What is kept lies in folders by the key's first
    two digits, so a run reads the keys alone until it joins. Runs at one time may compute a content twice; either result will do.
    """
    spark = rows.sparkSession
    parts = [F.concat_ws("\x1f", F.col(c).isNull().cast("string"), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in content]
    keyed = rows.withColumn("_key", cache_key(F.lit(version), *parts))
    folders = [f"{path}/{n}" for n in _names(spark, path) if _exists(spark, f"{path}/{n}/_SUCCESS")]
    known = spark.read.option("basePath", path).parquet(*folders).drop("run", "prefix") if folders else None
    misses = keyed.select("_key", *content).dropDuplicates(["_key"])
    misses = materialize(misses.join(known.select("_key"), "_key", "left_anti") if known is not None else misses, "cache-misses")
    made = compute(misses)
    if not misses.isEmpty():
        made.withColumn("prefix", F.substring("_key", 1, 2)).write.partitionBy("prefix").parquet(f"{path}/run={uuid.uuid4().hex}")
        folders = [f"{path}/{n}" for n in _names(spark, path) if _exists(spark, f"{path}/{n}/_SUCCESS")]
        known = spark.read.option("basePath", path).parquet(*folders).drop("run", "prefix")
    results = known.dropDuplicates(["_key"]) if known is not None else made
    return keyed.join(results, "_key", "left").drop("_key"), misses


# --- rows by key -------------------------------------------------------------------------------------------------

BUCKETS = 64


def _pointer(spark: SparkSession, path: str) -> tuple[int, dict]:
    """(number, content) of the newest pointer: which folder holds each bucket, and the last batch that was merged."""
    numbers = [int(n.split("-")[1].split(".")[0]) for n in _names(spark, f"{path}/pointers")]
    if not numbers:
        return -1, {"buckets": {}, "batch": -1}
    return max(numbers), json.loads(_text(spark, f"{path}/pointers/pointer-{max(numbers):012d}.json"))


def current(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows as they are; a table that nothing was written to is empty."""
    _, said = _pointer(spark, path)
    folders = [f"{path}/{folder}/bucket={b}" for b, folder in said["buckets"].items()]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def upsert(rows: DataFrame, path: str, key: list[str], order: list[str], batch: int | None = None, deleted: Column | None = None, buckets: int = BUCKETS) -> int:
    """Keeps of each key the row of greatest order; returns how many buckets were rewritten.

    Only the buckets of the given rows' keys are read and written again, a new pointer then names their folders, and
    the old ones are removed. batch: a number that grows; one that was merged already is passed over, so a
    retried micro-batch does nothing. deleted: a condition on rows whose keys go. The number of buckets must not change.
    """
    spark, schema = rows.sparkSession, rows.schema
    number, said = _pointer(spark, path)
    if batch is not None and batch <= said["batch"]:
        return 0
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    rows = materialize(rows, "upsert")
    touched = [r.bucket for r in rows.select(bucket.alias("bucket")).distinct().collect()]  # at most ``buckets`` numbers
    old = [f"{path}/{said['buckets'][str(b)]}/bucket={b}" for b in touched if str(b) in said["buckets"]]
    both = spark.read.schema(schema).parquet(*old).unionByName(rows) if old else rows
    rest = [c for c in schema.names if c not in key]
    best = both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_x")).select(*key, *[F.col(f"_x.{c}").alias(c) for c in rest]).select(*schema.names)
    best = best.filter(~F.coalesce(deleted, F.lit(False))) if deleted is not None else best
    folder = f"data-{uuid.uuid4().hex}"
    best.withColumn("bucket", bucket).repartition(max(1, len(touched)), "bucket").write.partitionBy("bucket").parquet(f"{path}/{folder}")
    written = {n.split("=")[1] for n in _names(spark, f"{path}/{folder}") if n.startswith("bucket=")}
    left = {b: f for b, f in said["buckets"].items() if int(b) not in touched} | {b: folder for b in written}
    _write_text(spark, f"{path}/pointers/pointer-{number + 1:012d}.json", json.dumps({"buckets": left, "batch": said["batch"] if batch is None else batch}))
    for f in old:
        _delete(spark, f)
    for n in _names(spark, f"{path}/pointers")[:-2]:  # the one before stays for readers that have just read it
        _delete(spark, f"{path}/pointers/{n}")
    return len(touched)


def sink(path: str, key: list[str], order: list[str], buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the last row of each key; a batch that is retried after its commit is passed over."""

    def merge(batch: DataFrame, number: int) -> None:
        upsert(batch, path, key, order, number, buckets=buckets)

    return merge

"""The folder that driver and executors share, and tables written there to cut a lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder, on a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or f"{tempfile.gettempdir()}/caseloom-shared").rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


@contextmanager
def _set(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def small_batches(spark: SparkSession):
    """Rows reach Python tasks in Arrow batches of bounded size, and are read from Parquet in batches of as many: texts of 4,096 rows are arrays of tens of MB."""
    return _set(spark, {"spark.sql.execution.arrow.maxBytesPerBatch": "2m", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.parquet.columnarReaderBatchSize": "1000"})


def shuffles_dropped(spark: SparkSession):
    """The shuffle files of a query go when it ends, else they stay until the driver happens to collect its garbage: with a large heap, for ever."""
    return _set(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    with small_batches(spark), shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_heap_back(spark: SparkSession) -> None:
    """Executors collect their garbage, after which a heap shrinks to what is in use: else one session's heaps only grow, to their limit.

    A task for each core reaches every idle executor; one that gets none keeps its heap, which changes no result.
    """
    n = 1 if spark.sparkContext.master.startswith("local[") else spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def remove(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes the files of tables that ``materialize`` wrote and that nothing reads any more."""
    home = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark)).getName()
    for t in tables:
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            if f"/{home}/" in folder:
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

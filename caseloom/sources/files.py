"""Files of JSON arrays and snapshots of tables: what can be read is rows, what cannot be is rows too.

Files are read as bytes by Spark, so any store will do; a file is one row until its elements are taken apart. Their size and
time are a signature that tells changed files without reading them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kept import _exists


def signatures(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, signature (of its time and size) of each file of the paths; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    return files.select(F.col("path").alias("file"), F.sha2(F.concat_ws("\x1f", F.unix_micros("modificationTime").cast("string"), F.col("length").cast("string")), 256).alias("signature"))


def changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """file, change (new, changed, gone) of two tables of signatures; unchanged files are not there."""
    both = now.join(before.withColumnRenamed("signature", "_before"), "file", "full")
    change = F.when(F.col("_before").isNull(), "new").when(F.col("signature").isNull(), "gone").when(F.col("signature") != F.col("_before"), "changed")
    return both.select("file", change.alias("change")).filter("change is not null")


def json_elements(spark: SparkSession, paths: list[str], schema: T.StructType, required: str) -> tuple[DataFrame, DataFrame]:
    """(file, position and the schema's columns of each element; file, position and error of what could not be read).

    A file holds one JSON array. One that does not is an error without a position; an element that is no object, or has a null in
    ``required``, is an error at its position. Line breaks, a byte order mark and unknown fields are allowed; files without a byte are passed over; columns that an element lacks are null.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    text = F.regexp_replace(F.decode("content", "UTF-8"), r"\A\x{FEFF}?\s+|\A\x{FEFF}|\s+\z", "")
    parts = files.select(F.col("path").alias("file"), F.from_json(text, "array<string>", {"mode": "PERMISSIVE"}).alias("parts"), text.alias("text"))
    whole = F.startswith("text", F.lit("[")) & F.endswith("text", F.lit("]")) & F.col("parts").isNotNull()
    each = parts.filter(whole).select("file", F.posexplode("parts").alias("position", "part"))
    read = each.select("file", "position", F.from_json("part", schema, {"mode": "PERMISSIVE"}).alias("x"))
    ok = F.col("x").isNotNull() & F.col(f"x.{required}").isNotNull()
    bad = read.filter(~ok).select("file", F.col("position").cast("int").alias("position"), F.lit("no such element").alias("error"))
    return read.filter(ok).select("file", "position", "x.*"), parts.filter(~whole).select("file", F.lit(None).cast("int").alias("position"), F.lit("no JSON array").alias("error")).unionByName(bad)


def inverted(rows: DataFrame, key: str, terms: str) -> DataFrame:
    """term, key: each term of an array column with each row that has it, once; a hot term is many rows, not one cell."""
    return rows.select(F.explode(terms).alias("term"), key).filter("term is not null").distinct()


def snapshot(spark: SparkSession, folder: str, tables: dict[str, tuple[str, str]]) -> dict[str, DataFrame]:
    """name -> rows in the order of their key, of Parquet tables name.parquet: (key, schema as DDL). One that is not there is empty."""
    out = {}
    for name, (key, schema) in tables.items():
        path = f"{folder}/{name}.parquet"
        out[name] = (spark.read.parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)).orderBy(key)
    return out

"""Readers and writers: authority rows, key lookups, replace, upsert, delete, insert-or-skip, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

CHUNK = "source_pdf string, chunk_id string, chunk_no int, content string, file_path string, embedding array<float>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks_json(spark: SparkSession, path: str) -> DataFrame:
    """Authority chunks from a JSON array; rows without a chunk_id are dropped, malformed files raise."""
    rows = spark.read.schema(CHUNK).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.filter(F.coalesce("chunk_id", F.lit("")) != "")


def tolerant_json(spark: SparkSession, paths: list[str], schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, what could not be read) of several JSON files."""
    wide = T.StructType(schema.fields + [T.StructField("_corrupt", T.StringType())])
    rows = spark.read.schema(wide).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(paths).withColumn("_file", F.input_file_name())
    return rows.filter("_corrupt is null").drop("_corrupt", "_file"), rows.filter("_corrupt is not null").select("_file", "_corrupt")


def with_defaults(rows: DataFrame, schema: T.StructType, defaults: dict[str, Column]) -> DataFrame:
    """Exactly the schema's columns: unknown ones dropped, missing or null ones set to their default."""
    make = lambda f: F.coalesce(F.col(f.name), defaults[f.name]) if f.name in rows.columns and f.name in defaults else F.col(f.name) if f.name in rows.columns else defaults.get(f.name, F.lit(None))
    return rows.select(*[make(f).cast(f.dataType).alias(f.name) for f in schema.fields])


def lookup(rows: DataFrame, key: str, value) -> DataFrame:
    return rows.filter(F.col(key) == F.lit(value)).limit(1)


def multi_get(rows: DataFrame, key: str, wanted: list) -> DataFrame:
    """Rows of the wanted keys in the order asked for, each key once; missing keys are skipped."""
    order = rows.sparkSession.createDataFrame([(k, i) for i, k in enumerate(dict.fromkeys(wanted))], T.StructType([T.StructField(key, rows.schema[key].dataType), T.StructField("pos", T.LongType())]))
    return rows.join(F.broadcast(order), key)  # as long as the caller's list


def ids(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key).distinct().orderBy(key)


def metric_totals(lines: DataFrame, **labels: str) -> DataFrame:
    """Totals by metric name of a text exposition (column value), of rows with the given labels."""
    rows = lines.filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    for k, v in labels.items():
        rows = rows.filter(F.contains("value", F.lit(f'{k}="{v}"')))
    parsed = rows.select(F.regexp_extract("value", r"^([A-Za-z_:][\w:]*)", 1).alias("name"), F.expr(r"try_cast(regexp_extract(value, '\\s(\\S+)$', 1) as double)").alias("x"))
    return parsed.groupBy("name").agg(F.sum("x").alias("total"))


def gate(rows: DataFrame, n: int, unique: list[str]) -> dict[str, bool]:
    """Integrity of a fixed set: its size, and columns without repeats."""
    got = rows.agg(F.count("*").alias("n"), *[F.count_distinct(c).alias(c) for c in unique]).first()
    return {"size": got["n"] == n} | {c: got[c] == got["n"] for c in unique}


def replace(rows: DataFrame, path: str, key: str) -> None:
    """Full replacement, sorted by key inside each file."""
    rows.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: str, keep: list[str] = (), order: str | None = None) -> DataFrame:
    """New rows win over old ones (the last of equal keys by ``order``); ``keep`` columns fall back to the old value."""
    if order:
        new = new.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).filter("_n = 1").drop("_n")
    cols = [c for c in old.columns if c != key]
    n = new.select(F.col(key), F.lit(True).alias("_new"), *[F.col(c).alias(f"_{c}") for c in cols])
    pick = lambda c: F.coalesce(f"_{c}", c) if c in keep else F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c))
    return old.join(n, key, "full_outer").select(key, *[pick(c).alias(c) for c in cols])


def delete(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def rebuild(authority: DataFrame, prior: DataFrame, key: str, vector: str) -> DataFrame:
    """Index rows from the authority, with the prior vector where the authority has none."""
    p = prior.select(key, F.col(vector).alias("_prior"))
    return authority.join(p, key, "left").withColumn(vector, F.coalesce(vector, "_prior")).drop("_prior")


def insert_or_skip(target: DataFrame, new: DataFrame, key: str, owner: str) -> DataFrame:
    """new with outcome: inserted, skipped (same owner has it) or conflict (another owner has it); of repeated keys the first row is inserted."""
    have = target.groupBy(key).agg(F.min(owner).alias("_owner"), F.lit(True).alias("_there"))
    w = W.partitionBy(key).orderBy(*[c for c in new.columns if c != key])
    rows = new.withColumn("_n", F.row_number().over(w)).withColumn("_first", F.first(owner).over(w)).join(have, key, "left")
    holder = F.when(F.col("_there"), F.col("_owner")).otherwise(F.col("_first"))
    outcome = F.when(F.col("_there").isNull() & (F.col("_n") == 1), "inserted").when(holder.eqNullSafe(F.col(owner)), "skipped").otherwise("conflict")
    return rows.withColumn("outcome", outcome).select(*new.columns, "outcome")


def export_csv(rows: DataFrame, path: str) -> None:
    """CSV with header; arrays and structs as JSON."""
    flat = [F.to_json(c).alias(c) if isinstance(rows.schema[c].dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(c) for c in rows.columns]
    first = flat[0].alias("\ufeff" + rows.columns[0])  # the mark that tells spreadsheets it is UTF-8
    rows.select(first, *flat[1:]).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def append_audit(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def cache_key(*parts: Column, version: str = "1") -> Column:
    """Content address of a result: SHA-256 over its inputs and a version."""
    return F.sha2(F.concat_ws("\x1f", F.lit(version), *parts), 256)


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows")).select("table_name", "n_rows")
        out = one if out is None else out.unionAll(one)
    return out

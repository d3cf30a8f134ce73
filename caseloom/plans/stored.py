"""Queries over files and snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import files
from ..sources import tables as S
from ..sources.shared import new_path
from .registry import query

KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "drafts": "draft_id"}


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n, CAST(min({k}) AS BIGINT) AS first, CAST(max({k}) AS BIGINT) AS last FROM {t}" for t, k in KEYS.items() if t != "drafts") + " UNION ALL SELECT 'drafts', 0, NULL, NULL")
def table_snapshot(spark, sf_dir):
    """Every known table in the order of its key; one of them does not exist."""
    held = files.snapshot(spark, sf_dir, {t: (k, f"{k} long") for t, k in KEYS.items()})
    parts = [rows.agg(F.lit(t).alias("name"), F.count("*").alias("n"), F.min(KEYS[t]).cast("long").alias("first"), F.max(KEYS[t]).cast("long").alias("last")) for t, rows in held.items()]
    return reduce(lambda a, b: a.unionAll(b), parts)


@query("""WITH o AS (SELECT o_custkey % 40 AS g, o_orderkey, o_totalprice FROM orders) SELECT 'rows' AS kind, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM o WHERE g <> 7 AND o_orderkey % 11 <> 0
UNION ALL SELECT 'no such element', count(*), NULL FROM o WHERE g <> 7 AND o_orderkey % 11 = 0 UNION ALL SELECT 'no JSON array', count(DISTINCT g), NULL FROM o WHERE g = 7""")
def tolerant_files(spark, sf_dir):
    """Orders that Spark writes as files of JSON arrays: one file is cut off, in the others some elements lack their key."""
    o = S.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("g"), F.to_json(F.struct(F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderkey")).alias("key"), F.col("o_totalprice").alias("price"), F.lit("x").alias("more"))).alias("x"))
    said = o.groupBy("g").agg(F.concat(F.lit("["), F.array_join(F.collect_list("x"), ",\n".replace("\n", " ")), F.when(F.col("g") == 7, "").otherwise("]")).alias("value"))
    path = new_path(spark, "json-files")
    said.repartition("g").write.partitionBy("g").text(path)
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("price", T.DoubleType())])
    good, bad = files.json_elements(spark, [f"{path}/g=*"], schema, "key")
    return good.agg(F.lit("rows").alias("kind"), F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("total")).unionAll(bad.groupBy("error").agg(F.count("*").alias("n")).select(F.col("error").alias("kind"), "n", F.lit(None).cast("double").alias("total")))

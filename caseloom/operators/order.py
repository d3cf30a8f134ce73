"""Order over whole tables without one task that holds them: range partitions, counts, prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.shared import materialize


def placed(rows: DataFrame, order: list[Column | str], groups: list[str] = (), name: str = "place", total: str | None = None) -> DataFrame:
    """rows with their place (long, from 0) in their group; with ``total``, also the group's number of rows.

    Rows are dealt by ranges of (groups, order) and sorted there. Of each partition and group only a count
    goes on; its prefix sums are where the partition's rows begin. So a group of any size is spread over many
    tasks, and the table of counts has a row for each group and each partition that holds some of it.
    Null groups are groups; nulls in the order come where its expressions put them. Rows that are equal in
    groups and order get neighbouring places, in no stated order; they may all meet in one partition, so
    add a column that tells them apart where many are equal.
    """
    groups = list(groups)
    keys = [f"_g{i}" for i in range(len(groups))]
    sort = [F.col(k).asc_nulls_first() for k in keys] + [F.col(c).asc() if isinstance(c, str) else c for c in order]
    dealt = rows.withColumns({k: F.col(g) for k, g in zip(keys, groups)}) if groups else rows
    dealt = dealt.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_at", F.monotonically_increasing_id())
    dealt = materialize(dealt, "placed").withColumn("_part", F.shiftright("_at", 33).cast("long"))
    held = dealt.groupBy("_part", *keys).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    by = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))  # without groups: a row for each partition
    before = F.coalesce(F.sum("_n").over(by.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = held.select("_part", *[F.col(k).alias(f"{k}_") for k in keys], (before - F.col("_first")).alias("_base"), F.sum("_n").over(by).alias("_total")).withColumnRenamed("_part", "_part_")
    same = F.col("_part") == F.col("_part_")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    out = dealt.join(base, same)
    made = [(F.col("_at") + F.col("_base")).cast("long").alias(name)] + ([F.col("_total").cast("long").alias(total)] if total else [])
    return out.select(*rows.columns, *made)


def first_rows(rows: DataFrame, n: int, order: list[Column | str]) -> DataFrame:
    """The first n rows of a whole table: each task keeps n, the last one merges them (n is the caller's bound)."""
    return rows.orderBy(*order).limit(n)


def percent_rank(rows: DataFrame, score: str, name: str = "percent") -> DataFrame:
    """(rows with a lower score) / (rows - 1), as PERCENT_RANK over the whole table: equal scores share the lowest place; one row: 0.

    Places are given to distinct scores, weighted by their rows, so a score that a third of all rows share is one row.
    """
    held = rows.groupBy(score).agg(F.count("*").alias("_n"))
    dealt = materialize(held.repartitionByRange(F.col(score).asc_nulls_first()).sortWithinPartitions(F.col(score).asc_nulls_first()).withColumn("_part", F.spark_partition_id()), "scores")
    inside = W.partitionBy("_part").orderBy(F.col(score).asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    sums = dealt.groupBy("_part").agg(F.sum("_n").alias("_sum"))
    every = W.partitionBy(F.lit(0))  # a row for each partition
    sums = sums.select("_part", F.coalesce(F.sum("_sum").over(every.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"), F.sum("_sum").over(every).alias("_all"))
    below = dealt.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(F.broadcast(sums), "_part")  # sums: at most as many rows as partitions
    below = below.select(F.col(score).alias("_score"), F.when(F.col("_all") > 1, (F.col("_in") + F.col("_base")) / (F.col("_all") - 1)).otherwise(F.lit(0.0)).alias(name))
    return rows.join(below, F.col(score).eqNullSafe(F.col("_score"))).drop("_score")

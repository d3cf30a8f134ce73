"""Joins of cases, chunks and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def members(cases: DataFrame, array: str, rows: DataFrame, key: str, case_key: str = "case_id") -> DataFrame:
    """1:N through an id array: the array's order is in ``pos``, missing ids are skipped."""
    return cases.select(case_key, F.posexplode(array).alias("pos", key)).join(rows, key)


def reverse_index(cases: DataFrame, array: str, key: str, case_key: str = "case_id") -> DataFrame:
    return cases.select(case_key, F.explode(array).alias(key)).groupBy(key).agg(F.sort_array(F.collect_set(case_key)).alias("case_ids"))


def compare_ids(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """key, state: missing, extra or common (a full outer join of distinct keys: one shuffle a side)."""
    e, a = expected.select(key).distinct().withColumn("_e", F.lit(1)), actual.select(key).distinct().withColumn("_a", F.lit(1))
    state = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "extra").otherwise("common")
    return e.join(a, key, "full_outer").select(key, state.alias("state"))


def orphans(refs: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return refs.join(rows.select(key).distinct(), key, "left_anti")


def either(rows: DataFrame, a: DataFrame, a_key: str, b: DataFrame, b_key: str, unique: str) -> DataFrame:
    """Rows whose a_key is in a or whose b_key is in b, once: two semi-joins instead of an OR loop."""
    first = rows.join(a.select(a_key).distinct(), a_key, "left_semi").select(*rows.columns)
    second = rows.join(b.select(b_key).distinct(), b_key, "left_semi").select(*rows.columns)
    return first.unionByName(second).dropDuplicates([unique])


def by_ids_or_source(chunks: DataFrame, ids: DataFrame, sources: DataFrame) -> DataFrame:
    """By chunk ids if there are any, otherwise by source."""
    if ids.isEmpty():
        return chunks.join(sources.select("source_pdf").distinct(), "source_pdf", "left_semi")
    return chunks.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")


def span_overlap(left: DataFrame, right: DataFrame, on: str, width: int) -> DataFrame:
    """left(on, start, end) and right(on, start_r, end_r): half-open spans that overlap, each pair once.

    Both sides are dealt by (on, bin of ``width``), so a long document does not become one task's loop;
    a pair counts in the bin where the later of its starts lies.
    """
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.greatest(F.col(e) - 1, F.col(s))) / width)))
    a, b = left.withColumn("_bin", bins("start", "end")), right.withColumn("_bin", bins("start_r", "end_r"))
    both = a.join(b, [on, "_bin"]).filter((F.col("start") < F.col("end_r")) & (F.col("end") > F.col("start_r")))
    return both.filter(F.floor(F.greatest("start", "start_r") / width) == F.col("_bin")).drop("_bin")


def previous(rows: DataFrame, group: str, order: str, when: Column, value: str, out: str) -> DataFrame:
    """Backward as-of, strict: the value of the last earlier row of the group for which ``when`` holds."""
    w = W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn(out, F.last(F.when(when, F.col(value)), ignorenulls=True).over(w))


def paired(left: DataFrame, right: DataFrame, key: str, limit: int) -> DataFrame:
    """x and y of the same case, the first ``limit`` by key."""
    return left.join(right, key).orderBy(key).limit(limit)


def pairs_within(rows: DataFrame, group: str, label: str) -> DataFrame:
    """Unordered pairs of different labels in a group, once for each group."""
    sets = rows.groupBy(group).agg(F.sort_array(F.collect_set(label)).alias("_s"))
    a = sets.select(group, "_s", F.posexplode("_s").alias("_i", "a"))
    return a.select(group, "a", F.explode(F.slice("_s", F.col("_i") + 2, F.greatest(F.size("_s") - F.col("_i") - 1, F.lit(0)))).alias("b"))


def sharing(cases: DataFrame, array: str, same: str, case_key: str = "case_id") -> DataFrame:
    """Cases that share an element with another case of equal ``same`` (counted on the shuffle, not paired)."""
    rows = cases.select(case_key, same, F.explode(F.array_distinct(array)).alias("_x"))
    both = rows.groupBy(same, "_x").agg(F.min(case_key).alias("_a"), F.max(case_key).alias("_b")).filter("_a <> _b")
    return rows.join(both, [same, "_x"]).select(case_key).distinct()


def best_overlap(left: DataFrame, right: DataFrame, n: int, least: float, keep: int, doc: str, min_share: str = "overlap") -> DataFrame:
    """n-gram overlap coefficient between texts of the same document: left(id_l, text_l), right(id_r, text_r)."""
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n))))
    a = left.withColumn("_g", grams(F.col("text_l"))).select(doc, "id_l", F.size("_g").alias("_nl"), F.explode("_g").alias("_x"))
    b = right.withColumn("_g", grams(F.col("text_r"))).select(doc, "id_r", F.size("_g").alias("_nr"), F.explode("_g").alias("_x"))
    hits = a.join(b, [doc, "_x"]).groupBy(doc, "id_l", "id_r").agg(F.count("*").alias("_n"), F.first("_nl").alias("_nl"), F.first("_nr").alias("_nr"))
    hits = hits.withColumn(min_share, F.col("_n") / F.least("_nl", "_nr")).filter(F.col(min_share) >= least)
    w = W.partitionBy(doc, "id_l").orderBy(F.desc(min_share), "id_r")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep).drop("_n", "_nl", "_nr")

"""Retrieval and answer metrics over arrays of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _edges(expected: Column, actual: Column, value: Column) -> Column:
    """Nothing expected: 1 if nothing came, else 0; nothing came though expected: 0."""
    return F.when(F.size(expected) == 0, (F.size(actual) == 0).cast("double")).when(F.size(actual) == 0, 0.0).otherwise(value)


def hit_at(expected: Column, actual: Column, k: int) -> Column:
    a = F.array_distinct(actual)
    return _edges(expected, a, F.arrays_overlap(F.slice(a, 1, k), expected).cast("double"))


def recall_at(expected: Column, actual: Column, k: int) -> Column:
    a, e = F.array_distinct(actual), F.array_distinct(expected)
    return _edges(expected, a, F.size(F.array_intersect(F.slice(a, 1, k), e)) / F.size(e))


def reciprocal_rank(expected: Column, actual: Column) -> Column:
    a = F.array_distinct(actual)
    places = F.filter(F.transform(a, lambda x, i: F.when(F.array_contains(expected, x), i + 1)), lambda p: p.isNotNull())
    return _edges(expected, a, F.coalesce(1.0 / F.array_min(places), F.lit(0.0)))


def evidence_hit(expected: Column, actual: Column) -> Column:
    return _edges(expected, actual, F.arrays_overlap(expected, actual).cast("double"))


def fact_coverage(facts: Column, text: Column) -> Column:
    """Share of facts in the text; a fact may list alternatives with | (empty ones are none), an empty fact counts as covered."""
    options = lambda f: F.filter(F.transform(F.split(f, r"\|"), lambda a: F.trim(a)), lambda a: a != "")
    any_of = lambda f: F.contains(f, F.lit("|")) & (F.size(options(f)) > 0)
    hit = lambda f: (f == "") | F.when(any_of(f), F.exists(options(f), lambda a: F.contains(text, a))).otherwise(F.contains(text, f))
    return F.when(F.size(facts) == 0, 1.0).otherwise(F.size(F.filter(facts, hit)) / F.size(facts))


def forbidden_claims(claims: Column, text: Column) -> Column:
    return F.size(F.filter(claims, lambda c: (c != "") & F.contains(text, c)))


def citation_support(cited: Column, evidence: Column) -> Column:
    """Share of distinct citations that the evidence holds; no citations: 1."""
    c = F.array_distinct(cited)
    return F.when(F.size(c) == 0, 1.0).otherwise(F.size(F.array_intersect(c, evidence)) / F.size(c))


def accuracy(rows: DataFrame, expected: str, actual: str) -> DataFrame:
    return rows.agg(F.coalesce(F.round(F.avg(F.col(expected).eqNullSafe(F.col(actual)).cast("double")), 6), F.lit(0.0)).alias("accuracy"))


def backend_report(rows: DataFrame) -> DataFrame:
    """(backend, expected, actual) -> mean hit@3, recall@5 and MRR of each backend."""
    e, a = F.col("expected"), F.col("actual")
    mean = lambda c: F.round(F.avg(c), 6)
    return rows.groupBy("backend").agg(mean(hit_at(e, a, 3)).alias("hit_3"), mean(recall_at(e, a, 5)).alias("recall_5"), mean(reciprocal_rank(e, a)).alias("mrr"), F.count("*").alias("n"))


def load_summary(rows: DataFrame, ms: str, ok: str) -> DataFrame:
    return rows.agg(F.expr(f"percentile_disc(0.5) within group (order by {ms})").alias("p50"), F.expr(f"percentile_disc(0.95) within group (order by {ms})").alias("p95"), F.max(ms).alias("max_ms"), F.round(F.avg((~F.col(ok)).cast("double")), 6).alias("error_rate"), F.count("*").alias("n"))


def failure_reasons(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds the names of the failed rules."""
    return rows.withColumn("reasons", F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()])))

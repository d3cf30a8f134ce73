"""Checks of proposed facts, values of months, derived facts; facts.py finds facts in texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalars import sentences, wind_force

#: The metrics, what names them, the units that fit, and their plausible range.
METRICS = [
    ("temperature", ["气温", "温度", "temperature"], ["℃", "°C", "摄氏度"], (-60.0, 55.0)),
    ("precipitation", ["降水", "雨量", "降雨", "rain"], ["mm", "毫米"], (0.0, 2000.0)),
    ("wind", ["风速", "阵风", "大风", "wind"], ["m/s", "米/秒"], (0.0, 120.0)),
    ("visibility", ["能见度", "visibility"], ["km", "公里", "千米", "m", "米"], (0.0, 100_000.0)),
    ("hail", ["冰雹", "hail"], ["mm", "毫米", "cm", "厘米"], (0.0, 500.0)),
]

def unit_fits(metric: Column, u: Column, metrics=METRICS) -> Column:
    ok = F.lit(False)
    for name, _, units, _ in metrics:
        ok = ok | ((metric == name) & u.isin(units))
    return ok


def checked(proposed: DataFrame, chunks: DataFrame, key: str, text: str) -> DataFrame:
    """Proposed facts with the reason they are rejected for (null: accepted)."""
    both = proposed.join(chunks.select(key, F.col(text).alias("_t")), key, "left")
    said = F.transform(F.regexp_extract_all("_t", F.lit(r"[-−]?\d+(?:\.\d+)?"), F.lit(0)), lambda x: F.replace(x, F.lit("−"), F.lit("-")).cast("double"))
    there = F.exists(said, lambda x: (x == F.col("value")) | (F.abs(x) == F.col("value")))  # a dash before a number may join a range
    reason = F.when(F.col("_t").isNull(), "unknown chunk").when(~there, "value not in text").when(~unit_fits(F.col("metric"), F.col("unit")), "unit does not fit")
    return both.withColumn("reason", reason).drop("_t")


def numbers(rows: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """(key, n, value) of every number the pattern's first group finds."""
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))
    return rows.select(key, F.posexplode(found).alias("n", "v")).select(key, F.col("n").cast("long").alias("n"), F.col("v").cast("double").alias("value"))


def month_values(chunks: DataFrame, key: str, text: str, months: list[int], words: list[str]) -> DataFrame:
    """First number after a metric's name in the sentences that name a month."""
    pattern = "(?:" + "|".join(words) + r")[^。；]{0,40}?([-−]?\d+(?:\.\d+)?)"
    held = lambda s: F.contains(s, F.lit("月")) & reduce(lambda a, b: a | b, [F.contains(s, F.lit(w)) for w in words])
    rows = chunks.select(key, F.explode(F.filter(sentences(F.col(text)), held)).alias("s"))  # the other sentences are not read again
    v = F.replace(F.regexp_extract("s", pattern, 1), F.lit("−"), F.lit("-")).try_cast("double")
    named = F.filter(F.array(*map(F.lit, months)), lambda m: F.contains("s", F.concat(m.cast("string"), F.lit("月"))))
    return rows.select(key, named.alias("named"), v.alias("value")).dropna(subset=[key, "value"]).select(key, F.explode("named").alias("month"), "value")


def derived_wind(found: DataFrame, case: str) -> DataFrame:
    """Adds a wind-force fact from the best speed of cases that have none."""
    best = found.filter("metric = 'wind'").groupBy(case).agg(F.max_by(F.struct("value", "confidence"), F.struct("value", "confidence")).alias("_b"))
    have = found.filter("metric = 'wind_force'").select(case).distinct()
    new = best.join(have, case, "left_anti").select(case, F.lit("wind_force").alias("metric"), wind_force(F.col("_b.value")).cast("double").alias("value"), F.least(F.col("_b.confidence"), F.lit(0.78)).alias("confidence"))
    return found.select(case, "metric", "value", "confidence").unionByName(new)


def nearest_time(rows: DataFrame, group: str, order: str, stamp: Column) -> DataFrame:
    """Each fact gets the time named last before it in its document."""
    w = W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("time", F.last(stamp, ignorenulls=True).over(w))

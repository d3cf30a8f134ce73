"""Queries over facts in texts: reports that Spark writes from line items, and the words around numbers in documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import aggregates
from ..operators import facts as N
from ..sources import tables as S
from .registry import query

PLACE_OF = {"A": "原平", "N": "河曲", "R": "五台"}


def reports(spark, sf_dir):
    """l_orderkey, text: a report of each order, a passage for each line, by number, day, then what they say. Only columns are shuffled; passages are written where an order's lines meet."""
    place = F.create_map(*[F.lit(x) for kv in PLACE_OF.items() for x in kv])

    def said(x):
        q = x["q"]
        return F.concat(
            F.month(x["day"]), F.lit("月"), F.dayofmonth(x["day"]), F.lit("日累计降水量最高达"), q, F.lit("毫米（"), F.try_element_at(place, x["flag"]), F.lit("）。局地出现"), q % 4 + 5, F.lit("-"), q % 4 + 8,
            F.lit("级雷暴大风；最高气温介于"), q + 5, F.lit("～"), q + 20, F.lit("℃。\n能见度"), q * 10, F.lit("米，后升\n至1.5公里。"), F.when(x["flag"] == "R", "预警区域内阵风可达9级。").otherwise(""),
        )

    line = F.struct("l_linenumber", F.col("l_shipdate").alias("day"), F.col("l_quantity").cast("int").alias("q"), F.col("l_returnflag").alias("flag"))
    lines = S.table(spark, sf_dir, "lineitem").select("l_orderkey", line.alias("x"))
    passages = F.transform(F.collect_list("x"), lambda x: F.struct(x["l_linenumber"].alias("number"), x["day"].alias("day"), said(x).alias("said")))  # an order has a few lines
    return lines.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(passages), lambda x: x["said"]), "").alias("text"))


LINES = "WITH l AS (SELECT l_orderkey, CAST(l_quantity AS INTEGER) AS q, l_returnflag AS f, month(l_shipdate) AS m, day(l_shipdate) AS d FROM lineitem) "


@query(LINES + """SELECT DISTINCT l_orderkey, metric, value, unit, relation FROM (
SELECT l_orderkey, 'process_rain' AS metric, CAST(q AS DOUBLE) AS value, 'mm' AS unit, 'text' AS relation FROM l UNION ALL SELECT l_orderkey, 'wind_force', q % 4 + 8, '级', 'range' FROM l
UNION ALL SELECT l_orderkey, 'max_temperature', q + 20, '℃', 'text' FROM l WHERE q + 20 BETWEEN 30 AND 55 UNION ALL SELECT l_orderkey, 'visibility', q * 10 / 1000.0, 'km', 'text' FROM l UNION ALL SELECT l_orderkey, 'visibility', 1.5, 'km', 'text' FROM l)""")
def intensity_facts(spark, sf_dir):
    return N.facts(reports(spark, sf_dir), "l_orderkey", "text", fields=("metric", "value", "unit", "relation"), which="observed", once=True)  # an order has one report


@query(LINES + """SELECT metric, reason, relation, CAST(sum(n) AS BIGINT) AS n FROM (SELECT 'wind_force' AS metric, 'forecast' AS reason, 'text' AS relation, 2 AS n FROM l WHERE f = 'R'
UNION ALL SELECT 'max_temperature', 'not plausible', 'range', 1 FROM l WHERE q + 20 NOT BETWEEN 30 AND 55 UNION ALL SELECT 'max_temperature', 'not plausible', 'text', 1 FROM l WHERE q + 20 > 55 OR q + 20 BETWEEN 25 AND 29) GROUP BY 1, 2, 3""")
def rejected_facts(spark, sf_dir):
    found = N.facts(reports(spark, sf_dir), "l_orderkey", "text", fields=("metric", "relation", "reason"), which="rejected")
    return found.groupBy("metric", "reason", "relation").agg(F.count("*").alias("n"))


@query(LINES + "SELECT l_orderkey, CAST(q AS DOUBLE) AS value, 'mm' AS unit, m || '-' || d AS time, CASE f WHEN 'A' THEN '原平' WHEN 'N' THEN '河曲' ELSE '五台' END AS place FROM l")
def metric_readings(spark, sf_dir):
    return N.readings(reports(spark, sf_dir), "l_orderkey", "text", N.SPECS["precipitation"]).select("l_orderkey", F.col("normalized_value").alias("value"), F.col("normalized_unit").alias("unit"), "time", "place")


@query("""WITH l AS (SELECT l_orderkey, CAST(l_quantity AS INTEGER) AS q, first_value(month(l_shipdate)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate) AS m FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY q, l_orderkey) AS n FROM l) SELECT CAST(m AS VARCHAR) AS month, CAST(q * 10 AS DOUBLE) AS metres, l_orderkey FROM r WHERE n = 1""")
def lowest_visibility(spark, sf_dir):
    """The lowest visibility of each month, with the order that proves it; sentences without a day are of the report's first one."""
    found = N.readings(reports(spark, sf_dir), "l_orderkey", "text", N.SPECS["visibility"], names=("能见度",))
    found = found.withColumn("month", F.substring_index("time", "-", 1))
    return found.groupBy("month").agg(F.min("normalized_value").cast("double").alias("metres"), F.min_by("l_orderkey", F.struct("normalized_value", "l_orderkey")).alias("l_orderkey"))


#: What stands before a number and which word behind it, in English and German texts.
VOCABULARY = {
    "en": (("from", "by", "with", "in", "of", "at", "on", "to", "the"), ("the", "of", "in", "a", "is", "and", "on", "this", "for", "that", "with", "it", "to")),
    "de": (("mit", "von", "der", "die", "und", "ein", "das"), ("der", "die", "das", "und", "ein", "von", "mit", "in", "ist")),
}
RULES = tuple(N.Rule(lang, before, {w: w for w in behind}, 80, words=True, relation="words") for lang, (before, behind) in VOCABULARY.items())


def _said(table: str, key: str, text: str) -> str:
    one = lambda lang, before, behind: f"""SELECT {key}, '{lang}' AS metric, unnest(regexp_extract_all({text}, p, 1)) AS v, unnest(regexp_extract_all({text}, p, 2)) AS u FROM (SELECT *, '(?i)\\b(?:{"|".join(before)})\\b[^。；;]{{0,79}}?[^0-9.。；;]([0-9]+(?:\\.[0-9]+)?)\\s*({"|".join(sorted(behind, key=lambda w: (-len(w), w)))})\\b' AS p FROM {table})"""
    parts = " UNION ALL ".join(one(lang, *words) for lang, words in VOCABULARY.items())
    return f"SELECT {key}, metric, CAST(v AS DOUBLE) AS value, lower(u) AS unit FROM ({parts})"


@query(_said("documents", "doc_id", "text"))
def document_facts(spark, sf_dir):
    return N.facts(S.table(spark, sf_dir, "documents"), "doc_id", "text", RULES, "。；;", (), stations=False, join_lines=False).select("doc_id", "metric", "value", "unit")


@query(_said("pages", "page_id", "html"))
def page_facts(spark, sf_dir):
    return N.facts(S.table(spark, sf_dir, "pages"), "page_id", "html", RULES, "。；;", (), stations=False, join_lines=False).select("page_id", "metric", "value", "unit")


# --- months ----------------------------------------------------------------------------------------------------

joined = lambda c: F.array_join(F.transform(c, lambda m: m.cast("string")), ",")


@query("""WITH o AS (SELECT o_orderkey, month(o_orderdate) AS a, day(o_orderdate) AS d, (month(o_orderdate) + 3) % 12 + 1 AS b FROM orders),
s AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CASE WHEN a <= b THEN range(a, b + 1) ELSE range(a, 13) || range(1, b + 1) END WHEN 1 THEN [a, b] ELSE [a] END AS m FROM o)
SELECT o_orderkey, array_to_string(list_sort(list_distinct(m)), ',') AS months FROM s""")
def months_named(spark, sf_dir):
    """Ranges of months, ranges of days over two months, ranges of days in one."""
    a, d = F.month("o_orderdate"), F.dayofmonth("o_orderdate")
    b = (a + 3) % 12 + 1
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(a, F.lit("月至"), b, F.lit("月"))).when(F.col("o_orderkey") % 3 == 1, F.concat(a, F.lit("月"), d, F.lit("-"), b, F.lit("月3日"))).otherwise(F.concat(a, F.lit("月"), d, F.lit("-"), d + 1, F.lit("日")))
    return S.table(spark, sf_dir, "orders").select("o_orderkey", joined(X.months(text)).alias("months"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '1,' || CAST(2 + o_orderkey % 9 AS VARCHAR) WHEN o_orderkey % 4 = 1 THEN CAST(month(o_orderdate) AS VARCHAR)
WHEN o_orderkey % 4 = 2 THEN CAST(month(o_orderdate) AS VARCHAR) ELSE '' END AS months FROM orders""")
def month_sources(spark, sf_dir):
    """Months from a list, else from a date, else from a text with an ISO date or days of a month."""
    which, day = F.col("o_orderkey") % 4, F.col("o_orderdate")
    text = F.when(F.col("o_orderkey") % 8 == 2, F.date_format(day, "yyyy-MM-dd")).when(which == 2, F.concat(F.month(day), F.lit("月"), F.dayofmonth(day), F.lit("-"), F.dayofmonth(day) + 1, F.lit("日"))).otherwise("5-7")
    listed = F.when(which == 0, F.array(F.lit(1), (2 + F.col("o_orderkey") % 9).cast("int"))).otherwise(F.array().cast("array<int>"))
    found = aggregates.month_of(("months", listed), ("date", F.when(which == 1, day.cast("date"))), ("text", text))
    return S.table(spark, sf_dir, "orders").select("o_orderkey", joined(found).alias("months"))

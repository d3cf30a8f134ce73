"""Queries over requests of a dialogue and over the evidence of cases."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import build
from ..operators import evidence as V
from ..operators import requests as R
from ..sources import tables as S
from .registry import query

D = datetime.date

# --- requests --------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) > DATE '1996-06-30' THEN 'after' WHEN CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) + 30 ELSE CAST(o_orderdate AS DATE) END < DATE '1995-01-01' THEN 'before' ELSE 'inside' END AS relation FROM orders""")
def library_relation(spark, sf_dir):
    day = F.to_date("o_orderdate")
    asked = R.asked_interval(day, F.when(F.col("o_orderkey") % 2 == 0, F.date_add(day, 30)), F.array().cast("array<int>"), F.array().cast("array<int>"))
    return S.table(spark, sf_dir, "orders").select("o_orderkey", R.relation(asked, F.lit(D(1995, 1, 1)), F.lit(D(1996, 6, 30))).alias("relation"))


@query("SELECT o_custkey, CASE WHEN max(CASE WHEN month(o_orderdate) > 10 AND o_orderkey % 3 > 0 THEN 1 ELSE 0 END) = 1 THEN 'retry' ELSE 'ok' END AS status FROM orders GROUP BY o_custkey")
def answer_review(spark, sf_dir):
    asked = F.when(F.col("o_orderkey") % 3 > 0, F.sequence(F.lit(1), F.lit(10))).otherwise(F.array().cast("array<int>"))
    rows = S.table(spark, sf_dir, "orders").select("o_custkey", asked.alias("asked"), F.array(F.month("o_orderdate")).alias("months"))
    return R.review(rows, "o_custkey", "asked", "months")


@query("""SELECT user_id, max(CASE WHEN place = 1 THEN event_id END) AS event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(value / 50) AS BIGINT) DESC, event_id DESC) AS place FROM events WHERE event_id % 4 < 2) GROUP BY user_id""")
def context_resolution(spark, sf_dir):
    """Lists of one id (odd event_id / 2: of two) for a question that asks back for one case; the newest of equal scores."""
    e = S.table(spark, sf_dir, "events")
    ids = F.when(F.col("event_id") % 4 < 2, F.array("event_id")).otherwise(F.array("event_id", "user_id"))
    rows = e.select("user_id", ids.alias("ids"), F.floor(F.col("value") / 50).alias("score"), F.lit(1).alias("wanted"), (-F.col("event_id")).alias("recency"))
    return R.context_cases(rows, "user_id").select("user_id", F.get("ids", F.lit(0)).alias("event_id"))


# --- projections, filters, orders --------------------------------------------------------------------------------

@query("SELECT p_partkey, coalesce(p_name, '') || ' ' || coalesce(p_brand, '') || ' ' || '' || ' ' || p_type || ' ' || p_brand AS text FROM part")
def text_projection(spark, sf_dir):
    labels = F.array_join(F.array("p_type", "p_brand"), " ")
    return S.table(spark, sf_dir, "part").select("p_partkey", V.case_text("p_name", "p_brand", F.lit(None).cast("string"), labels).alias("text"))


@query("SELECT c_custkey, c_name FROM customer")
def public_columns(spark, sf_dir):
    rows = S.table(spark, sf_dir, "customer").withColumn("api_key_hash", F.lit("x")).withColumn("session_token", F.lit("y"))
    return V.public(rows, ["c_custkey", "c_name", "api_key_hash", "session_token", "absent"])


@query("SELECT p_partkey FROM part WHERE contains(p_name, 'widget') AND (contains(p_name, 'cold') OR contains(p_type, 'cold') OR p_brand = 'cold') AND (contains(p_type, 'ECONOMY') OR p_brand = 'ECONOMY') AND p_type = 'ECONOMY'")
def light_case_search(spark, sf_dir):
    cases = S.table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_name").alias("title"), F.lit("").alias("date_range"), F.col("p_type").alias("summary"), F.lit(None).cast("string").alias("weather_facts"),
        F.array("p_brand").alias("disaster_types"), F.array("p_brand").alias("affected_areas"), F.col("p_type").alias("source_pdf"),
    )
    return V.light_search(cases, "widget", "cold", "ECONOMY", "ECONOMY").select("p_partkey")


@query("SELECT doc_id FROM documents WHERE lang IS DISTINCT FROM 'en' OR source IS NULL")
def missing_evidence(spark, sf_dir):
    ids = F.when(F.col("lang") == "en", F.array_compact(F.array("source"))).otherwise(F.when(F.col("doc_id") % 2 == 0, F.array().cast("array<string>")))
    return V.without_evidence(S.table(spark, sf_dir, "documents").withColumn("ids", ids), "ids").select("doc_id")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY floor(o_totalprice / 50000) DESC, o_orderdate DESC, o_orderkey DESC) AS place FROM orders QUALIFY place <= 100")
def structured_matches(spark, sf_dir):
    rows = S.table(spark, sf_dir, "orders").withColumn("score", F.floor(F.col("o_totalprice") / 50000))
    return V.structured_top(rows, 100, "score", "o_orderdate", "o_orderkey").select("o_orderkey", F.col("place").cast("long").alias("place"))


@query("SELECT 'max' AS operator, event_id FROM (SELECT event_id FROM events WHERE value IS NOT NULL ORDER BY value DESC, event_id LIMIT 50) UNION ALL SELECT 'min', event_id FROM (SELECT event_id FROM events WHERE value IS NOT NULL ORDER BY value, event_id LIMIT 50)")
def extreme_facts(spark, sf_dir):
    e = S.table(spark, sf_dir, "events")
    side = lambda op: V.top_facts(e, op, "value", ["event_id"]).select(F.lit(op).alias("operator"), "event_id")
    return side("max").unionByName(side("min"))


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY first_id, event_id) AS place FROM (SELECT *, min(event_id) OVER (PARTITION BY user_id, event_type) AS first_id FROM events)")
def grouped_display(spark, sf_dir):
    return V.regrouped(S.table(spark, sf_dir, "events"), "user_id", "event_type", "event_id").select("event_id", "user_id", F.col("place").cast("long").alias("place"))


@query("SELECT n_nationkey, CASE n_nationkey WHEN 7 THEN 1 WHEN 3 THEN 2 WHEN 11 THEN 4 END AS place FROM nation")
def supplied_order(spark, sf_dir):
    return S.table(spark, sf_dir, "nation").select("n_nationkey", V.listed_place(F.col("n_nationkey"), [7, 3, 999, 11]).cast("int").alias("place"))


@query("SELECT user_id, event_id, 'tip-' || n AS tip_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 5 = 0 THEN 999 ELSE event_id % 5 END, coalesce(value, 0) DESC, event_id) AS n FROM events) WHERE n <= 4")
def forecast_tips(spark, sf_dir):
    return V.prioritised(S.table(spark, sf_dir, "events"), "user_id", F.col("event_id") % 5, F.col("value"), "event_id").select("user_id", "event_id", "tip_id")


# --- joins and gates ---------------------------------------------------------------------------------------------

@query("SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, n FROM lineitem JOIN (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) USING (l_partkey, l_suppkey)")
def composite_join(spark, sf_dir):
    rows = S.table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_returnflag")
    right = rows.filter("l_returnflag = 'R'").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    return V.by_keys(rows.drop("l_returnflag"), right, ["l_partkey", "l_suppkey"])


@query("""WITH a AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 60), b AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 90)
SELECT coalesce(a.user_id, b.user_id) AS user_id, bool_and(a.user_id IS NOT NULL AND b.user_id IS NOT NULL) AS same FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type GROUP BY 1""")
def complete_sets(spark, sf_dir):
    e = S.table(spark, sf_dir, "events")
    return V.complete(e.filter("value > 60"), e.filter("value > 90"), "user_id", "event_type")


@query("SELECT session_id, o_orderkey FROM (SELECT o_custkey AS session_id, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND c_nationkey = 3 ORDER BY o_custkey, o_orderkey LIMIT 50)")
def failed_run_list(spark, sf_dir):
    runs = S.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_id"), "o_orderkey", "o_orderstatus")
    owned = S.table(spark, sf_dir, "customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("session_id"))
    return V.failed_runs(runs, owned, F.col("o_orderstatus") == "F", ["session_id", "o_orderkey"]).select("session_id", "o_orderkey")


@query("SELECT doc_id, CAST(CASE WHEN doc_id % 3 = 0 THEN 0.45 ELSE 0.0 END AS DOUBLE) AS image, CAST(CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS asked_image, (CASE WHEN contains(text, 'de') THEN 1 ELSE 0 END + CASE WHEN contains(text, 'qu') THEN 1 ELSE 0 END) / 4.0 AS words FROM documents WHERE text IS NOT NULL")
def first_scores(spark, sf_dir):
    rows = S.table(spark, sf_dir, "documents").filter("text is not null")
    n, m = F.when(F.col("doc_id") % 3 == 0, 2).otherwise(0), F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0)
    words = V.text_first(F.col("text"), F.array(F.lit("de"), F.lit("qu")))
    return rows.select("doc_id", V.image_first(n, m, False).alias("image"), V.image_first(n, m, True).alias("asked_image"), words.alias("words"))


# --- evidence ----------------------------------------------------------------------------------------------------

@query("""SELECT source, doc_id, n_terms FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_terms DESC, CAST(doc_id AS VARCHAR) DESC) AS n FROM (SELECT source, doc_id,
CASE WHEN contains(text, 'the') THEN 1 ELSE 0 END + CASE WHEN contains(text, 'sch') THEN 1 ELSE 0 END + CASE WHEN contains(text, 'que') THEN 1 ELSE 0 END AS n_terms FROM documents WHERE doc_id % 7 > 0) WHERE n_terms > 0) WHERE n <= 2""")
def diagnostic_evidence(spark, sf_dir):
    """Two chunks of each source with most different terms; those with an id divisible by seven are used already."""
    d = S.table(spark, sf_dir, "documents")
    used = d.filter("doc_id % 7 = 0").select("source", "doc_id")
    return V.diagnostic_chunks(d, "source", "doc_id", "text", ["the", "sch", "que", "the"], used).select("source", "doc_id", F.col("n_terms").cast("long").alias("n_terms"))


# --- texts, guidance, terms, state -------------------------------------------------------------------------------


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, mark, CASE WHEN mark = '' THEN turn END ORDER BY turn) AS n FROM (SELECT conv_id, turn, lower(role) AS mark FROM conversations)) WHERE n = 1")
def guidance_once(spark, sf_dir):
    rows = S.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("  _"), F.upper("role"), F.lit("！")).alias("prompt"))
    return V.once_each(rows, "conv_id", "prompt", "turn").select("conv_id", "turn")


@query("SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING NOT bool_or(l_suppkey IN (1, 2, 0))")
def foreign_parts(spark, sf_dir):
    rows = S.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("profile"), "l_partkey")
    return V.foreign_terms(rows, [1, 2], 0, "profile", "l_partkey")


@query("SELECT event_id FROM events WHERE event_id % 3 = CASE WHEN user_id % 2 = 0 THEN 2 ELSE user_id % 3 END AND user_id % 5 > 0 AND TIMESTAMP '2024-01-05 00:00:00' < ts + INTERVAL 3 DAY")
def cached_entries(spark, sf_dir):
    e = S.table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_id") % 3).alias("version"), F.col("ts").alias("written"))
    users = e.select("user_id").distinct().filter("user_id % 5 > 0")
    versions = users.select("user_id", F.when(F.col("user_id") % 2 == 0, 2).otherwise(F.col("user_id") % 3).cast("long").alias("version"))
    return V.cached(e, versions, "user_id", F.to_timestamp(F.lit("2024-01-05 00:00:00")), 3 * 86400).select("event_id")


@query("SELECT user_id, CAST(CASE WHEN user_id % 2 = 0 THEN 4 ELSE 0 END + CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS version FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 2 = 0 OR user_id % 3 = 0")
def invalidated_sessions(spark, sf_dir):
    e = S.table(spark, sf_dir, "events")
    versions = e.filter("user_id % 2 = 0").select("user_id", F.lit(4).cast("long").alias("version")).distinct()
    return V.bumped(versions, e.filter("user_id % 3 = 0"), "user_id")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR doc_id % 5 = 0 THEN 'deleted' ELSE 'active' END AS status, CAST(CASE WHEN doc_id % 5 = 0 THEN 1 WHEN doc_id % 3 = 0 THEN 9 END AS BIGINT) AS deleted_at, CASE WHEN doc_id % 3 > 0 AND doc_id % 2 = 0 THEN 1 ELSE 0 END AS indexed FROM documents")
def soft_deleted(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents")
    old = F.col("doc_id") % 5 == 0
    items = d.select("doc_id", F.when(old, "deleted").otherwise("active").alias("status"), F.when(old, F.lit(1).cast("long")).alias("deleted_at"))
    rows, index = V.soft_delete(items, d.filter("doc_id % 2 = 0").select("doc_id"), d.filter("doc_id % 3 = 0"), "doc_id", F.lit(9).cast("long"))
    return rows.join(index.withColumn("indexed", F.lit(1)), "doc_id", "left").select("doc_id", "status", "deleted_at", F.coalesce("indexed", F.lit(0)).alias("indexed"))


# --- build and supplements ---------------------------------------------------------------------------------------

@query("SELECT o_orderkey, o_custkey || '-case-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS case_id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders)")
def numbered_case_ids(spark, sf_dir):
    rows = S.table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("source"), "o_orderkey", "o_orderdate")
    return build.numbered_cases(rows, "source", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "case_id")



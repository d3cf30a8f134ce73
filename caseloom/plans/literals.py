"""Queries over driver tables for column functions, sources, joins, aggregates and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import aggregates, build, evaluation, extraction, filters, joins, ranking, retrieval
from ..sources import tables as S
from .registry import query


# --- column functions ------------------------------------------------------------------------------------------

@query("SELECT o_orderkey, CAST(month(o_orderdate) AS BIGINT) AS a, (month(o_orderdate) + 4) % 12 + 1 AS b, CASE WHEN month(o_orderdate) <= (month(o_orderdate) + 4) % 12 + 1 THEN (month(o_orderdate) + 4) % 12 + 2 - month(o_orderdate) ELSE 14 - month(o_orderdate) + (month(o_orderdate) + 4) % 12 END AS n FROM orders")
def month_spans(spark, sf_dir):
    a = F.month("o_orderdate")
    rows = S.table(spark, sf_dir, "orders").select("o_orderkey", a.alias("a"), ((a + 4) % 12 + 1).alias("b"))
    return rows.select("o_orderkey", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.size(X.month_span(F.col("a"), F.col("b"))).cast("long").alias("n"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_linenumber + 1 AS BIGINT) AS days, CAST(month(l_shipdate) * 100 + day(l_shipdate) AS BIGINT) AS first_day FROM lineitem")
def inclusive_days(spark, sf_dir):
    start = F.to_date("l_shipdate")
    end = F.date_add(start, F.col("l_linenumber").cast("int"))
    first = F.get(X.month_days(start, end), F.lit(0))
    return S.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", X.duration_days(start, end).cast("long").alias("days"), (first["month"] * 100 + first["day"]).cast("long").alias("first_day"))


@query("SELECT doc_id, lang, list_aggregate(list_distinct(CASE WHEN lang = 'en' THEN ['en', 'west', 'island'] WHEN lang = 'de' THEN ['de', 'west'] ELSE [lang] END), 'count') AS n FROM documents")
def expanded_labels(spark, sf_dir):
    rows = S.table(spark, sf_dir, "documents")
    return rows.select("doc_id", "lang", F.size(X.expanded(F.array("lang"), {"en": ["west", "island"], "de": ["west"]})).cast("long").alias("n"))


@query("SELECT doc_id, CASE WHEN length(flat) > 160 THEN regexp_replace(substring(flat, 1, 160), '[，、；：,;:。]+$', '') || '。' ELSE flat END AS short FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\s\\x0b\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', '', 'g') AS flat FROM documents)")
def compact_text(spark, sf_dir):
    rows = S.table(spark, sf_dir, "documents")
    return rows.select("doc_id", X.compact(F.coalesce("text", F.lit(""))).alias("short"))


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'other' END AS kind FROM events")
def one_of_kinds(spark, sf_dir):
    return S.table(spark, sf_dir, "events").select("event_id", X.one_of(F.col("event_type"), ["click", "view"]).alias("kind"))


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN 'new' ELSE 'old' END AS a, event_type AS b, CASE WHEN event_type = 'click' THEN 'x' END AS c FROM events")
def merged_state(spark, sf_dir):
    old = F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.col("event_type"))
    patch = F.when(F.col("event_type") == "click", F.create_map(F.lit("a"), F.lit("new"), F.lit("c"), F.lit("x"))).otherwise(F.expr("cast(map() as map<string,string>)"))
    m = X.merged(old, patch)
    return S.table(spark, sf_dir, "events").select("event_id", *[F.try_element_at(m, F.lit(k)).alias(k) for k in "abc"])


@query("SELECT doc_id, sha256('1' || chr(31) || CAST(doc_id AS VARCHAR) || chr(31) || source) AS key FROM documents")
def cache_keys(spark, sf_dir):
    return S.table(spark, sf_dir, "documents").select("doc_id", S.cache_key(F.col("doc_id").cast("string"), F.col("source")).alias("key"))


# --- sources ---------------------------------------------------------------------------------------------------


@query("SELECT doc_id, source, lang FROM documents WHERE doc_id = 7")
def point_lookup(spark, sf_dir):
    return S.lookup(S.table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id", 7)


@query("SELECT DISTINCT l_suppkey FROM lineitem")
def all_ids(spark, sf_dir):
    return S.ids(S.table(spark, sf_dir, "lineitem"), "l_suppkey")


@query("SELECT vec_id, round(CASE WHEN vec_id % 3 = 0 THEN CASE WHEN vec_id % 2 = 0 THEN CAST(embedding[2] AS DOUBLE) END ELSE CAST(embedding[1] AS DOUBLE) END, 6) AS v FROM embeddings")
def index_rebuild(spark, sf_dir):
    v = S.table(spark, sf_dir, "embeddings")
    authority = v.select("vec_id", F.when(F.col("vec_id") % 3 != 0, F.get("embedding", F.lit(0))).cast("double").alias("v"))
    prior = v.filter("vec_id % 2 = 0").select("vec_id", F.get("embedding", F.lit(1)).cast("double").alias("v"))
    return S.rebuild(authority, prior, "vec_id", "v").select("vec_id", F.round("v", 6).alias("v"))


# --- filters ---------------------------------------------------------------------------------------------------


@query("SELECT doc_id FROM documents WHERE list_has_any([lang, source], ['de', 'en'])")
def contains_any_label(spark, sf_dir):
    return S.table(spark, sf_dir, "documents").filter(filters.contains_any(F.array("lang", "source"), ["de", "en"])).select("doc_id")


@query("""SELECT event_id, NOT event_type = 'error' AND (event_type <> 'click' OR ts + INTERVAL 5 DAY > TIMESTAMP '2024-01-15') AS live, event_type <> 'error' AS active,
event_type <> 'error' AND (event_type <> 'click' OR ts + INTERVAL 5 DAY > TIMESTAMP '2024-01-15') AS strict FROM events""")
def live_and_active(spark, sf_dir):
    now = F.lit("2024-01-15").cast("timestamp_ntz")
    gone, expires = F.when(F.col("event_type") == "error", F.col("ts")), F.when(F.col("event_type") == "click", F.col("ts") + F.expr("interval 5 days"))
    active = lambda *more: filters.active_memory(F.lit("active"), gone, *more)
    return S.table(spark, sf_dir, "events").select("event_id", filters.live(gone, expires, now).alias("live"), active().alias("active"), active(expires, now).alias("strict"))


# --- joins and aggregates --------------------------------------------------------------------------------------


def _baskets(spark, sf_dir):
    rows = S.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    return rows.select(F.col("l_orderkey").alias("case_id"), F.transform("x", lambda s: s["l_partkey"]).alias("parts"))


@query("SELECT l_orderkey AS case_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS pos, p_partkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey")
def case_members(spark, sf_dir):
    part = S.table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return joins.members(_baskets(spark, sf_dir), "parts", part, "p_partkey").select("case_id", F.col("pos").cast("long").alias("pos"), "p_partkey", "p_brand")


@query("SELECT l_partkey AS part, count(DISTINCT l_orderkey) AS n, min(l_orderkey) AS least, max(l_orderkey) AS most FROM lineitem GROUP BY 1")
def cases_of_part(spark, sf_dir):
    found = joins.reverse_index(_baskets(spark, sf_dir), "parts", "part")
    return found.select("part", F.size("case_ids").cast("long").alias("n"), F.get("case_ids", F.lit(0)).alias("least"), F.element_at("case_ids", -1).alias("most"))


@query("SELECT doc_id, 'ids' AS branch FROM documents WHERE doc_id % 100 = 0 UNION ALL SELECT doc_id, 'source' FROM documents WHERE source IN (SELECT source FROM documents WHERE doc_id % 100 = 0)")
def ids_or_source(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("source_pdf"))
    few = d.filter("chunk_id % 100 = 0")
    of = lambda ids, name: joins.by_ids_or_source(d, ids, few).select(F.col("chunk_id").alias("doc_id"), F.lit(name).alias("branch"))
    return of(few, "ids").unionByName(of(few.limit(0), "source"))


@query("""SELECT user_id, place AS event_id, event_type FROM (SELECT *, min(event_id) OVER (PARTITION BY user_id) AS place, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END DESC, event_id) rn FROM events) WHERE rn = 1""")
def upgraded_facts(spark, sf_dir):
    rows = S.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    rank = F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "signup", 1).otherwise(0)
    return aggregates.upgrade(rows, ["user_id"], rank, "event_id")


@query("""WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM events),
a AS (SELECT user_id, max(pos) AS a FROM r WHERE event_type = 'purchase' GROUP BY 1), h AS (SELECT r.user_id, max(pos) AS h FROM r JOIN a USING (user_id) WHERE event_type = 'signup' AND pos < a GROUP BY 1)
SELECT user_id, event_id FROM r JOIN a USING (user_id) LEFT JOIN h USING (user_id) WHERE pos BETWEEN coalesce(h, a) AND a + 1""")
def between_marks(spark, sf_dir):
    rows = ranking.number(S.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], [F.asc("event_id")], "pos")
    return ranking.between_headings(rows, "user_id", "pos", F.col("event_type") == "signup", F.col("event_type") == "purchase").select("user_id", "event_id")


# --- similarity ------------------------------------------------------------------------------------------------


# --- extraction and build --------------------------------------------------------------------------------------


@query("SELECT event_id, (SELECT max(e.event_id) FROM events e WHERE e.user_id = events.user_id AND e.event_id <= events.event_id AND e.event_type = 'signup') AS time FROM events")
def nearest_times(spark, sf_dir):
    rows = S.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return extraction.nearest_time(rows, "user_id", "event_id", F.when(F.col("event_type") == "signup", F.col("event_id"))).select("event_id", "time")


@query("SELECT doc_id, CASE WHEN length(text) > 10 THEN substring(text, 6, least(length(text), 40) - 5) ELSE substring(text, 6) END AS part FROM documents WHERE text IS NOT NULL AND length(text) > 5")
def owned_parts(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents").filter("text is not null and length(text) > 5")
    return d.select("doc_id", build.owned(F.col("text"), F.lit(100), F.lit(105), F.lit(140)).alias("part"))


# --- retrieval and evaluation ----------------------------------------------------------------------------------


@query("SELECT doc_id, CAST(CASE WHEN contains(text, '2024') THEN 12 ELSE 0 END + CASE WHEN contains(text, 'a') THEN 2 ELSE 0 END + CASE WHEN contains(text, 'river') THEN 5 ELSE 0 END AS BIGINT) AS evidence FROM documents WHERE text IS NOT NULL")
def evidence_scores(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents").filter("text is not null")
    return retrieval.evidence_rank(d, "text", ["2024"], ["a", "river"]).select("doc_id", F.col("evidence").cast("long").alias("evidence"))


@query("SELECT vec_id, round(score, 6) AS score, content FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, case_id) rn FROM (SELECT vec_id, vec_id % 7 AS case_id, CAST(embedding[1] AS DOUBLE) AS score, 'abc' AS content FROM embeddings UNION ALL SELECT vec_id, 9, CAST(embedding[2] AS DOUBLE), 'abc' FROM embeddings)) WHERE rn = 1 ORDER BY score DESC, vec_id LIMIT 40")
def rerank_pool(spark, sf_dir):
    v = S.table(spark, sf_dir, "embeddings")
    one = lambda case, i: v.select("vec_id", case.alias("case_id"), F.get("embedding", F.lit(i)).cast("double").alias("score"), F.lit("abcdef").alias("content"))
    return retrieval.pool(one(F.col("vec_id") % 7, 0).unionByName(one(F.lit(9).cast("long"), 1)), 40, "vec_id", chars=3).select("vec_id", F.round("score", 6).alias("score"), "content")


@query("SELECT round(avg(CASE WHEN event_type = CASE WHEN event_id % 3 = 0 THEN 'click' ELSE event_type END THEN 1.0 ELSE 0 END), 6) AS accuracy FROM events")
def route_accuracy(spark, sf_dir):
    rows = S.table(spark, sf_dir, "events").withColumn("want", F.when(F.col("event_id") % 3 == 0, "click").otherwise(F.col("event_type")))
    return evaluation.accuracy(rows, "want", "event_type")

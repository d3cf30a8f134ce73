"""Rules about words, dates, cases and answers over the given tables, and over texts that Spark writes from their columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import build, evaluation, extraction, filters, retrieval, similarity
from ..sources import tables as S
from .facts import LINES, joined, reports
from .registry import query
from .texts import PARAS, paras

# --- dates and words -------------------------------------------------------------------------------------------


def orders(spark, sf_dir):
    """o_orderkey, k (its number modulo 4), y, m, d: an order's day, thirty years later."""
    day = F.col("o_orderdate")
    return S.table(spark, sf_dir, "orders").select("*", (F.col("o_orderkey") % 4).alias("k"), (F.year(day) + 30).alias("y"), F.month(day).alias("m"), F.dayofmonth(day).alias("d"))


ORDERS = "WITH o AS (SELECT *, o_orderkey % 4 AS k, year(o_orderdate) + 30 AS y, month(o_orderdate) AS m, day(o_orderdate) AS d FROM orders) "


@query(ORDERS + "SELECT o_orderkey, CASE WHEN k < 2 THEN y END AS year, CASE WHEN k < 2 THEN TRY_CAST(printf('%d-%02d-%02d', y, m, d) AS DATE) WHEN k = 2 THEN make_date(2020, m, d) END AS day FROM o")
def calendar_dates(spark, sf_dir):
    """ISO days, written days, days without a year, none; the 29th of February of a common year is no day."""
    text = F.when(F.col("k") == 0, F.concat(F.col("y"), F.lit("-"), F.col("m"), F.lit("-"), F.col("d"), F.lit(" 起")))
    text = text.when(F.col("k") == 1, F.concat(F.col("y"), F.lit("年"), F.col("m"), F.lit("月"), F.col("d"), F.lit("日"))).when(F.col("k") == 2, F.concat(F.col("m"), F.lit("月"), F.col("d"), F.lit("日夜间"))).otherwise("没有日期")
    return orders(spark, sf_dir).select("o_orderkey", X.year(text).cast("long").alias("year"), X.calendar_date(text, 2020).alias("day"))


SPOTTED = ["the", "then", "hen", "tion", "ation"]
_LONGEST = sorted(SPOTTED, key=lambda t: (-len(t), t))
_BLANKED = "coalesce(text, '')"
_STEPS = []
for _t in _LONGEST:
    _STEPS.append(f"CASE WHEN contains({_BLANKED}, '{_t}') THEN '{_t}' END")
    _BLANKED = f"replace({_BLANKED}, '{_t}', chr(1))"


@query(f"SELECT doc_id, array_to_string(list_filter({SPOTTED}, lambda t: contains(coalesce(text, ''), t)), ',') AS all_terms, array_to_string(list_filter([{', '.join(_STEPS)}], lambda t: t IS NOT NULL), ',') AS longest FROM documents")
def spotted_terms(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    return S.table(spark, sf_dir, "documents").select("doc_id", joined(X.spotted(text, SPOTTED)).alias("all_terms"), joined(X.spotted_longest(text, SPOTTED)).alias("longest"))


@query(ORDERS + "SELECT o_orderkey, y || '年' || m || '月' || d || '日太原大风 a b 号' || o_orderkey AS text FROM o")
def cleaned_text(spark, sf_dir):
    text = F.concat(F.col("y"), F.lit(" 年 "), F.col("m"), F.lit(" 月\n "), F.col("d"), F.lit(" 日 太 原  大风 a  b 号 "), F.col("o_orderkey"))
    return orders(spark, sf_dir).select("o_orderkey", X.clean(text).alias("text"))


@query(ORDERS + "SELECT o_orderkey, CAST(CASE WHEN k < 2 THEN 2 WHEN k = 2 THEN 1 ELSE 0 END AS BIGINT) AS n, CASE WHEN k < 2 THEN '大风' || m || '。|降温' || d || '；' WHEN k = 2 THEN '雨' || d ELSE '' END AS parts FROM o")
def sentence_split(spark, sf_dir):
    text = F.when(F.col("k") < 2, F.concat(F.lit("大风"), F.col("m"), F.lit("。降温"), F.col("d"), F.lit("；"))).when(F.col("k") == 2, F.concat(F.lit("雨"), F.col("d"))).otherwise(" ")
    parts = X.sentences(text)
    return orders(spark, sf_dir).select("o_orderkey", F.size(parts).cast("long").alias("n"), F.array_join(parts, "|").alias("parts"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'mm' WHEN 1 THEN 'm' WHEN 2 THEN 'km' WHEN 3 THEN '℃' ELSE 'hPa' END AS unit, CAST(p_size AS DOUBLE) * CASE p_partkey % 5 WHEN 0 THEN 0.001 WHEN 2 THEN 1000.0 ELSE 1.0 END AS metres FROM part")
def units_converted(spark, sf_dir):
    said = F.element_at(F.array(*map(F.lit, ["毫米", " 米 ", "公里", "摄氏度", "hPa"])), (F.col("p_partkey") % 5 + 1).cast("int"))
    return S.table(spark, sf_dir, "part").select("p_partkey", X.unit(said).alias("unit"), X.in_unit(F.col("p_size").cast("double"), X.unit(said), "m").alias("metres"))


TITLE_TERMS = ["widget", "small", "small widget", "bolt", "large"]


@query(f"SELECT p_partkey, (SELECT t FROM (SELECT unnest({TITLE_TERMS}) AS t) WHERE contains(p_name, t) ORDER BY position(t IN p_name), -length(t), t LIMIT 1) AS focus, CASE WHEN contains(p_name, 'widget') THEN 'widget' WHEN contains(p_name, 'cold') THEN 'cold' ELSE p_brand END AS main FROM part")
def title_terms(spark, sf_dir):
    labels = F.array(F.col("p_brand"), F.lit("widget"), F.lit("cold"))
    return S.table(spark, sf_dir, "part").select("p_partkey", X.title_focus(F.col("p_name"), TITLE_TERMS).alias("focus"), X.primary(labels, F.col("p_name"), []).alias("main"))


@query("SELECT 'qty_total' AS name, sum(l_quantity) FILTER (l_returnflag = 'A') AS of_a, sum(l_quantity) AS total FROM lineitem WHERE l_linenumber < 7 UNION ALL SELECT 'lines', NULL, CAST(count(*) AS DOUBLE) FROM lineitem WHERE l_linenumber < 7")
def exposition_totals(spark, sf_dir):
    """Metric lines that Spark writes from line items, comments and blank lines among them."""
    said = F.concat(F.lit('qty_total{flag="'), F.col("l_returnflag"), F.lit('",code="200"} '), F.col("l_quantity"))
    comment = F.col("l_linenumber") >= 7
    lines = S.table(spark, sf_dir, "lineitem").select(F.explode(F.array(F.when(comment, "# HELP qty").otherwise(said), F.when(comment, "").otherwise("lines 1"))).alias("value"))
    return S.metric_totals(lines).join(S.metric_totals(lines, flag="A").withColumnRenamed("total", "of_a"), "name", "left").select("name", "of_a", "total")


# --- filters, matchers -----------------------------------------------------------------------------------------


@query("SELECT doc_id, contains(t, 'tionthe') OR contains(lang, 'tionthe') OR ((contains(t, 'tion') OR contains(lang, 'tion')) AND (contains(t, 'the') OR contains(lang, 'the'))) AS compound, source IN ('src1', 's') OR contains(source, 'src1') OR contains('src1', source) OR contains(t, 'src1') AS near, true AS whole FROM (SELECT *, coalesce(text, '') AS t FROM documents)")
def term_and_region(spark, sf_dir):
    text, region = F.coalesce("text", F.lit("")), F.array("source")
    compound = filters.term_matches(text, F.array("lang"), "tionthe", {"tionthe": ["tion", "the"]})
    of = lambda t: filters.region_matches(region, [t], ("all", "everywhere"), text)
    return S.table(spark, sf_dir, "documents").select("doc_id", compound.alias("compound"), of("src1").alias("near"), of("all").alias("whole"))


@query("""WITH w AS (SELECT user_id, event_type || ' warning ' || event_id % 7 AS text, event_id % 1000 AS issued, event_id FROM events WHERE event_type IN ('error', 'view') AND event_id % 1000 < 500),
u AS (SELECT *, row_number() OVER (PARTITION BY user_id, text ORDER BY issued DESC) AS n FROM w), t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY issued DESC, text) AS r FROM u WHERE n = 1 AND contains(text, 'error')) SELECT user_id, text, issued FROM t WHERE r <= 5""")
def prior_warning_rows(spark, sf_dir):
    text = F.concat(F.col("event_type"), F.lit(" warning "), F.col("event_id") % 7)
    rows = S.table(spark, sf_dir, "events").filter("event_type in ('error', 'view')").select("user_id", text.alias("text"), (F.col("event_id") % 1000).alias("issued"), F.lit(500).cast("long").alias("start"))
    return filters.prior_warnings(rows, "error", "user_id", "text", "issued", "start").select("user_id", "text", "issued")


LINEAR = "CASE WHEN m = 7 AND k = 0 THEN 0.82 WHEN m = 7 AND d = 16 THEN 1.0 WHEN m = 7 THEN 0.72 WHEN m IN (6, 8) THEN 0.35 ELSE 0.0 END"
SHARE = "((CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) + (CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END)) / 2.0"


def _profiles(spark, sf_dir):
    months, days = F.array("m"), F.when(F.col("k") == 0, F.array().cast("array<int>")).otherwise(F.array("d"))
    labels = similarity.match_share(F.array("o_orderstatus", "o_orderpriority"), ["F", "1-URGENT"])
    return orders(spark, sf_dir), {"disaster": labels, "temporal": similarity.temporal_linear(months, days, 7, [16])}


@query(ORDERS + f"SELECT o_orderkey, CAST({SHARE} AS DOUBLE) AS labels, CAST({LINEAR} AS DOUBLE) AS temporal FROM o")
def matcher_dimensions(spark, sf_dir):
    rows, scores = _profiles(spark, sf_dir)
    return rows.select("o_orderkey", scores["disaster"].alias("labels"), scores["temporal"].cast("double").alias("temporal"))


@query(ORDERS + f"SELECT o_orderkey, CAST(round(0.28 * {SHARE} + 0.18 * {LINEAR}, 4) AS DOUBLE) AS score FROM o WHERE 0.28 * {SHARE} + 0.18 * {LINEAR} > 0 ORDER BY score DESC, o_orderkey LIMIT 5")
def matched_cases(spark, sf_dir):
    rows, scores = _profiles(spark, sf_dir)
    return similarity.matched(rows.withColumn("pos", F.col("o_orderkey")), scores).select("o_orderkey", "score")


@query("""WITH p AS (SELECT p_partkey, contains(p_name, 'bolt') AS t, contains(p_name, 'nut') AS k, p_partkey % 3 = 0 AS l, contains(p_name, 'widget') AS o FROM part)
SELECT p_partkey, CAST(CASE WHEN t THEN 1.0 WHEN k THEN 0.85 WHEN l AND o THEN 0.35 WHEN l THEN 0.48 ELSE 0.0 END AS DOUBLE) AS score FROM p""")
def disaster_scores(spark, sf_dir):
    labels = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("bolt"))).otherwise(F.array(F.lit("gear")))
    score = similarity.disaster_score(F.col("p_name"), labels, {"bolt": 1.0}, {"bolt": ["nut"], "widget": ["gadget"]})
    return S.table(spark, sf_dir, "part").select("p_partkey", F.round(score, 6).alias("score"))


# --- facts -----------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, CASE (l_partkey + l_suppkey) % 4 WHEN 1 THEN 'value not in text' WHEN 2 THEN 'unit does not fit' WHEN 3 THEN 'unknown chunk' ELSE '' END AS reason, count(*) AS n FROM lineitem GROUP BY 1, 2")
def checked_facts(spark, sf_dir):
    """Proposed facts against the reports of their orders: right ones, changed values, a unit of another metric, orders that do not exist."""
    how = (F.col("l_partkey") + F.col("l_suppkey")) % 4
    rows = S.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order"), F.when(how == 3, -F.col("l_orderkey") - 1).otherwise(F.col("l_orderkey")).alias("l_orderkey"), F.when(how == 2, "wind").otherwise("precipitation").alias("metric"), F.when(how == 1, F.col("l_quantity") + 0.25).otherwise(F.col("l_quantity")).alias("value"), F.lit("毫米").alias("unit"))
    found = extraction.checked(rows, reports(spark, sf_dir), "l_orderkey", "text")
    return found.groupBy(F.col("order").alias("l_orderkey"), F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"))


@query(LINES + "SELECT l_orderkey, CAST(w AS BIGINT) AS month, CAST(q AS DOUBLE) AS value FROM l, range(1, 13) r(w) WHERE contains(m || '月', w || '月')")
def values_of_months(spark, sf_dir):
    found = extraction.month_values(reports(spark, sf_dir), "l_orderkey", "text", list(range(1, 13)), ["降水量"])
    return found.select("l_orderkey", F.col("month").cast("long").alias("month"), "value")


FORCES = "CASE " + " ".join(f"WHEN v >= {least} THEN {force}" for force, least in reversed(list(enumerate(X.WIND_FORCE)))) + " END"


@query(f"""WITH f AS (SELECT s_nationkey AS case_id, 'wind' AS metric, CAST(s_suppkey % 40 AS DOUBLE) AS value, s_suppkey % 10 / CAST(10 AS DOUBLE) AS confidence FROM supplier UNION ALL SELECT s_nationkey, 'wind_force', 3.0, 0.9 FROM supplier WHERE s_nationkey % 5 = 0 AND s_suppkey % 3 = 0),
b AS (SELECT case_id, max(value) AS v, arg_max(confidence, (value, confidence)) AS c FROM f WHERE metric = 'wind' AND case_id NOT IN (SELECT case_id FROM f WHERE metric = 'wind_force') GROUP BY 1)
SELECT * FROM f UNION ALL SELECT case_id, 'wind_force', CAST({FORCES} AS DOUBLE), least(c, 0.78) FROM b""")
def derived_force(spark, sf_dir):
    s = S.table(spark, sf_dir, "supplier")
    speeds = s.select(F.col("s_nationkey").alias("case_id"), F.lit("wind").alias("metric"), (F.col("s_suppkey") % 40).cast("double").alias("value"), (F.col("s_suppkey") % 10 / 10).alias("confidence"))
    forces = s.filter("s_nationkey % 5 = 0 and s_suppkey % 3 = 0").select("s_nationkey", F.lit("wind_force"), F.lit(3.0), F.lit(0.9))
    return extraction.derived_wind(speeds.unionAll(forces), "case_id")


# --- build -----------------------------------------------------------------------------------------------------


@query(PARAS + ", t AS (SELECT doc_id, max(\"start\" + length(content)) AS total FROM spans GROUP BY 1), h AS (SELECT doc_id, content AS title, \"start\" FROM spans WHERE regexp_matches(content, '^(The|De|Un|Le)')) SELECT doc_id, md5(title) AS title, row_number() OVER w AS case_no, \"start\", coalesce(lead(\"start\") OVER w, total) AS end_at FROM h JOIN t USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY \"start\")")
def case_spans(spark, sf_dir):
    found, _ = build.case_segments(paras(spark, sf_dir), "doc_id", "chunk_no", "content", "^(The|De|Un|Le)")
    return found.select("doc_id", F.md5("title").alias("title"), F.col("case_no").cast("long").alias("case_no"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end_at"))


@query("SELECT doc_id, md5(substr(t, 1, CAST(least(CASE WHEN contains(t, 'tion') THEN position('tion' IN t) ELSE length(t) + 1 END, CASE WHEN contains(t, 'ment') THEN position('ment' IN t) ELSE length(t) + 1 END) AS BIGINT) - 1)) AS seen FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def observed_text(spark, sf_dir):
    return S.table(spark, sf_dir, "documents").select("doc_id", F.md5(build.observed(F.coalesce("text", F.lit("")), ["tion", "ment"])).alias("seen"))


@query(ORDERS + "SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN '1-URGENT,' ELSE '' END || CASE o_orderstatus WHEN 'F' THEN 'F,settled' WHEN 'P' THEN 'settled,P' ELSE 'O' END AS labels, CASE k WHEN 1 THEN 'a' WHEN 3 THEN 'c' ELSE 'whole' END AS areas FROM o")
def closed_labels(spark, sf_dir):
    labels = build.label_closure(F.array("o_orderstatus", "o_orderpriority"), [(["F", "P"], "settled")], ["1-URGENT", "F", "O", "settled", "P"])
    areas = F.when(F.col("k") == 1, F.array(F.lit("a"))).when(F.col("k") == 3, F.array(F.lit("c"))).when(F.col("k") == 0, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("c"), F.lit("b")))
    return orders(spark, sf_dir).select("o_orderkey", joined(labels).alias("labels"), joined(build.collapse_areas(areas, ["a", "b"], "whole")).alias("areas"))


@query("""WITH c AS (SELECT o_orderkey, o_orderpriority AS s FROM orders WHERE o_orderkey % 7 <> 0), r AS (SELECT o_custkey, o_orderpriority AS s, unnest([o_orderkey, o_orderkey + 2]) AS id FROM orders)
SELECT 'unique case_id' AS check_name, count(*) AS failures FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'chunk exists', count(*) FROM r WHERE id NOT IN (SELECT o_orderkey FROM c) UNION ALL SELECT 'same source', count(*) FROM r JOIN c ON id = o_orderkey WHERE r.s <> c.s""")
def build_checks(spark, sf_dir):
    o = S.table(spark, sf_dir, "orders")
    cases = o.select(F.col("o_custkey").alias("case_id"), F.col("o_orderpriority").alias("source_pdf"), F.array(F.col("o_orderkey"), F.col("o_orderkey") + 2).alias("source_chunk_ids"))
    chunks = o.filter("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_orderpriority").alias("source_pdf"))
    return build.validate(cases, chunks).select(F.col("check").alias("check_name"), "failures")


# --- retrieval, evaluation -------------------------------------------------------------------------------------


@query(PARAS + """, s AS (SELECT doc_id, chunk_no, CAST(CASE WHEN contains(content, 'the') THEN 1 ELSE 0 END + CASE WHEN contains(content, 'tion') THEN 1 ELSE 0 END + CASE WHEN chunk_no % 3 = 0 THEN 5 ELSE 0 END + CASE WHEN regexp_matches(content, '[0-9]+(?:\\.[0-9]+)?\\s*(?:mm|cm|km|m/s|m|℃|毫米|米|级)') THEN 2 ELSE 0 END AS BIGINT) AS relevance FROM paras),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY relevance DESC, chunk_no) AS n FROM s) SELECT doc_id, chunk_no, relevance FROM r WHERE n <= 6""")
def relevant_parts(spark, sf_dir):
    found = retrieval.relevant_chunks(paras(spark, sf_dir), "doc_id", "chunk_no", "content", ["the", "tion"], F.col("chunk_no") % 3 == 0)
    return found.select("doc_id", "chunk_no", F.col("relevance").cast("long").alias("relevance"))


@query(LINES.replace("day(l_shipdate) AS d", "day(l_shipdate) AS d, l_linenumber AS n, l_shipdate AS t") + ", s AS (SELECT *, m || '月' || d || '日累计降水量最高达' || q || '毫米（' || CASE f WHEN 'A' THEN '原平' WHEN 'N' THEN '河曲' ELSE '五台' END || '）。' AS s FROM l) SELECT l_orderkey, arg_min(s, (n, t, s)) AS sentence FROM s GROUP BY 1")
def evidence_sentences(spark, sf_dir):
    return reports(spark, sf_dir).select("l_orderkey", retrieval.evidence_sentence(X.sentences(F.col("text")), ["雨", "降水"]).alias("sentence"))


@query("SELECT doc_id, (CASE WHEN contains(t, 'the') OR contains(t, 'que') THEN 1 ELSE 0 END + CASE WHEN contains(t, 'tion') THEN 1 ELSE 0 END + 1) / CAST(3 AS DOUBLE) AS coverage, CAST(CASE WHEN contains(t, '###') THEN 1 ELSE 0 END + CASE WHEN contains(t, '@') THEN 1 ELSE 0 END AS BIGINT) AS forbidden FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def answer_facts(spark, sf_dir):
    text, facts, claims = F.coalesce("text", F.lit("")), F.array(F.lit("the|que"), F.lit("tion"), F.lit("")), F.array(F.lit("###"), F.lit(""), F.lit("@"))
    return S.table(spark, sf_dir, "documents").select("doc_id", evaluation.fact_coverage(facts, text).alias("coverage"), evaluation.forbidden_claims(claims, text).cast("long").alias("forbidden"))

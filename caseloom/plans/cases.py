"""Case queries: an order with its lines is a case with an interval, labels (part types) and an area (nation)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import ring_distance, ring_score, weighted_mean
from ..operators import aggregates as A
from ..operators import filters, joins, ranking, similarity
from ..operators.order import placed
from ..sources import tables as S
from .registry import query

LO, HI = "1996-03-01", "1996-06-30"


def case_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, custkey, start_date, end_date, labels, area, region, total, month."""
    t = lambda n: S.table(spark, sf_dir, n)
    lines = t("lineitem").join(t("part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    span = lines.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("s"), F.max("l_shipdate").alias("e"), F.sort_array(F.collect_set("p_type")).alias("labels"))
    place = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", F.col("n_name").alias("area"), F.col("r_name").alias("region"))
    rows = t("orders").join(span, F.col("o_orderkey") == F.col("l_orderkey")).join(place, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(
        F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("custkey"),
        F.least("o_orderdate", "s").cast("date").alias("start_date"), F.greatest("o_orderdate", "e").cast("date").alias("end_date"),
        "labels", "area", "region", F.col("o_totalprice").alias("total"), F.month("o_orderdate").cast("long").alias("month"),
    )


CASES = """WITH li AS (SELECT l_orderkey, min(l_shipdate) s, max(l_shipdate) e, list(DISTINCT p_type ORDER BY p_type) labels
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
cases AS (SELECT o_orderkey case_id, o_custkey custkey, CAST(least(o_orderdate, s) AS DATE) start_date, CAST(greatest(o_orderdate, e) AS DATE) end_date,
labels, n_name area, r_name region, o_totalprice total, CAST(month(o_orderdate) AS BIGINT) AS month FROM orders JOIN li ON o_orderkey = l_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""
INSIDE = f"start_date <= DATE '{HI}' AND end_date >= DATE '{LO}'"


def in_interval(cases: DataFrame) -> DataFrame:
    return cases.filter(filters.overlaps(F.col("start_date"), F.col("end_date"), LO, HI))


@query(CASES + f"SELECT case_id, CAST(start_date AS VARCHAR) AS start_date, CAST(end_date AS VARCHAR) AS end_date, CAST(1.0 AS DOUBLE) AS score FROM cases WHERE {INSIDE} AND region = 'ASIA' AND len(labels) > 0")
def case_filter_interval(spark, sf_dir):
    dims = {"date": filters.overlaps(F.col("start_date"), F.col("end_date"), LO, HI), "region": F.col("region") == "ASIA", "label": F.size("labels") > 0, "area": None}
    return filters.search(case_rows(spark, sf_dir), dims).select("case_id", F.col("start_date").cast("string").alias("start_date"), F.col("end_date").cast("string").alias("end_date"), F.col("score").cast("double").alias("score"))


@query(CASES + f"SELECT label, count(*) AS n FROM (SELECT unnest(labels) AS label FROM cases WHERE {INSIDE}) GROUP BY 1")
def case_label_counts(spark, sf_dir):
    return A.label_counts(in_interval(case_rows(spark, sf_dir)), "labels")


@query(CASES + f"SELECT month, label, count(*) AS n FROM (SELECT month, unnest(labels) AS label FROM cases WHERE {INSIDE} AND region = 'EUROPE') GROUP BY 1, 2")
def case_month_counts(spark, sf_dir):
    rows = in_interval(case_rows(spark, sf_dir)).filter("region = 'EUROPE'")
    return rows.select("month", F.explode("labels").alias("label")).groupBy("month", "label").agg(F.count("*").alias("n"))


PAIRS = CASES + """, x AS (SELECT DISTINCT case_id, unnest(labels) AS label FROM cases), cnt AS (SELECT label, count(*) n FROM x GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8),
prs AS (SELECT a.label AS a, b.label AS b, count(*) AS n FROM x a JOIN x b USING (case_id) WHERE a.label <> b.label GROUP BY 1, 2),
m AS (SELECT c.label AS a, d.label AS b, CAST(CASE WHEN c.label = d.label THEN c.n ELSE coalesce(prs.n, 0) END AS DOUBLE) AS value FROM cnt c CROSS JOIN cnt d LEFT JOIN prs ON prs.a = c.label AND prs.b = d.label WHERE (SELECT count(*) FROM cnt) > 1)
"""


def _matrix(spark, sf_dir):
    cases = case_rows(spark, sf_dir).select("case_id", F.explode("labels").alias("label"))
    return A.cooccurrence(joins.pairs_within(cases, "case_id", "label"), cases.groupBy("label").agg(F.count("*").alias("n")), 8)


@query(PAIRS + "SELECT a, b, value FROM m")
def label_cooccurrence(spark, sf_dir):
    return _matrix(spark, sf_dir)


@query(PAIRS + "SELECT a, b, value FROM m WHERE a < b ORDER BY value DESC, a, b LIMIT 1")
def strongest_pair(spark, sf_dir):
    return A.strongest_pair(_matrix(spark, sf_dir))


def line_facts(spark, sf_dir):
    """Facts: metric by return flag, unit by line status, value the price; a total order over equal line numbers."""
    return S.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_returnflag").alias("metric"), F.col("l_linestatus").alias("unit"), F.col("l_extendedprice").alias("value"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_quantity").alias("quantity"))


FACTS = "WITH f AS (SELECT l_orderkey case_id, l_returnflag metric, l_linestatus unit, l_extendedprice AS value, l_partkey part, l_suppkey supp, l_quantity quantity FROM lineitem) "


@query(FACTS + "SELECT case_id, metric, value, part, supp FROM (SELECT *, row_number() OVER (PARTITION BY case_id, metric ORDER BY CASE WHEN metric = 'R' THEN value ELSE -value END, part, supp) rn FROM f) WHERE rn = 1")
def metric_extreme_provenance(spark, sf_dir):
    rows = line_facts(spark, sf_dir).select("case_id", "metric", "value", "part", "supp")
    return A.extreme(rows, ["case_id", "metric"], "value", ["part", "supp"], lowest=F.col("metric") == "R")


@query(FACTS + "SELECT case_id, value, part, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY value DESC, part, supp, quantity) AS rank FROM f WHERE quantity >= 30) WHERE rank <= 2")
def topk_per_case(spark, sf_dir):
    rows = line_facts(spark, sf_dir).filter("quantity >= 30")
    return ranking.number(rows, ["case_id"], [F.desc("value"), F.asc("part"), F.asc("supp"), F.asc("quantity")], "rank").filter("rank <= 2").select("case_id", "value", "part", "rank")


@query(FACTS + "SELECT case_id, value, CAST(rn AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (ORDER BY value DESC, case_id) rn FROM (SELECT case_id, max(value) AS value FROM f WHERE metric = 'A' GROUP BY 1)) WHERE rn <= 8")
def top_case_rows(spark, sf_dir):
    best = line_facts(spark, sf_dir).filter("metric = 'A'").groupBy("case_id").agg(F.max("value").alias("value"))
    return A.ranked(best.orderBy(F.desc("value"), "case_id").limit(8), [F.desc("value"), F.asc("case_id")])


@query(FACTS + "SELECT metric, unit, value, case_id FROM (SELECT *, row_number() OVER (PARTITION BY metric, unit ORDER BY value DESC, case_id, part) rn FROM f) WHERE rn = 1")
def metric_unit_extremes(spark, sf_dir):
    rows = line_facts(spark, sf_dir).select("metric", "unit", "value", "case_id", "part")
    return A.extreme(rows, ["metric", "unit"], "value", ["case_id", "part"]).select("metric", "unit", "value", "case_id")


@query(FACTS + """, c AS (SELECT metric, count(DISTINCT case_id) AS coverage FROM f GROUP BY 1), n AS (SELECT count(DISTINCT case_id) AS n FROM f),
t AS (SELECT *, CASE WHEN coverage >= n THEN 0 WHEN coverage >= ceil(0.7 * n) THEN 1 ELSE 2 END AS tier FROM c, n)
SELECT metric, coverage, CAST(row_number() OVER (ORDER BY coverage DESC, CASE metric WHEN 'N' THEN 1 WHEN 'R' THEN 2 ELSE 3 END) AS BIGINT) AS rank FROM t WHERE tier = (SELECT min(tier) FROM t) QUALIFY row_number() OVER (ORDER BY coverage DESC, CASE metric WHEN 'N' THEN 1 WHEN 'R' THEN 2 ELSE 3 END) <= 3""")
def column_coverage_pick(spark, sf_dir):
    rows = line_facts(spark, sf_dir)
    n = rows.agg(F.count_distinct("case_id")).first()[0]
    return A.column_coverage(rows, "metric", "case_id", n, ["N", "R"])


SECTIONS = [("metals", ["STEEL", "BRASS"]), ("economy", ["ECONOMY"]), ("promo", ["PROMO"])]


@query(CASES + "SELECT section, count(*) AS n, min(case_id) AS first_case FROM (SELECT case_id, CASE WHEN contains(labels[1], 'STEEL') OR contains(labels[1], 'BRASS') THEN 'metals' WHEN contains(labels[1], 'ECONOMY') THEN 'economy' WHEN contains(labels[1], 'PROMO') THEN 'promo' ELSE 'other' END AS section FROM cases) GROUP BY 1")
def section_groups(spark, sf_dir):
    from ..functions.scalars import classified

    rows = case_rows(spark, sf_dir).select("case_id", classified(F.get("labels", F.lit(0)), SECTIONS, "other").alias("section"))
    return rows.groupBy("section").agg(F.count("*").alias("n"), F.min("case_id").alias("first_case"))


@query("WITH c AS (SELECT CAST(month(o_orderdate) AS BIGINT) AS month, count(*) AS n FROM orders GROUP BY 1) SELECT month, n, round(100.0 * n / (SELECT sum(n) FROM c), 4) AS share FROM c WHERE n = (SELECT max(n) FROM c)")
def peak_month_ties(spark, sf_dir):
    return A.peaks(S.table(spark, sf_dir, "orders").groupBy(F.month("o_orderdate").cast("long").alias("month")).agg(F.count("*").alias("n")), "month")


@query(CASES + "SELECT area, n, CAST(dense_rank() OVER (ORDER BY n DESC) AS BIGINT) AS rank FROM (SELECT area, count(*) AS n FROM cases GROUP BY 1) QUALIFY rank <= 3")
def spatial_rank(spark, sf_dir):
    from pyspark.sql.window import Window as W

    n = case_rows(spark, sf_dir).groupBy("area").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.dense_rank().over(W.partitionBy(F.lit(0)).orderBy(F.desc("n"))).cast("long")).filter("rank <= 3")


@query(CASES + ", fl AS (SELECT list(label ORDER BY label) AS focus FROM (SELECT label FROM (SELECT unnest(labels) AS label FROM cases) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) SELECT label, count(*) AS n FROM (SELECT unnest(list_filter(labels, lambda x: NOT list_contains(focus, x))) AS label FROM cases, fl WHERE list_has_all(labels, focus)) GROUP BY 1 ORDER BY n DESC, label LIMIT 3")
def all_match_companions(spark, sf_dir):
    cases = case_rows(spark, sf_dir)
    focus = [r.label for r in A.most_common(A.label_counts(cases, "labels"), 1).collect()]
    return A.companions(cases, "labels", focus)


PROFILE = CASES + """, c AS (SELECT month, label, count(*) AS n FROM (SELECT month, unnest(labels) AS label FROM cases) GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY n DESC, label) rn FROM c) """


@query(PROFILE + "SELECT month, string_agg(label, ',' ORDER BY rn) AS top FROM t WHERE rn <= 3 GROUP BY 1")
def month_profile_compare(spark, sf_dir):
    rows = case_rows(spark, sf_dir).select("month", F.explode("labels").alias("label"))
    return A.group_profile(rows, "month", "label", 3).select("month", F.array_join("top", ",").alias("top"))


@query(PROFILE + "SELECT label FROM t WHERE rn <= 3 GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT month) FROM t)")
def month_profile_common(spark, sf_dir):
    rows = case_rows(spark, sf_dir).select("month", F.explode("labels").alias("label"))
    return A.common_to_all(A.group_profile(rows, "month", "label", 3))


@query(CASES + "SELECT label, count(*) AS n, count(DISTINCT area) AS areas, round(avg(total), 4) AS mean_total FROM (SELECT unnest(labels) AS label, area, total FROM cases) WHERE label IN (SELECT DISTINCT p_type FROM part ORDER BY 1 LIMIT 4) GROUP BY 1")
def group_comparison(spark, sf_dir):
    wanted = S.table(spark, sf_dir, "part").select(F.col("p_type").alias("label")).distinct().orderBy("label").limit(4)
    rows = case_rows(spark, sf_dir).select(F.explode("labels").alias("label"), "area", "total").join(F.broadcast(wanted), "label")
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("area").alias("areas"), F.round(F.avg("total"), 4).alias("mean_total"))


@query(CASES + """SELECT * FROM (SELECT 'region' AS kind, region AS label, count(*) AS n FROM cases GROUP BY 2) UNION ALL SELECT * FROM (SELECT 'month' AS kind, CAST(month AS VARCHAR) AS label, count(*) AS n FROM cases GROUP BY 2)
UNION ALL SELECT * FROM (SELECT 'area' AS kind, area AS label, count(*) AS n FROM cases GROUP BY 2 ORDER BY n DESC, label LIMIT 10)""")
def statistics_family(spark, sf_dir):
    cases = case_rows(spark, sf_dir).select("region", F.col("month").cast("string").alias("month"), "area")
    count = lambda c: cases.groupBy(F.col(c).alias("label")).agg(F.count("*").alias("n"))
    parts = {"region": count("region"), "month": count("month"), "area": A.most_common(count("area"), 10)}
    out = [df.select(F.lit(k).alias("kind"), "label", "n") for k, df in parts.items()]
    return out[0].unionAll(out[1]).unionAll(out[2])


@query("SELECT c_nationkey, c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) rn FROM customer) WHERE rn = 1")
def distinct_keep_first(spark, sf_dir):
    rows = S.table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", "c_custkey")
    return A.keep_first(rows, [F.col("c_nationkey"), F.col("c_mktsegment")], [F.asc("c_custkey")])


@query(FACTS + "SELECT metric, part, pos, supp FROM (SELECT metric, part, supp, min(case_id) OVER (PARTITION BY metric, part) AS pos, row_number() OVER (PARTITION BY metric, part ORDER BY CASE unit WHEN 'F' THEN 1 ELSE 0 END DESC, case_id, supp, value) AS rn FROM f) WHERE rn = 1")
def fact_merge(spark, sf_dir):
    from pyspark.sql.window import Window as W

    w = W.partitionBy("metric", "part")
    rows = line_facts(spark, sf_dir).withColumn("pos", F.min("case_id").over(w)).withColumn("rn", F.row_number().over(w.orderBy((F.col("unit") == "F").desc(), "case_id", "supp", "value")))
    return rows.filter("rn = 1").select("metric", "part", "pos", "supp")


@query("SELECT coalesce(k, f) AS name, CASE WHEN f IS NOT NULL THEN 'confirmed' ELSE 'not present' END AS status FROM (SELECT DISTINCT n_name k FROM nation) FULL JOIN (SELECT DISTINCT n_name f FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 5000) ON k = f")
def status_map(spark, sf_dir):
    nation = S.table(spark, sf_dir, "nation")
    found = S.table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return A.status(nation.select(F.col("n_name").alias("name")), found.select(F.col("n_name").alias("name")), "name")


@query(CASES + "SELECT CAST(min(start_date) AS VARCHAR) AS first_date, CAST(max(end_date) AS VARCHAR) AS last_date, count(*) AS n, CASE WHEN DATE '1990-01-01' > max(end_date) THEN 'after' WHEN DATE '1991-01-01' < min(start_date) THEN 'before' ELSE 'inside' END AS relation FROM cases")
def knowledge_range(spark, sf_dir):
    lo, hi = F.to_date(F.lit("1990-01-01")), F.to_date(F.lit("1991-01-01"))
    r = case_rows(spark, sf_dir).agg(F.min("start_date").alias("first_date"), F.max("end_date").alias("last_date"), F.count("*").alias("n"))
    r = r.withColumn("relation", F.when(lo > F.col("last_date"), "after").when(hi < F.col("first_date"), "before").otherwise("inside"))
    return r.select(F.col("first_date").cast("string").alias("first_date"), F.col("last_date").cast("string").alias("last_date"), "n", "relation")


NAMES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


@query(" UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in NAMES))
def row_counts(spark, sf_dir):
    return S.counts({n: S.table(spark, sf_dir, n) for n in NAMES})


@query("SELECT l_returnflag, l_linestatus, CAST(sum(CASE WHEN l_quantity <= 10 THEN 1 ELSE 0 END) AS BIGINT) AS le_10, CAST(sum(CASE WHEN l_quantity <= 25 THEN 1 ELSE 0 END) AS BIGINT) AS le_25, CAST(sum(CASE WHEN l_quantity <= 50 THEN 1 ELSE 0 END) AS BIGINT) AS le_50, round(sum(l_quantity), 4) AS total, count(*) AS n FROM lineitem GROUP BY ALL")
def histogram_buckets(spark, sf_dir):
    return A.histogram(S.table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", [10, 25, 50])


@query("SELECT c_mktsegment, round(median(c_acctbal), 6) AS median, CASE WHEN count(*) >= 4 THEN 'box' ELSE 'histogram' END AS kind FROM customer GROUP BY 1")
def median_plot_kind(spark, sf_dir):
    return A.plot_kind(S.table(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal")


@query(CASES + "SELECT round(avg(CAST(len(labels) > 2 AS INT)), 6) AS labels, round(avg(CAST(len(list_filter(labels, lambda x: contains(x, 'STEEL'))) > 0 AS INT)), 6) AS steel FROM cases")
def evidence_coverage(spark, sf_dir):
    rows = case_rows(spark, sf_dir).select(F.when(F.size("labels") > 2, F.col("labels")).otherwise(F.array()).alias("labels"), F.filter("labels", lambda x: F.contains(x, F.lit("STEEL"))).alias("steel"))
    return A.coverage(rows, ["labels", "steel"])


@query("WITH e AS (SELECT o_orderkey k FROM orders), a AS (SELECT DISTINCT l_orderkey k FROM lineitem) SELECT coalesce(e.k, a.k) AS id, CASE WHEN a.k IS NULL THEN 'missing' WHEN e.k IS NULL THEN 'extra' ELSE 'common' END AS state FROM e FULL JOIN a ON e.k = a.k")
def reconcile_ids(spark, sf_dir):
    return joins.compare_ids(S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), S.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id")), "id")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def orphan_refs(spark, sf_dir):
    lines = S.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.orphans(S.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), lines, "o_orderkey")


@query("SELECT p_partkey, p_name, CAST(pos AS BIGINT) AS pos FROM part JOIN (VALUES (17, 0), (5, 1), (101, 2), (3, 4)) v(k, pos) ON p_partkey = k")
def multi_get_ordered(spark, sf_dir):
    return S.multi_get(S.table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", [17, 5, 101, 5, 10**9, 3])


@query("WITH x AS (SELECT l_orderkey k, max(l_extendedprice) x FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), y AS (SELECT l_orderkey k, min(l_extendedprice) y FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT k AS case_id, x, y FROM x JOIN y USING (k) ORDER BY k LIMIT 8")
def paired_points(spark, sf_dir):
    f = line_facts(spark, sf_dir)
    return joins.paired(f.filter("metric = 'A'").groupBy("case_id").agg(F.max("value").alias("x")), f.filter("metric = 'R'").groupBy("case_id").agg(F.min("value").alias("y")), "case_id", 8)


@query("WITH l AS (SELECT DISTINCT l_orderkey k, l_partkey p, l_suppkey s FROM lineitem) SELECT DISTINCT a.k AS case_id FROM l a JOIN l b ON a.p = b.p AND a.s = b.s AND a.k <> b.k")
def sharing_cases(spark, sf_dir):
    rows = S.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("case_id"), "l_suppkey").agg(F.collect_set("l_partkey").alias("parts"))
    return joins.sharing(rows, "parts", "l_suppkey")


@query(CASES + "SELECT a.case_id AS case_a, b.case_id AS case_b FROM cases a JOIN cases b ON a.custkey = b.custkey AND a.case_id < b.case_id AND a.start_date < b.end_date AND a.end_date > b.start_date WHERE a.region = 'ASIA'")
def interval_join(spark, sf_dir):
    rows = case_rows(spark, sf_dir).filter("region = 'ASIA'")
    day = lambda c: F.datediff(F.col(c), F.to_date(F.lit("1970-01-01")))
    left = rows.select("custkey", F.col("case_id").alias("case_a"), day("start_date").alias("start"), day("end_date").alias("end"))
    right = rows.select("custkey", F.col("case_id").alias("case_b"), day("start_date").alias("start_r"), day("end_date").alias("end_r"))
    return joins.span_overlap(left, right, "custkey", 4096).filter("case_a < case_b").select("case_a", "case_b")


@query("SELECT o_orderkey, pos FROM (SELECT o_orderkey, pos, rn FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY pos) rn FROM (SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS pos FROM orders)) ORDER BY rn > 1, pos LIMIT 12)")
def stratified_pick(spark, sf_dir):
    rows = S.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    best = placed(rows, [F.desc("o_totalprice"), F.asc("o_orderkey")], name="pos").withColumn("pos", F.col("pos") + 1)
    return ranking.stratified(best, "o_orderpriority", "pos", 12).select("o_orderkey", "pos")


@query("SELECT l_orderkey AS case_id, round(avg(l_extendedprice), 6) AS score, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey) rn FROM lineitem) WHERE rn <= 2 GROUP BY 1")
def top2_mean(spark, sf_dir):
    rows = S.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), "l_extendedprice", "l_partkey")
    return ranking.top_mean(rows, "case_id", "l_extendedprice", "l_partkey")


@query("SELECT p_partkey, p_brand || '-case-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS case_id FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part)")
def sequence_ids(spark, sf_dir):
    rows = ranking.number(S.table(spark, sf_dir, "part"), ["p_brand"], [F.asc("p_partkey")], "n")
    return rows.select("p_partkey", ranking.sequence_id("p_brand", "case", "n").alias("case_id"))


@query("SELECT s_suppkey, round(CASE WHEN count(*) OVER () > 1 THEN 1 - (row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) - 1.0) / (count(*) OVER () - 1) ELSE 1 END, 6) AS rank_score, round((s_acctbal - min(s_acctbal) OVER ()) / (max(s_acctbal) OVER () - min(s_acctbal) OVER ()), 6) AS stretched FROM supplier")
def rank_scores(spark, sf_dir):
    rows = ranking.rank_score(S.table(spark, sf_dir, "supplier"), [F.desc("s_acctbal"), F.asc("s_suppkey")])
    return ranking.min_max(rows, "s_acctbal", "stretched").select("s_suppkey", F.round("rank_score", 6).alias("rank_score"), F.round("stretched", 6).alias("stretched"))


RING = "least(abs(month - 2), 12 - abs(month - 2))"
RING_SCORE = f"CASE {RING} WHEN 0 THEN 1.0 WHEN 1 THEN 0.72 WHEN 2 THEN 0.5 WHEN 3 THEN 0.3 ELSE 0.12 END"


@query(CASES + f"SELECT case_id, CAST({RING} AS BIGINT) AS distance, CAST({RING_SCORE} AS DOUBLE) AS score FROM cases")
def ring_month_distance(spark, sf_dir):
    d = ring_distance(F.col("month"), F.lit(2))
    return case_rows(spark, sf_dir).select("case_id", d.cast("long").alias("distance"), ring_score(d).alias("score"))


SCORES = CASES + f""", s AS (SELECT case_id, custkey, CASE WHEN area = 'NATION_3' OR area = 'JAPAN' THEN 1.0 WHEN region = 'ASIA' THEN 0.55 ELSE 0.0 END AS area_s,
CAST(len(list_filter(labels, lambda x: x IN ('ECONOMY', 'STANDARD'))) AS DOUBLE) / 2 AS disaster_s, {RING_SCORE} AS temporal_s, CASE WHEN total > 200000 THEN 1.0 END AS image_s FROM cases) """


def _dims(spark, sf_dir):
    rows = case_rows(spark, sf_dir)
    return rows.select(
        "case_id", "custkey", F.when(F.col("area").isin("NATION_3", "JAPAN"), 1.0).when(F.col("region") == "ASIA", 0.55).otherwise(0.0).alias("area_s"),
        similarity.match_share(F.col("labels"), ["ECONOMY", "STANDARD"]).alias("disaster_s"), ring_score(ring_distance(F.col("month"), F.lit(2))).alias("temporal_s"), F.when(F.col("total") > 200000, 1.0).alias("image_s"))


@query(SCORES + "SELECT case_id, round(0.28 * disaster_s + 0.18 * temporal_s + 0.20 * area_s + 0.16 * coalesce(image_s, 0.0), 4) AS score FROM s WHERE round(0.28 * disaster_s + 0.18 * temporal_s + 0.20 * area_s + 0.16 * coalesce(image_s, 0.0), 4) > 0 ORDER BY score DESC, case_id LIMIT 5")
def weighted_similarity(spark, sf_dir):
    rows = _dims(spark, sf_dir).withColumn("pos", F.col("case_id"))
    scores = {"disaster": F.col("disaster_s"), "temporal": F.col("temporal_s"), "spatial": F.col("area_s"), "image": F.col("image_s")}
    return similarity.matched(rows, scores).select("case_id", "score")


@query(SCORES + "SELECT case_id, round((0.25 * area_s + 0.55 * disaster_s + 0.2 * temporal_s + 0.3 * coalesce(image_s, 0.0)) / (1.0 + CASE WHEN image_s IS NULL THEN 0.0 ELSE 0.3 END), 6) AS score FROM s")
def requested_dims_mean(spark, sf_dir):
    names, weights = ["area", "disaster", "temporal", "image"], {"area": 0.25, "disaster": 0.55, "temporal": 0.2, "image": 0.3}
    return _dims(spark, sf_dir).select("case_id", F.round(weighted_mean({n: F.col(f"{n}_s") for n in names}, weights), 6).alias("score"))


FUSED = SCORES + """, f AS (SELECT case_id, custkey % 7 AS source, round(0.25 * area_s + 0.55 * disaster_s + 0.2 * temporal_s, 6) AS structured, image_s AS semantic FROM s),
p AS (SELECT *, round(CASE WHEN semantic IS NOT NULL THEN 0.65 * structured + 0.35 * semantic ELSE structured END, 6) AS score FROM f),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, case_id DESC) AS pos FROM p ORDER BY pos LIMIT 200),
g AS (SELECT * FROM r WHERE CASE WHEN (SELECT max(structured) FROM r) >= 0.30 THEN structured >= 0.30 ELSE pos = 1 AND structured >= 0.15 END),
c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos) AS rn FROM g) """


@query(FUSED + "SELECT case_id, score, pos FROM (SELECT * FROM c ORDER BY rn > 2, pos LIMIT 10)")
def fuse_gate_select(spark, sf_dir):
    d = _dims(spark, sf_dir)
    rows = d.select("case_id", (F.col("custkey") % 7).alias("source"), F.round(0.25 * F.col("area_s") + 0.55 * F.col("disaster_s") + 0.2 * F.col("temporal_s"), 6).alias("structured"), F.col("image_s").alias("semantic"))
    best = rows.withColumn("score", similarity.fused(F.col("structured"), F.col("semantic"))).orderBy(F.desc("score"), F.desc("case_id")).limit(200)
    best = A.ranked(best, [F.desc("score"), F.desc("case_id")], "pos")
    return similarity.select(best, "structured", "source", "pos", 10).select("case_id", "score", "pos")


@query(SCORES + "SELECT case_id, round(0.8 * (0.55 + 0.45 * (disaster_s * (0.45 + 0.55 * area_s))), 6) AS score FROM s")
def compat_effective(spark, sf_dir):
    eff = similarity.effective(F.col("disaster_s"), F.col("area_s"))
    return _dims(spark, sf_dir).select("case_id", similarity.penalised(F.lit(0.8), eff).alias("score"))


@query("""WITH s AS (SELECT s_nationkey k, list(DISTINCT CAST(s_suppkey % 11 AS BIGINT)) v FROM supplier GROUP BY 1)
SELECT a.k AS left_key, s.k AS right_key, round(CAST(len(list_intersect(a.v, s.v)) AS DOUBLE) / len(list_distinct(list_concat(a.v, s.v))), 6) AS jaccard FROM s a, s WHERE len(list_intersect(a.v, s.v)) > 0""")
def area_jaccard(spark, sf_dir):
    """Pairs of areas that share an element, joined by the elements: no pair that shares nothing is made."""
    s = S.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), (F.col("s_suppkey") % 11).alias("x")).distinct()
    sizes = s.groupBy("k").agg(F.count("*").alias("n"))
    both = s.toDF("left_key", "x").join(s.toDF("right_key", "x"), "x").groupBy("left_key", "right_key").agg(F.count("*").alias("c"))
    both = both.join(sizes.toDF("left_key", "a"), "left_key").join(sizes.toDF("right_key", "b"), "right_key")
    return both.select("left_key", "right_key", F.round(F.col("c") / (F.col("a") + F.col("b") - F.col("c")), 6).alias("jaccard"))


@query("SELECT p_partkey, CAST(CASE WHEN p_retailprice / 40 >= 56.1 THEN 17 WHEN p_retailprice / 40 >= 51 THEN 16 WHEN p_retailprice / 40 >= 46.2 THEN 15 WHEN p_retailprice / 40 >= 41.5 THEN 14 WHEN p_retailprice / 40 >= 37 THEN 13 WHEN p_retailprice / 40 >= 32.7 THEN 12 WHEN p_retailprice / 40 >= 28.5 THEN 11 WHEN p_retailprice / 40 >= 24.5 THEN 10 WHEN p_retailprice / 40 >= 20.8 THEN 9 WHEN p_retailprice / 40 >= 17.2 THEN 8 WHEN p_retailprice / 40 >= 13.9 THEN 7 WHEN p_retailprice / 40 >= 10.8 THEN 6 WHEN p_retailprice / 40 >= 8 THEN 5 WHEN p_retailprice / 40 >= 5.5 THEN 4 WHEN p_retailprice / 40 >= 3.4 THEN 3 WHEN p_retailprice / 40 >= 1.6 THEN 2 WHEN p_retailprice / 40 >= 0.3 THEN 1 ELSE 0 END AS BIGINT) AS force FROM part")
def beaufort_levels(spark, sf_dir):
    from ..functions.scalars import wind_force

    return S.table(spark, sf_dir, "part").select("p_partkey", wind_force(F.col("p_retailprice") / 40).cast("long").alias("force"))


@query(CASES + "SELECT case_id FROM cases WHERE custkey = 7 UNION ALL SELECT case_id FROM cases WHERE NOT EXISTS (SELECT 1 FROM cases WHERE custkey = 7)")
def scope_fallback(spark, sf_dir):
    scope = spark.createDataFrame([(7,)], "custkey long")
    return filters.scoped(case_rows(spark, sf_dir), scope, "custkey").select("case_id")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey <> 3 AND c_custkey % 2 = 1")
def metadata_filter(spark, sf_dir):
    rows = S.table(spark, sf_dir, "customer").withColumn("metadata", F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("odd"), (F.col("c_custkey") % 2).cast("string")))
    return rows.filter(filters.metadata_matches({"segment": {"$in": ["BUILDING", "MACHINERY"]}, "nation": {"$ne": "3"}, "odd": "1"})).select("c_custkey", "c_name")


@query("SELECT o_orderkey AS id, coalesce(n.v, o_totalprice) AS value FROM orders LEFT JOIN (SELECT o_orderkey k, o_totalprice * 2 AS v FROM orders WHERE o_orderkey % 10 = 0) n ON o_orderkey = n.k WHERE o_orderkey % 7 <> 0")
def upsert_merge(spark, sf_dir):
    old = S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"))
    new = old.filter("id % 10 = 0").withColumn("value", F.col("value") * 2)
    return S.delete(S.upsert(old, new, "id"), old.filter("id % 7 = 0"), "id")


@query("WITH n AS (SELECT c_custkey + 10 AS c_custkey, (c_nationkey + c_custkey % 2) % 25 AS c_nationkey FROM customer) SELECT CASE WHEN t.c_custkey IS NULL THEN 'inserted' WHEN t.c_nationkey = n.c_nationkey THEN 'skipped' ELSE 'conflict' END AS outcome, count(*) AS n FROM n LEFT JOIN customer t USING (c_custkey) GROUP BY 1")
def insert_or_skip_counts(spark, sf_dir):
    have = S.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("c_nationkey"))
    new = have.select((F.col("c_custkey") + 10).alias("c_custkey"), ((F.col("c_nationkey") + F.col("c_custkey") % 2) % 25).alias("c_nationkey"))
    return S.insert_or_skip(have, new, "c_custkey", "c_nationkey").groupBy("outcome").agg(F.count("*").alias("n"))


@query("SELECT coalesce(CAST(year(o_orderdate) AS BIGINT), -1) AS year, coalesce(o_orderpriority, 'all') AS o_orderpriority, grouping(o_orderpriority) + 2 * grouping(year(o_orderdate)) AS level, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (year(o_orderdate), o_orderpriority)")
def case_rollup(spark, sf_dir):
    rows = S.table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate").cast("long"))
    return rows.rollup("year", "o_orderpriority").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).na.fill({"year": -1, "o_orderpriority": "all"})

"""Queries over embeddings: dense retrieval, tenants, reranking, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import aggregates as A
from ..operators import ann, evaluation, ranking, retrieval
from ..sources import tables as S
from .registry import query

DENSE = """WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qe, label AS ql FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id, label, ql, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), qe), 6) AS score FROM embeddings, q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS BIGINT) AS rank FROM s) """


def queries(v):
    """Every id divisible by 100."""
    return v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


@query(DENSE + "SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 10")
def cosine_topk(spark, sf_dir):
    v = S.table(spark, sf_dir, "embeddings")
    return retrieval.dense(v, queries(v), 10)


@query(DENSE.replace("FROM embeddings, q)", "FROM embeddings, q WHERE label = 3)") + "SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 5")
def tenant_dense(spark, sf_dir):
    v = S.table(spark, sf_dir, "embeddings")
    return retrieval.dense(v, queries(v), 5, where=F.col("label") == 3)


@query(DENSE + "SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 10")
def inverted_file_exact(spark, sf_dir):
    """The exact mode of the approximate index: more cells until the bound proves the result."""
    v = S.table(spark, sf_dir, "embeddings")
    model = ann.fit(v, "vec_id", "embedding", 10)
    return ann.search(ann.index(v, "vec_id", "embedding", model), queries(v), model, 10, "vec_id", exact=True, probes=4)


@query("SELECT count(*) AS queries, true AS all_ranked, true AS recall_reached FROM embeddings WHERE vec_id % 100 = 0")
def inverted_file_recall(spark, sf_dir):
    """Recall of the approximate mode (cells calibrated on a sample, codes, re-ranking) against all products: at least 0.9."""
    v = S.table(spark, sf_dir, "embeddings")
    model = ann.fit(v, "vec_id", "embedding", 10)
    near = ann.search(ann.index(v, "vec_id", "embedding", model), queries(v), model, 10, "vec_id")
    true = retrieval.dense(v, queries(v), 10)
    both = true.join(near.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    per = both.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"), F.count("*").alias("n"))
    return per.agg(F.count("*").alias("queries"), F.min(F.col("n") == 10).alias("all_ranked"), (F.avg("recall") >= 0.9).alias("recall_reached"))


@query(DENSE + """, c AS (SELECT DISTINCT query_id, vec_id % 40 AS case_id FROM r WHERE rank <= 20), x AS (SELECT c.query_id, c.case_id, e.vec_id, least(1.0, greatest(0.0, (list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), q.qe) + 1) / 2)) AS s FROM c JOIN q USING (query_id) JOIN embeddings e ON e.vec_id % 40 = c.case_id),
m AS (SELECT *, row_number() OVER (PARTITION BY query_id, case_id ORDER BY s DESC, vec_id) rn FROM x)
SELECT query_id, case_id, round(avg(s) FILTER (rn <= 2), 6) AS semantic, count(*) AS hits FROM m WHERE rn <= 4 GROUP BY 1, 2""")
def semantic_scores(spark, sf_dir):
    """Of each query the cases of its twenty best chunks, scored by all their chunks."""
    v = S.table(spark, sf_dir, "embeddings")
    case = (F.col("vec_id") % 40).alias("case_id")
    candidates = retrieval.dense(v, queries(v), 20).select("query_id", case).distinct()
    return retrieval.candidate_scores(candidates, v.select(case, "vec_id", "embedding"), queries(v), "vec_id")


@query(DENSE + """, p AS (SELECT query_id, vec_id % 30 AS case_id, score AS cosine, CAST((vec_id * 37) % 101 AS DOUBLE) AS rerank FROM r WHERE rank <= 60),
x AS (SELECT *, (rerank - min(rerank) OVER w) / (max(rerank) OVER w - min(rerank) OVER w) AS r FROM p WINDOW w AS (PARTITION BY query_id)), n AS (SELECT *, row_number() OVER (PARTITION BY query_id, case_id ORDER BY r DESC, cosine DESC) rn FROM x)
SELECT query_id, case_id, round(0.7 * avg(cosine) + 0.3 * max(r), 6) AS score FROM n WHERE rn <= 2 GROUP BY 1, 2""")
def rerank_merge(spark, sf_dir):
    """The sixty best chunks of each query go to a reranker; its scores are stretched for each query."""
    v = S.table(spark, sf_dir, "embeddings")
    rows = retrieval.dense(v, queries(v), 60)
    return retrieval.rerank_merge(rows.select("query_id", (F.col("vec_id") % 30).alias("case_id"), F.col("score").alias("cosine"), ((F.col("vec_id") * 37) % 101).cast("double").alias("rerank")))


def results(spark, sf_dir):
    """backend, expected (same label, the ten least ids), actual (ranked ids)."""
    v = S.table(spark, sf_dir, "embeddings")
    q = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql"))
    same = v.join(F.broadcast(q), F.col("label") == F.col("ql"))
    few = same.withColumn("_n", F.row_number().over(W.partitionBy("query_id").orderBy("vec_id"))).filter("_n <= 10")
    expected = few.groupBy("query_id").agg(F.sort_array(F.collect_list("vec_id")).alias("expected"))
    out = None
    for name, where in (("all", None), ("even", F.col("vec_id") % 2 == 0)):
        r = retrieval.dense(v, queries(v), 10, where=where).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda x: x["vec_id"]).alias("actual"))
        r = r.join(expected, "query_id").withColumn("backend", F.lit(name))
        out = r if out is None else out.unionByName(r)
    return out


IR = DENSE + """, lab AS (SELECT q.query_id, vec_id, row_number() OVER (PARTITION BY q.query_id ORDER BY vec_id) rn FROM embeddings e JOIN q ON e.label = q.ql), ex AS (SELECT query_id, vec_id FROM lab WHERE rn <= 10),
b AS (SELECT 'all' AS backend, query_id, vec_id, rank FROM r WHERE rank <= 10 UNION ALL SELECT 'even', query_id, vec_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM s WHERE vec_id % 2 = 0) t(query_id, vec_id, label, ql, score, rank) WHERE rank <= 10),
m AS (SELECT backend, b.query_id, max(CASE WHEN ex.vec_id IS NOT NULL AND rank <= 3 THEN 1.0 ELSE 0 END) AS hit, sum(CASE WHEN ex.vec_id IS NOT NULL AND rank <= 5 THEN 1.0 ELSE 0 END) / (SELECT count(*) FROM ex e WHERE e.query_id = b.query_id) AS rec, coalesce(max(CASE WHEN ex.vec_id IS NOT NULL THEN 1.0 / rank END), 0) AS rr FROM b LEFT JOIN ex ON ex.query_id = b.query_id AND ex.vec_id = b.vec_id GROUP BY 1, 2) """


@query(IR + "SELECT backend, CAST(round(avg(hit), 6) AS DOUBLE) AS hit_3, CAST(round(avg(rec), 6) AS DOUBLE) AS recall_5, CAST(round(avg(rr), 6) AS DOUBLE) AS mrr, count(*) AS n FROM m GROUP BY 1")
def ir_metrics(spark, sf_dir):
    return evaluation.backend_report(results(spark, sf_dir))


@query(IR + "SELECT CAST(round(avg(hit), 6) AS DOUBLE) AS hit, CAST(round(avg(rr), 6) AS DOUBLE) AS rr, CAST(sum(CASE WHEN hit = 0 THEN 1 ELSE 0 END) AS BIGINT) AS misses FROM m")
def metric_rollup(spark, sf_dir):
    e, a = F.col("expected"), F.col("actual")
    rows = results(spark, sf_dir).select(evaluation.hit_at(e, a, 3).alias("hit"), evaluation.reciprocal_rank(e, a).alias("rr"))
    return A.rollup(rows.withColumn("misses", (F.col("hit") == 0).cast("long")), ["hit", "rr"], ["misses"])


@query("SELECT label, count(*) AS indexed, CAST(max(len(embedding)) AS BIGINT) AS dimension FROM embeddings GROUP BY 1")
def collection_stats(spark, sf_dir):
    v = retrieval.check_dimension(S.table(spark, sf_dir, "embeddings"), "embedding", 64)
    return v.groupBy("label").agg(F.count("embedding").alias("indexed"), F.max(F.size("embedding")).cast("long").alias("dimension"))


@query(DENSE.replace("WITH q", "WITH RECURSIVE q", 1) + """, t AS (SELECT query_id, vec_id, rank, score, (vec_id % 5) / CAST(10 AS DOUBLE) AS compat, vec_id * 7919 % 101 AS outside FROM r WHERE rank <= 15),
w AS (SELECT *, score AS head, compat AS head_compat, CAST(0 AS BIGINT) AS tie_group FROM t WHERE rank = 1
UNION ALL SELECT t.*, CASE WHEN w.head - t.score > 0.08 OR abs(w.head_compat - t.compat) > 0.12 THEN t.score ELSE w.head END, CASE WHEN w.head - t.score > 0.08 OR abs(w.head_compat - t.compat) > 0.12 THEN t.compat ELSE w.head_compat END,
CASE WHEN w.head - t.score > 0.08 OR abs(w.head_compat - t.compat) > 0.12 THEN w.tie_group + 1 ELSE w.tie_group END FROM w JOIN t ON t.query_id = w.query_id AND t.rank = w.rank + 1)
SELECT query_id, vec_id, tie_group, row_number() OVER (PARTITION BY query_id ORDER BY tie_group, outside, rank) AS final_rank FROM w""")
def tie_break_groups(spark, sf_dir):
    v = S.table(spark, sf_dir, "embeddings")
    top = retrieval.dense(v, queries(v), 15).withColumn("compat", (F.col("vec_id") % 5) / 10.0).withColumn("outside", F.col("vec_id") * 7919 % 101)
    return ranking.tie_break(top, "query_id", "rank", "score", "compat", "outside").select("query_id", "vec_id", "tie_group", "final_rank")

"""Dense, lexical and fused retrieval over chunk tables, for one query or a table of queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions.scalars import lexical_terms
from .blocks import best as best_columns
from .blocks import matrices, top_cosines, unit_rows

DENSE, SPARSE, RRF_K, BM25_K1, BM25_B = 30, 30, 60, 1.2, 0.75


def check_dimension(rows: DataFrame, vector: str, n: int) -> DataFrame:
    """Raises at run time if a vector has another length."""
    return rows.withColumn(vector, F.when(F.size(vector) == n, F.col(vector)).otherwise(F.raise_error(F.lit(f"vector of another dimension than {n}"))))


def dense(rows: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", where: Column | None = None) -> DataFrame:
    """Exact cosine top k of each query (query_id, query_vector): a stated query set against all rows, matrix by matrix.

    Neither side is broadcast, and no pair of rows is made: see ``blocks``.
    """
    return top_cosines(rows.filter(where) if where is not None else rows, queries, k, key, vector)


def _top(scored: DataFrame, k: int, key: str) -> DataFrame:
    w = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc(key))
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def lexical(rows: DataFrame, query: str, k: int, key: str, text: str) -> DataFrame:
    """Sum of the lengths of the query's terms that a text contains, blanks removed; zero scores dropped."""
    bare, terms = F.replace(F.lower(text), F.lit(" "), F.lit("")), lexical_terms(F.lit(query))
    score = F.aggregate(F.filter(terms, lambda t: F.contains(bare, t)), F.lit(0), lambda s, t: s + F.greatest(F.lit(1), F.length(t)))
    return rows.select(key, score.cast("long").alias("score")).filter("score > 0").orderBy(F.desc("score"), key).limit(k)


def bm25(rows: DataFrame, queries: DataFrame, k: int, key: str, tokens: Column, k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """BM25 top k of each query (query_id, query_tokens). Statistics over all rows; only query terms are kept after the scan."""
    wanted = queries.select("query_id", F.explode(F.array_distinct("query_tokens")).alias("term"))
    docs = rows.select(key, tokens.alias("_t")).withColumn("_len", F.size("_t"))
    stats = docs.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"))
    hits = docs.select(key, "_len", F.explode("_t").alias("term")).join(F.broadcast(wanted.select("term").distinct()), "term", "left_semi")
    tf = hits.groupBy("term", key).agg(F.count("*").alias("tf"), F.first("_len").alias("_len"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("_n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("_len") / F.col("_avg")))
    weighed = tf.join(df, "term").crossJoin(F.broadcast(stats)).select("term", key, part.alias("part"))  # stats: one row
    scored = weighed.join(wanted, "term").groupBy("query_id", key).agg(F.round(F.sum("part"), 6).alias("score"))
    return _top(scored, k, key)


def fuse(branches: list[DataFrame], k: int, key: str, constant: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (query_id, key, rank)."""
    rows = branches[0].select("query_id", key, "rank")
    for b in branches[1:]:
        rows = rows.unionAll(b.select("query_id", key, "rank"))
    return _top(rows.groupBy("query_id", key).agg(F.round(F.sum(1 / (constant + F.col("rank"))), 8).alias("score")), k, key)


def hybrid(rows: DataFrame, queries: DataFrame, k: int, key: str, vector: str, tokens: Column, where: Column | None = None) -> DataFrame:
    """Dense and BM25 branches, fused; ``where`` (tenant, cases) is pushed into both."""
    rows = rows.filter(where) if where is not None else rows
    return fuse([dense(rows, queries, DENSE, key, vector), bm25(rows, queries, SPARSE, key, tokens)], k, key)


def retrieve(rows: DataFrame, query: str, vectors: DataFrame | None, k: int, key: str, text: str, ids: DataFrame | None = None) -> tuple[DataFrame, str, str]:
    """Vectors over the scope, then words over it; on no hit the next step, at last words over all rows. With the mode that answered, and why."""
    steps = []
    if vectors is not None and "embedding" in rows.columns:
        steps.append((ids, True))
    steps += [(ids, False)] + ([(None, False)] if ids is not None else [])
    reasons = [] if steps[0][1] else ["no vectors"]
    for within, dense_step in steps:
        scope = rows.join(within.select(key).distinct(), key, "left_semi") if within is not None else rows
        mode = ("scoped-" if within is not None else "") + ("vector" if dense_step else "lexical")
        found = dense(scope, vectors, k, key) if dense_step else lexical(scope, query, k, key, text)
        if not found.isEmpty():
            break
        reasons.append(f"{mode} found nothing")
    return found, mode, "; ".join(reasons)


CASE_SHARD = 8192  # chunks of a case that meet in one matrix; larger cases have several


def candidate_scores(candidates: DataFrame, chunks: DataFrame, queries: DataFrame, key: str, keep: int = 4, best: int = 2) -> DataFrame:
    """Semantic score of each query's candidate cases: mean of their two best chunks' mapped cosines.

    candidates: (query_id, case_id); chunks: (case_id, key, embedding). Only chunks of a query's own candidates are scored for it: a
    case's queries meet its chunks as matrices, of which ``keep`` rows for each query go on; no table of pairs is made.
    """
    vectors = chunks.select("case_id", F.col(key).alias("key"), "embedding").filter("case_id is not null")
    sizes = vectors.groupBy("case_id").agg(F.ceil(F.count("*") / CASE_SHARD).cast("int").alias("shards"))
    dealt = vectors.join(sizes, "case_id").withColumn("shard", F.pmod(F.xxhash64("key"), F.col("shards")).cast("int"))
    askers = candidates.join(queries, "query_id").join(sizes, "case_id").select("case_id", "query_id", "query_vector", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))

    def score(asked: pa.Table, held: pa.Table) -> pa.Table:
        held = held.sort_by("key")
        out = []
        for q_at, q in matrices(asked["query_vector"]):
            parts = [(at, m[:, : q.shape[1]]) for at, m in matrices(held["embedding"])]
            for i in range(0, len(q), 256):
                some, at, values = q[i : i + 256], [], []
                for places, m in parts:
                    cut = some[:, : m.shape[1]]
                    at.append(places)
                    values.append(np.clip((unit_rows(cut) @ unit_rows(m).T + 1) / 2, 0.0, 1.0))
                if not at:
                    continue
                order = np.argsort(np.concatenate(at))
                columns, top = best_columns(np.concatenate(values, axis=1)[:, order], keep)
                whose = np.repeat(q_at[i : i + 256], columns.shape[1])
                out.append(pa.table({"query_id": asked["query_id"].take(pa.array(whose)), "case_id": asked["case_id"].take(pa.array(whose)), "key": held["key"].take(pa.array(columns.ravel())), "s": pa.array(top.ravel())}))
        return pa.concat_tables(out) if out else pa.table({"query_id": asked["query_id"].slice(0, 0), "case_id": asked["case_id"].slice(0, 0), "key": held["key"].slice(0, 0), "s": pa.array([], pa.float64())})

    kind = T.StructType([queries.schema["query_id"], vectors.schema["case_id"], vectors.schema["key"], T.StructField("s", T.DoubleType())])
    scored = askers.groupBy("case_id", "shard").cogroup(dealt.select("case_id", "shard", "key", "embedding").groupBy("case_id", "shard")).applyInArrow(score, kind)
    w = W.partitionBy("query_id", "case_id").orderBy(F.desc("s"), "key")
    top = scored.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= keep)
    return top.groupBy("query_id", "case_id").agg(F.round(F.avg(F.when(F.col("_n") <= best, F.col("s"))), 6).alias("semantic"), F.count("*").alias("hits"))


def pool(links: DataFrame, limit: int, key: str, chars: int = 1800) -> DataFrame:
    """Each chunk once, texts cut, best cosines first, for a reranker."""
    w = W.partitionBy(key).orderBy(F.desc("score"), "case_id")
    once = links.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return once.withColumn("content", F.substring("content", 1, chars)).orderBy(F.desc("score"), key).limit(limit)


def rerank_merge(scores: DataFrame, weight: float = 0.7) -> DataFrame:
    """(query_id, case_id, cosine, rerank) of reranked chunks -> 0.7 mean of the two best cosines + 0.3 rerank score stretched over the query's chunks."""
    ends = scores.groupBy("query_id").agg(F.min("rerank").alias("_lo"), F.max("rerank").alias("_hi"))
    x = scores.join(ends, "query_id").withColumn("_r", F.when(F.col("_hi") > F.col("_lo"), (F.col("rerank") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(1.0))
    w = W.partitionBy("query_id", "case_id").orderBy(F.desc("_r"), F.desc("cosine"))
    top = x.withColumn("_n", F.row_number().over(w)).filter("_n <= 2")
    score = weight * F.avg("cosine") + round(1 - weight, 12) * F.max("_r")
    # cosines of six decimals make exact halves common: those of the product, not of the shortest decimal, round up
    return top.groupBy("query_id", "case_id").agg((F.round(score * 1e6) / 1e6).alias("score"))


def evidence_rank(rows: DataFrame, text: str, dates: list[str], terms: list[str]) -> DataFrame:
    """12 for each date term and at least 2 for each evidence term that a text holds."""
    date = sum((F.when(F.contains(text, F.lit(t)), 12).otherwise(0) for t in dates), F.lit(0))
    word = sum((F.when(F.contains(text, F.lit(t)), max(2, len(t))).otherwise(0) for t in terms), F.lit(0))
    return rows.withColumn("evidence", date + word)


def relevant_chunks(rows: DataFrame, case: str, pos: str, text: str, terms: list[str], semantic: Column, limit: int = 6) -> DataFrame:
    """1 for each term, 5 for a semantic hit, 2 for a number with a unit; the best of a case in document order."""
    score = sum((F.when(F.contains(text, F.lit(t)), 1).otherwise(0) for t in terms), F.lit(0)) + F.when(semantic, 5).otherwise(0)
    score = score + F.when(F.col(text).rlike(r"\d+(?:\.\d+)?\s*(?:mm|cm|km|m/s|m|℃|毫米|米|级)"), 2).otherwise(0)
    w = W.partitionBy(case).orderBy(F.desc("relevance"), pos)
    return rows.withColumn("relevance", score).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit).drop("_n")


def evidence_sentence(parts: Column, keywords: list[str], chars: int = 120) -> Column:
    """The first sentence with a keyword, else the first."""
    hit = F.filter(parts, lambda s: F.exists(F.array(*map(F.lit, keywords)), lambda k: F.contains(s, k)))
    return F.substring(F.coalesce(F.get(hit, F.lit(0)), F.get(parts, F.lit(0))), 1, chars)

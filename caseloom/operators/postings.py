"""A persisted inverted index with block maxima: BM25 top k that reads only the blocks that can matter.

Documents belong to blocks of about ``BLOCK_DOCS``, the same for all terms, so that a document's whole score comes from
one block. A term's postings are a row for each block, next to their number, their highest frequency and their
least document length; the rows lie in folders by a hash of the term. A search takes the query terms' rows out of the index
once, reads their maxima (not the postings: other columns), bounds every block, and scores blocks in the order of their bounds,
few at first and then four times as many in each round, until no bound reaches the k-th score found so far. New documents are
appended as blocks of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..sources.shared import materialize

BLOCK_DOCS, BUCKETS, FIRST = 1024, 16, 2  # documents of a block; folders of terms; blocks that each query scores first
K1, B = 1.2, 0.75
PART_TOKENS, TASKS = 1 << 23, 4096  # tokens of a block that are counted together (longer documents are counted in parts of their block); most tasks that count
MARGIN = 1e-6  # scores are rounded to six decimals before they are compared


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def append(rows: DataFrame, key: str, tokens: Column, path: str, generation: int = 0, block_docs: int = BLOCK_DOCS) -> None:
    """Adds documents to the index at a path (the first ones make it). generation: another number for each call.

    Null and empty token arrays are documents of length 0; a key must not come twice. Postings of a term in a
    block are as many as a block has documents, however frequent the term.
    """
    words = F.coalesce(tokens, F.array().cast("array<string>"))
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum(F.size(words)), F.lit(0))).first()
    blocks = max(1, -(-n // block_docs))
    block = F.lit(generation).cast("long") * (1 << 32) + F.pmod(F.xxhash64(key), F.lit(blocks))
    # documents meet by block before their words are counted, so that neither counting nor listing shuffles words
    dealt, by, parts = rows.withColumn("_block", block), ["block"], max(1, -(-total // (blocks * PART_TOKENS)))
    if parts > 1:
        dealt, by = dealt.withColumn("_part", F.pmod(F.xxhash64(F.lit(1), key), F.lit(parts))), ["block", "part"]
    dealt = dealt.repartition(min(blocks * parts, TASKS), *[f"_{c}" for c in by])
    docs = dealt.select(*[F.col(f"_{c}").alias(c) for c in by], F.col(key).alias("key"), words.alias("t")).withColumn("len", F.size("t"))
    tf = docs.select(*by, "key", "len", F.explode("t").alias("term")).groupBy(*by, "term", "key", "len").agg(F.count("*").cast("int").alias("tf"))
    lists = tf.groupBy("term", "block").agg(F.sort_array(F.collect_list(F.struct("key", "tf", "len"))).alias("postings"), F.count("*").alias("n"), F.max("tf").alias("most"), F.min("len").alias("shortest"))
    lists = lists.withColumn("bucket", _bucket(F.col("term"))).repartition("bucket", F.pmod(F.xxhash64("block"), F.lit(8))).sortWithinPartitions("bucket", "term")
    lists.write.mode("append").partitionBy("bucket").parquet(f"{path}/lists")
    kind = T.StructType([T.StructField(c, T.LongType()) for c in ("generation", "n", "total")])
    rows.sparkSession.createDataFrame([(generation, n, total)], kind).write.mode("append").parquet(f"{path}/sizes")


def _part(idf: Column, tf: Column, size: Column, mean: float, k1: float, b: float) -> Column:
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / F.lit(mean)))


def plan(spark: SparkSession, path: str, queries: DataFrame, k1: float = K1, b: float = B) -> tuple[DataFrame, DataFrame, float, DataFrame]:
    """(query_id, block, bound), (query_id, term, bucket, idf), mean length, the index's rows of the asked terms: what a search knows before it reads postings.

    queries: query_id, query_tokens. Each term of a query counts once.
    """
    n, total = spark.read.parquet(f"{path}/sizes").agg(F.sum("n"), F.sum("total")).first()
    mean = max(total / n, 1e-9) if n else 1.0
    wanted = queries.select("query_id", F.explode(F.array_distinct("query_tokens")).alias("term")).withColumn("bucket", _bucket(F.col("term")))
    lists = materialize(spark.read.parquet(f"{path}/lists").join(wanted.select("bucket", "term").distinct(), ["bucket", "term"]), "asked-lists")
    heads = lists.select("bucket", "term", "block", "n", "most", "shortest")
    df = heads.groupBy("term").agg(F.sum("n").alias("df"))
    told = materialize(wanted.join(df, "term").select("query_id", "term", "bucket", F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")), "told")
    bounds = told.join(heads, ["bucket", "term"]).groupBy("query_id", "block").agg(F.sum(_part(F.col("idf"), F.col("most"), F.col("shortest"), mean, k1, b)).alias("bound"))
    return materialize(bounds, "bounds"), told, mean, lists


def _score(lists: DataFrame, chosen: DataFrame, told: DataFrame, mean: float, k1: float, b: float) -> DataFrame:
    """query_id, key, score of all documents of the chosen (query_id, block) that hold a term of the query."""
    asked = chosen.select("query_id", "block").join(told, "query_id")
    found = lists.select("bucket", "term", "block", "postings").join(asked, ["bucket", "term", "block"])
    each = found.select("query_id", "idf", F.explode("postings").alias("p")).select("query_id", F.col("p.key").alias("key"), _part(F.col("idf"), F.col("p.tf"), F.col("p.len"), mean, k1, b).alias("part"))
    return each.groupBy("query_id", "key").agg(F.round(F.sum("part"), 6).alias("score"))


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, key: str, k1: float = K1, b: float = B, first: int = FIRST) -> tuple[DataFrame, DataFrame]:
    """(query_id, key, score, rank: exactly the k documents of highest BM25, ties to the lesser key; the (query_id, block) that were scored)."""
    bounds, told, mean, lists = plan(spark, path, queries, k1, b)
    w, by_bound = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("key")), W.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    top = lambda rows: rows.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
    left, done, found, width = bounds, None, None, first
    while True:
        now = materialize(left.withColumn("nth", F.row_number().over(by_bound)).filter(F.col("nth") <= width).select("query_id", "block"), "chosen")
        score = _score(lists, now, told, mean, k1, b)
        found = materialize(top(found.unionByName(score) if found is not None else score).drop("rank"), "best-so-far")
        done = done.unionByName(now) if done is not None else now
        kth = top(found).filter(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
        left = left.join(now, ["query_id", "block"], "left_anti").join(kth, "query_id", "left").filter(F.col("kth").isNull() | (F.col("bound") + MARGIN >= F.col("kth"))).drop("kth")
        left, width = materialize(left, "open-blocks"), width * 4
        if left.isEmpty():
            return top(found).select("query_id", F.col("key").alias(key), "score", "rank"), done

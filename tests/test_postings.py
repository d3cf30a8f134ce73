import numpy as np
from pyspark.sql import functions as F

from caseloom.operators import postings, retrieval


def corpus(spark, n=3000):
    random = np.random.default_rng(0)
    words = [f"w{i}" for i in range(400)]
    p = 1 / np.arange(1, 401)
    docs = []
    for i in range(n):
        t = random.choice(words, int(random.integers(0, 60)), p=p / p.sum()).tolist()
        if i % 500 == 7:  # few documents are about the rare words
            t += ["rare"] * 6 + ["scarce"] * 3
        docs.append((i, t if i % 97 else None))
    docs[-1] = (n - 1, docs[-2][1])  # a tie
    return spark.createDataFrame(docs, "doc_id long, t array<string>")


def test_index_equals_all_scores_and_skips_blocks(spark, tmp_path):
    docs = corpus(spark)
    queries = spark.createDataFrame([(1, ["rare", "scarce", "w3", "w3"]), (2, ["w1", "w2", "w390"]), (3, ["nowhere"]), (4, []), (5, ["w50", "rare"])], "query_id int, query_tokens array<string>")
    path = str(tmp_path / "index")
    postings.append(docs.filter("doc_id < 2000"), "doc_id", F.col("t"), path, block_docs=64)
    postings.append(docs.filter("doc_id >= 2000"), "doc_id", F.col("t"), path, generation=1, block_docs=64)
    found, scored = postings.search(spark, path, queries, 5, "doc_id")
    tokens = F.coalesce("t", F.array().cast("array<string>"))
    want = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in retrieval.bm25(docs, queries, 5, "doc_id", tokens).collect()}
    assert {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in found.collect()} == want
    bounds = postings.plan(spark, path, queries)[0]
    of = {r.query_id: r["count"] for r in scored.groupBy("query_id").count().collect()}
    every = {r.query_id: r["count"] for r in bounds.groupBy("query_id").count().collect()}
    assert of[1] <= every[1] / 3 and of[5] <= every[5] / 3 and of[2] <= every[2] and 3 not in of
    assert spark.read.parquet(f"{path}/lists").agg(F.max("n")).first()[0] < 64 * 2


def test_empty_table(spark, tmp_path):
    docs, path = corpus(spark, 5).limit(0), str(tmp_path / "index")
    postings.append(docs, "doc_id", F.col("t"), path)
    queries = spark.createDataFrame([(1, ["rare"])], "query_id int, query_tokens array<string>")
    postings.append(corpus(spark, 50), "doc_id", F.col("t"), path, generation=1)
    assert postings.search(spark, path, queries, 5, "doc_id")[0].count() == 1


def test_an_index_in_parts_of_blocks_is_the_same(spark, tmp_path, monkeypatch):
    """Long documents are counted in parts of their block; documents meet before their words do: words are never shuffled one by one."""
    docs, queries = corpus(spark, 300), spark.createDataFrame([(1, ["rare", "w3"]), (2, ["w1", "w390"])], "query_id int, query_tokens array<string>")
    found = []
    for i, tokens in enumerate((1 << 23, 50)):
        monkeypatch.setattr(postings, "PART_TOKENS", tokens)
        path = str(tmp_path / str(i))
        postings.append(docs, "doc_id", F.col("t"), path, block_docs=64)
        lists = spark.read.parquet(f"{path}/lists")
        found.append((sorted(map(str, lists.collect())), sorted(postings.search(spark, path, queries, 5, "doc_id")[0].collect())))
        assert {c: lists.filter(F.size("postings") != F.col("n")).count() for c in ("n",)} == {"n": 0}
    assert found[0] == found[1] and len(found[0][1]) == 10

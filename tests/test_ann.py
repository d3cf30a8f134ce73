import numpy as np
from pyspark.sql import functions as F

from caseloom.operators import ann, retrieval


def rows(spark, n=4000, dim=16, seed=0):
    random = np.random.default_rng(seed)
    centres = random.normal(size=(20, dim)) * 2
    m = centres[random.integers(0, 20, n)] + random.normal(size=(n, dim))
    m[100:500] = m[100]  # copies
    data = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(n, None), (n + 1, [0.0] * dim), (n + 2, [1.0]), (n + 3, [float("nan")] * dim)]
    return spark.createDataFrame(data, "vec_id long, embedding array<double>")


def test_recall_and_exact_mode(spark):
    v = rows(spark)
    q = v.filter("vec_id % 100 = 0 and vec_id < 4000").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    model = ann.fit(v, "vec_id", "embedding", 10)
    held = ann.index(v, "vec_id", "embedding", model)
    assert sorted(k for r in held.collect() for k in r["keys"]) == list(range(4004))
    true = {(r.query_id, r.vec_id): (r.score, r["rank"]) for r in retrieval.dense(v, q, 10).collect()}
    near = ann.search(held, q, model, 10, "vec_id").collect()
    hits = sum((r.query_id, r.vec_id) in true for r in near)
    assert 1 <= model.probes < len(model.centres) and hits / len(true) >= 0.9
    exact = {(r.query_id, r.vec_id): (r.score, r["rank"]) for r in ann.search(held, q, model, 10, "vec_id", exact=True, probes=1).collect()}
    assert exact == true


def test_few_rows_and_none(spark):
    v = rows(spark).limit(3)
    q = v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    for some in (v, v.limit(0)):
        model = ann.fit(some, "vec_id", "embedding", 5)
        n = ann.search(ann.index(some, "vec_id", "embedding", model), q, model, 5, "vec_id", exact=True).count()
        assert n == 3 * some.count()


def test_codes_come_close():
    random = np.random.default_rng(1)
    m = random.normal(size=(3000, 32))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    centres = ann.kmeans(m, 8)
    model = ann.Model(centres, np.zeros((1, 1, 32)))
    cell = model.cell(m)
    rest = (m - centres[cell]).reshape(3000, 16, 2)
    model.books = np.stack([ann.kmeans(rest[:, p], 64) for p in range(16)])
    at = np.flatnonzero(cell == 3)
    guess = model.guessed(m[:50], 3, model.codes(m[at], cell[at]))
    assert np.abs(guess - m[:50] @ m[at].T).max() < 0.15

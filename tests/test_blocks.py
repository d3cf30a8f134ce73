import numpy as np
from pyspark.sql import functions as F

from caseloom.operators import blocks, order


def test_top_cosines_equal_all_products(spark, monkeypatch):
    random = np.random.default_rng(0)
    m = random.normal(size=(3000, 8)).round(3)
    m[100:900] = m[100]  # ties
    m[5] = 0
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(3000, None), (3001, [1.0]), (3002, [float("nan")] * 8)], "vec_id long, v array<double>")
    queries = rows.filter("vec_id % 100 = 0 or vec_id in (5, 3001)").select(F.col("vec_id").alias("query_id"), F.col("v").alias("query_vector"))
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in blocks.top_cosines(rows, queries, 7, "vec_id", "v").collect()}
    unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    for q in [*range(0, 3001, 100), 5, 3001]:
        s = np.zeros(3003)
        if q < 3000:
            s[:3000] = np.round(unit @ unit[q], 6)
        if q == 3001:
            s[3001] = 1.0
        want = sorted(range(3003), key=lambda i: (-s[i], i))[:7]
        assert [got[q, r + 1] for r in range(7)] == [(i, s[i]) for i in want], q


def test_small_matrices_meet_once_each(spark):
    rows = spark.range(500).select(F.col("id").alias("vec_id"), F.array(F.col("id") % 7 + 1.0, F.lit(1.0)).alias("v"))
    packed = blocks.packed(rows, "vec_id", "v", 16 * 64, 3)
    sizes = [len(r["keys"]) for r in packed.collect()]
    assert sum(sizes) == 500 and max(sizes) <= 64
    pairs = blocks.paired(packed, packed, len(sizes), {"a": "block"}, {"b": "block"}).collect()
    assert len(pairs) == len({(p.a, p.b) for p in pairs}) == len(sizes) ** 2


def test_places_over_a_hot_group(spark):
    rows = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 2 == 0, F.concat(F.lit("g"), (F.col("id") % 10).cast("string"))).alias("g"), (F.col("id") * 7919 % 5003).alias("x"))
    got = order.placed(rows, ["x"], ["g"], total="n").collect()
    by = {}
    for r in got:
        by.setdefault(r.g, []).append(r)
    assert None in by and len(got) == 5000
    for held in by.values():
        held.sort(key=lambda r: r.x)
        assert [r.place for r in held] == list(range(len(held))) and {r.n for r in held} == {len(held)}
    assert order.placed(rows.limit(0), ["x"], ["g"]).count() == 0


def test_percent_rank_with_ties_and_one_row(spark):
    rows = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 20).alias("s"))
    got = sorted({(r.s, round(r.percent, 9)) for r in order.percent_rank(rows, "s").collect()})
    scores = sorted(5 if i % 3 == 0 else i % 20 for i in range(1000))
    assert got == [(s, round(scores.index(s) / 999, 9)) for s in sorted(set(scores))]
    assert [r.percent for r in order.percent_rank(rows.limit(1), "s").collect()] == [0.0]

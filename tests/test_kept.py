from pyspark.sql import functions as F

from caseloom.sources import kept


def test_only_what_changed_is_computed(spark, tmp_path):
    path = str(tmp_path / "cache")
    make = lambda few: few.select("_key", F.upper("t").alias("up"))
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "id long, t string")
    first, computed = kept.cached(rows, ["t"], make, path, "1")
    assert sorted((r.id, r.up) for r in first.collect()) == [(1, "A"), (2, "B"), (3, "A"), (4, None)] and computed.count() == 3
    assert kept.cached(rows, ["t"], make, path, "1")[1].count() == 0
    changed = rows.withColumn("t", F.when(F.col("id") == 2, "c").otherwise(F.col("t")))
    again, computed = kept.cached(changed, ["t"], make, path, "1")
    assert [r.t for r in computed.collect()] == ["c"] and {r.up for r in again.collect()} == {"A", "C", None}
    assert kept.cached(rows, ["t"], make, path, "2")[1].count() == 3
    assert kept.cached(rows.limit(0), ["t"], make, str(tmp_path / "none"), "1")[0].count() == 0


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path, kind = str(tmp_path / "table"), "k long, v string, n long"
    rows = lambda *x: spark.createDataFrame(list(x), kind)
    schema = rows().schema
    assert kept.current(spark, path, schema).count() == 0
    assert kept.upsert(spark.range(500).select(F.col("id").alias("k"), F.lit("a").alias("v"), F.lit(0).cast("long").alias("n")), path, ["k"], ["n"], 0, buckets=16) == 16
    before = set((tmp_path / "table").glob("data-*/bucket=*"))
    assert kept.upsert(rows((7, "b", 1), (7, "old", -1)), path, ["k"], ["n"], 1, buckets=16) == 1
    after = set((tmp_path / "table").glob("data-*/bucket=*"))
    assert len(before & after) == 15 and len(after) == 16
    assert kept.upsert(rows((7, "twice", 9)), path, ["k"], ["n"], 1, buckets=16) == 0  # a retried batch
    got = {r.k: r.v for r in kept.current(spark, path, schema).collect()}
    assert len(got) == 500 and got[7] == "b" and got[8] == "a"
    kept.upsert(rows((7, None, 2)), path, ["k"], ["n"], 2, deleted=F.col("v").isNull(), buckets=16)
    assert 7 not in {r.k for r in kept.current(spark, path, schema).collect()}

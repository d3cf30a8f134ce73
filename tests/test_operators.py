"""Hand-worked expectations of operators, plans and streams."""

import pytest
from pyspark.sql import functions as F

from caseloom.operators import evaluation, filters, joins, state
from caseloom.plans.dag import Task, completed, narrowed
from caseloom.streaming import flows


def test_ranking_metrics(spark):
    cases = [(["c"], ["a", "b", "c"]), (["a", "d"], ["a", "b", "c"]), ([], []), ([], ["x"]), (["x"], [])]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, expected array<string>, actual array<string>")
    e, a = F.col("expected"), F.col("actual")
    out = [tuple(r) for r in df.select("i", evaluation.hit_at(e, a, 3), evaluation.recall_at(e, a, 5), evaluation.reciprocal_rank(e, a)).orderBy("i").collect()]
    assert out[0] == (0, 1.0, 1.0, pytest.approx(1 / 3)) and out[1][2] == 0.5
    assert [x[1:] for x in out[2:]] == [(1.0, 1.0, 1.0), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)]


def test_compare_ids_and_orphans(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(2,), (3,), (3,)], "id long")
    assert {tuple(r) for r in joins.compare_ids(a, b, "id").collect()} == {(1, "missing"), (2, "common"), (3, "extra")}
    assert [r.id for r in joins.orphans(a, b, "id").collect()] == [1]


def test_conditions_are_checked():
    assert filters.validate_conditions({"years": [2025], "months": [1, 12]})


def test_fixed_window_counts_refused_requests(spark):
    df = spark.createDataFrame([(1, f"2024-01-01 00:{m:02d}:00", m) for m in (1, 2, 3, 59)] + [(1, "2024-01-01 01:00:00", 60)], "k int, ts string, n int").withColumn("ts", F.to_timestamp("ts"))
    out = {r.n: r.allowed for r in state.fixed_window_limit(df, "k", "ts", ["n"], 2, 3600).collect()}
    assert out == {1: True, 2: True, 3: False, 59: False, 60: True}


def test_plans(spark):
    tasks = completed([Task("m", "metric", (), {"labels": ["x"], "months": [1]})])
    assert [t.kind for t in tasks] == ["identify", "metric"] and all("labels" not in t.conditions for t in tasks)
    with pytest.raises(ValueError):
        completed([Task("a", "list", ("nobody",))])
    scope, none = spark.range(3).withColumnRenamed("id", "case_id"), spark.range(0).withColumnRenamed("id", "case_id")
    assert narrowed(scope, [none]).count() == 0


def test_streamed_windows_and_breaker(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:01", 1.0, False), (1, "2024-01-01 00:00:02", 2.0, False), (1, "2024-01-01 00:00:03", 3.0, True), (2, "2024-01-01 02:00:00", 4.0, True)]
    df = spark.createDataFrame(rows, "k int, ts string, t double, ok boolean").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))

    def run(make, name, mode):
        stream = flows.file_stream(spark, str(tmp_path / "in"), df.schema)
        query = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return spark.table(name).collect()

    assert {(r.k, r.n, r.refused) for r in run(lambda s: flows.window_counts(s, "k", 2), "window_counts", "complete")} == {(1, 3, 1), (2, 1, 0)}
    got = sorted((r.service, r.t, r.state) for r in run(lambda s: flows.breaker(s, "k", "t", "ok", threshold=2), "breaker", "append"))
    assert got == [(1, 1.0, "closed"), (1, 2.0, "open"), (1, 3.0, "open"), (2, 4.0, "closed")]

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.operators import scan, state

RULES = [scan.Claims(7), scan.Claims(1), scan.Breaker(2, 5), scan.Breaker(3, 1), scan.Breaker(1, 20)]


@pytest.mark.parametrize("rule", RULES)
def test_chunks_composed_equal_the_whole(rule):
    random.seed(1)
    for _ in range(300):
        n = random.randint(1, 40)
        t = sorted(random.randint(0, 60) for _ in range(n))
        ok = [random.random() < 0.6 for _ in range(n)]
        whole = rule.replay(t, ok, rule.start)
        at, s, out = 0, rule.start, []
        while at < n:
            z = at + random.randint(1, 7)
            out += rule.replay(t[at:z], ok[at:z], s)
            s = rule.advance(rule.summarise(t[at:z], ok[at:z]), s)
            at = z
        assert out == whole


def test_breaker_equals_the_plain_fold():
    random.seed(2)
    for _ in range(200):
        n = random.randint(1, 60)
        rows = pd.DataFrame({"t": sorted(random.uniform(0, 90) for _ in range(n)), "ok": [random.random() < 0.5 for _ in range(n)]})
        assert scan.Breaker(3, 10.0).replay(rows["t"].tolist(), rows["ok"].tolist(), 0) == [x.replace("half-open", "closed") for x in state.circuit(rows, 3, 10.0)]


def test_a_hot_key_is_cut(spark):
    rows = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 9 == 0, F.lit("x")).alias("k"), (F.col("id") * 7919 % 3001).cast("double").alias("t"), (F.col("id") % 4 == 0).alias("ok"))
    for rule, kind in ((scan.Claims(10.0), T.BooleanType()), (scan.Breaker(3, 5.0), T.StringType())):
        got = {r.id: r.out for r in scan.scanned(rows, ["k"], "t", ["id"], rule, "out", kind, "ok", chunk=64).collect()}
        assert len(got) == 3000
        pdf = rows.toPandas().sort_values(["t", "id"])
        for _, part in pdf.groupby(pdf["k"].fillna("none")):
            assert [got[i] for i in part["id"]] == rule.replay(part["t"].tolist(), part["ok"].tolist(), rule.start)
    assert scan.scanned(rows.limit(0), ["k"], "t", ["id"], RULES[0], "out", T.BooleanType()).count() == 0


def test_keys_of_one_chunk_are_not_cut(spark, monkeypatch):
    """They pass in one shuffle, a group over several Arrow batches too; a null key is not the key of a zero character; rows without a time come last."""
    rows = spark.range(1200).select("id", F.when(F.col("id") % 4 == 1, F.lit("\0")).when(F.col("id") % 4 > 1, F.concat(F.lit("k"), (F.col("id") % 200).cast("string"))).alias("k"), F.when(F.col("id") % 40 > 1, (F.col("id") * 7919 % 1201).cast("long")).alias("t"))
    monkeypatch.setattr(scan, "placed", None)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.id: r.out for r in scan.scanned(rows, ["k"], "t", ["id"], scan.Claims(50), "out", T.BooleanType()).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    groups = {}
    for r in rows.collect():
        groups.setdefault(r.k, []).append((r.t is None, r.t or 0, r.id))
    want = {}
    for members in groups.values():
        until = None
        for missing, t, i in sorted(members):
            want[i] = until is None or (not missing and t >= until)
            if want[i]:
                until = t + 50
    assert got == want

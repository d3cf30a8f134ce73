"""Streams fed in several files, with a restart between, give what the batch rules give."""

import pytest
from pyspark.sql import functions as F

from caseloom.operators import state
from caseloom.sources import tables as S
from caseloom.streaming import stateful

from .conftest import SMALL


@pytest.fixture()
def fed(spark, tmp_path):
    events = S.table(spark, SMALL, "events").select("event_id", "ts", (F.col("user_id") % 9).alias("user_id"), "event_type", (F.col("event_type") != "error").alias("ok"))
    cuts = [i * 250 for i in range(5)]

    def feed(i):
        part = events.filter((F.col("event_id") >= cuts[i]) & (F.col("event_id") < (cuts[i + 1] if i + 1 < len(cuts) - 1 else 1 << 40)))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    return events, feed, str(tmp_path)


def test_claims_across_a_restart(spark, fed):
    events, feed, path = fed
    run = lambda: stateful.run_available(lambda s: stateful.claims(s, ["user_id", "event_type"], "ts", "event_id", 86400), spark, f"{path}/in", events.schema, f"{path}/claims")
    feed(0), feed(1), run()
    feed(2), feed(3), run()
    got = sorted(tuple(r) for r in spark.read.parquet(f"{path}/claims/rows").collect())
    want = sorted(tuple(r) for r in state.ttl_claims(events, ["user_id", "event_type"], "ts", "event_id", 86400).collect())
    assert got == want and len(want) > 50


def test_breakers_across_a_restart(spark, fed):
    events, feed, path = fed
    run = lambda: stateful.run_available(lambda s: stateful.breakers(s, "user_id", "ts", "ok", "event_id", 1, 60), spark, f"{path}/in", events.schema, f"{path}/breakers")
    feed(0), feed(1), run()
    feed(2), feed(3), run()
    rows = spark.read.parquet(f"{path}/breakers/rows").collect()
    got = {r.event_id: r.state for r in rows if r.event_id is not None}
    timed = events.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    want = {r.event_id: r.state for r in state.circuit_states(timed, "user_id", "t", "ok", "event_id", 1, 60.0).collect()}
    assert got == want and {"open", "closed"} <= set(want.values())


def test_a_timer_ends_the_cooldown(spark, tmp_path):
    """A service without rows is told half-open once the watermark passes its cooldown, also after a restart; its next row is the trial."""
    kind = "service long, ts timestamp, ok boolean, n long"
    said = [[(1, "2024-01-01 00:00:00", False, 0)], [(2, "2024-01-01 00:01:40", True, 1)], [(2, "2024-01-01 00:03:00", True, 2), (1, "2024-01-01 00:04:00", True, 3)]]
    schema = spark.createDataFrame([], kind).schema
    for part in said:
        rows = spark.createDataFrame([(k, None, ok, n) for k, _, ok, n in part], kind).join(spark.createDataFrame([(n, t) for _, t, _, n in part], "n long, t string"), "n")
        rows.select("service", F.to_timestamp("t").alias("ts"), "ok", "n").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stateful.run_available(lambda s: stateful.breakers(s, "service", "ts", "ok", "n", 1, 60), spark, str(tmp_path / "in"), schema, str(tmp_path / "out"))
    rows = {(r.service, r.n, r.state) for r in spark.read.parquet(str(tmp_path / "out" / "rows")).collect()}
    assert rows == {(1, 0, "open"), (1, None, "half-open"), (2, 1, "closed"), (2, 2, "closed"), (1, 3, "closed")}


def test_keys_share_buckets_of_state(spark, fed):
    """Three values of state for all keys: the rows that win are the same, a key's claims do not touch another's, null keys are one."""
    events, feed, path = fed
    feed(0), feed(1), feed(2), feed(3)
    held = lambda s: s.withColumn("user_id", F.when(F.col("user_id") > 2, F.col("user_id")))
    stateful.run_available(lambda s: stateful.claims(held(s), ["user_id", "event_type"], "ts", "event_id", 86400, buckets=3), spark, f"{path}/in", events.schema, f"{path}/claims", files=None)
    got = sorted(tuple(r) for r in spark.read.parquet(f"{path}/claims/rows").select("event_id").collect())
    want = sorted(tuple(r) for r in state.ttl_claims(held(events), ["user_id", "event_type"], "ts", "event_id", 86400).select("event_id").collect())
    assert got == want and len(want) > 50

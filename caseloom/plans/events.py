"""Queries over the event log: limits, claims, runs, percentiles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import aggregates as A
from ..operators import evaluation, ranking, state
from ..sources import kept
from ..sources import tables as S
from ..sources.shared import new_path
from ..streaming import stateful
from .registry import ORACLES, query


def log(spark, sf_dir):
    return S.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, floor(epoch(ts) / 3600) ORDER BY ts, event_id) <= 2 AS allowed FROM events")
def fixed_window_limit(spark, sf_dir):
    return state.fixed_window_limit(log(spark, sf_dir), "user_id", "ts", ["event_id"], 2, 3600).select("event_id", "allowed")


@query("SELECT event_id FROM (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS b FROM events) WHERE b IS NULL OR ts > b + INTERVAL 1 DAY")
def ttl_dedupe(spark, sf_dir):
    return state.ttl_gap(log(spark, sf_dir), ["user_id", "event_type"], "ts", ["event_id"], 86400).select("event_id")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS t FROM events),
w AS (SELECT user_id, event_type, arg_min(event_id, (t, event_id)) AS event_id, min(t) AS t FROM e GROUP BY 1, 2
UNION ALL SELECT w.user_id, w.event_type, n.event_id, n.t FROM w, LATERAL (SELECT arg_min(e.event_id, (e.t, e.event_id)) AS event_id, min(e.t) AS t FROM e WHERE e.user_id = w.user_id AND e.event_type = w.event_type AND e.t >= w.t + 86400000000) n WHERE n.t IS NOT NULL)
SELECT user_id, event_type, event_id FROM w""")
def ttl_claims(spark, sf_dir):
    return state.ttl_claims(log(spark, sf_dir), ["user_id", "event_type"], "ts", "event_id", 86400)


@query("SELECT user_id, event_id, CAST(age AS BIGINT) AS age, CASE WHEN age <= 5 THEN 'active' ELSE 'expired' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS age FROM events)")
def keep_latest_k(spark, sf_dir):
    return ranking.keep_latest(log(spark, sf_dir), "user_id", [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "event_id", "age", "status")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) rn FROM events) WHERE rn = 1")
def latest_state(spark, sf_dir):
    rows = log(spark, sf_dir).select("user_id", "event_type", "ts", "event_id", "value")
    return state.latest(rows, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) rn FROM events) WHERE rn = 1 AND event_type <> 'view'")
def feedback_fold(spark, sf_dir):
    rows = log(spark, sf_dir).select("user_id", "ts", "event_id", "event_type")
    return state.feedback(rows, ["user_id"], ["ts", "event_id"], "event_type", "view").select("user_id", "event_type")


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def nearest_rank_percentile(spark, sf_dir):
    return A.nearest_rank(log(spark, sf_dir), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@query("SELECT quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS max_ms, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END), 6) AS error_rate, count(*) AS n FROM events")
def load_summary(spark, sf_dir):
    return evaluation.load_summary(log(spark, sf_dir).withColumn("ok", F.col("event_type") != "error"), "value", "ok")


@query("WITH r AS (SELECT user_id * 100000 + CAST(floor(epoch(ts) / 86400) AS BIGINT) AS run, CASE event_type WHEN 'signup' THEN 'start' WHEN 'view' THEN 'start' WHEN 'error' THEN 'failed' ELSE 'done' END AS kind, ts FROM events) SELECT run, coalesce(epoch_us(min(ts) FILTER (kind = 'start')), -1) AS started, coalesce(epoch_us(max(ts) FILTER (kind <> 'start')), -1) AS ended, CASE arg_max(kind, (ts, kind)) WHEN 'start' THEN 'running' ELSE arg_max(kind, (ts, kind)) END AS status FROM r GROUP BY 1")
def run_pairs(spark, sf_dir):
    kind = F.when(F.col("event_type").isin("signup", "view"), "start").when(F.col("event_type") == "error", "failed").otherwise("done")
    rows = S.table(spark, sf_dir, "events").select((F.col("user_id") * 100000 + F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 86400)).alias("run"), kind.alias("kind"), "ts")
    out = state.run_pairs(rows, "run", "kind", "ts")
    micros = lambda c: F.coalesce(F.unix_micros(F.col(c).cast("timestamp")), F.lit(-1)).alias(c)
    return out.select("run", micros("started"), micros("ended"), "status")


@query("WITH t AS (SELECT event_id, user_id, sum(value) OVER w AS v, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)) SELECT event_id, CASE WHEN n > 50 THEN 'steps' WHEN v > 5000 THEN 'value' ELSE '' END AS stop FROM t")
def budget_counters(spark, sf_dir):
    rows = log(spark, sf_dir).withColumn("steps", F.lit(1))
    return state.budget_check(rows, "user_id", "event_id", {"steps": 50, "value": 5000}).select("event_id", F.coalesce("stop", F.lit("")).alias("stop"))


@query("WITH f AS (SELECT DISTINCT user_id % 97 AS family FROM events WHERE event_type = 'error' AND value > 150) SELECT event_id, user_id % 97 IN (SELECT family FROM f) AS revoked FROM events")
def token_family(spark, sf_dir):
    rows = log(spark, sf_dir).select("event_id", (F.col("user_id") % 97).alias("family"), F.lit(False).alias("revoked"), "event_type", "value")
    return state.revoke_families(rows, rows.filter("event_type = 'error' and value > 150"), "event_id", "family").select("event_id", "revoked")


@query("WITH m AS (SELECT max(ts) AS now FROM events), k AS (SELECT event_id, ts FROM events, m WHERE epoch(m.now) - epoch(ts) <= CASE event_type WHEN 'error' THEN 86400 * 2 WHEN 'view' THEN 86400 * 5 ELSE 1099511627776 END) SELECT event_id FROM k ORDER BY ts DESC, event_id LIMIT 300")
def state_eviction(spark, sf_dir):
    rows = log(spark, sf_dir)
    now = rows.agg(F.max("ts")).first()[0]
    return state.evict(rows, "event_type", "ts", F.lit(now), {"error": 86400 * 2, "view": 86400 * 5}, 300, ["event_id"]).select("event_id")


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2")
def json_counts(spark, sf_dir):
    rows = log(spark, sf_dir).filter(F.col("event_type").isin("click", "view"))
    return rows.select("event_type", (F.get_json_object("props", "$.k").cast("long") % 10).alias("k")).groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("SELECT user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_counts(spark, sf_dir):
    rows = S.table(spark, sf_dir, "events")
    return rows.groupBy("user_id", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).alias("hour")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n FROM (SELECT *, sum(CASE WHEN b IS NULL OR ts > b + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)) GROUP BY 1, 2")
def gap_sessions(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = log(spark, sf_dir).withColumn("b", F.lag("ts").over(w))
    new = F.when(F.col("b").isNull() | (F.col("ts") > F.col("b") + F.expr("interval 6 hours")), 1).otherwise(0)
    return rows.withColumn("session", F.sum(new).over(w.rowsBetween(W.unboundedPreceding, 0))).groupBy("user_id", "session").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id % 20 AS service, floor(epoch(ts)) AS t, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id % 20 ORDER BY floor(epoch(ts)), event_id) AS n FROM events),
w AS (SELECT service, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, 0 AS failures, CAST(NULL AS DOUBLE) AS since FROM e WHERE n = 1
UNION ALL SELECT e.service, e.n, e.event_id, CASE WHEN w.since IS NOT NULL OR e.ok THEN 0 ELSE w.failures + 1 END,
CASE WHEN w.since IS NOT NULL AND e.t < w.since + 30 THEN w.since WHEN e.ok THEN NULL WHEN w.since IS NOT NULL OR w.failures + 1 >= 5 THEN e.t END FROM w JOIN e ON e.service = w.service AND e.n = w.n + 1)
SELECT event_id, CASE WHEN since IS NULL THEN 'closed' ELSE 'open' END AS state FROM w WHERE n > 0""")
def circuit_states(spark, sf_dir):
    rows = log(spark, sf_dir).select("event_id", "event_type", (F.col("user_id") % 20).alias("service"), F.unix_timestamp("ts").cast("double").alias("t"), (F.col("event_type") != "error").alias("ok"))
    return state.circuit_states(rows, "service", "t", "ok", "event_id").select("event_id", "state")


@query("SELECT event_id, length(props) AS size, sha256(event_type || props) AS digest FROM events")
def cached_results(spark, sf_dir):
    """Results kept by content: half of the events first, then all; the second run computes only the other half."""
    path, rows = new_path(spark, "cache"), log(spark, sf_dir).select("event_id", "event_type", "props")
    make = lambda few: few.select("_key", F.length("props").cast("long").alias("size"), F.sha2(F.concat("event_type", "props"), 256).alias("digest"))
    kept.cached(rows.filter("event_id % 2 = 0"), ["event_type", "props"], make, path, "1")
    return kept.cached(rows, ["event_type", "props"], make, path, "1")[0].select("event_id", "size", "digest")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'error'")
def bucketed_upsert(spark, sf_dir):
    """The last event of each user, merged in three batches into buckets; users whose last event is an error are deleted, a repeated batch does nothing."""
    path, rows = new_path(spark, "upsert"), log(spark, sf_dir).select("user_id", "event_id", "event_type")
    for number, part in enumerate(("event_id % 3 = 0", "event_id % 3 = 1", "event_id % 3 = 2")):
        for _ in range(2):
            kept.upsert(rows.filter(part), path, ["user_id"], ["event_id"], number, buckets=8)
    gone = rows.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), "event_id").alias("x")).select("user_id", "x.*").filter("event_type = 'error'")
    kept.upsert(gone, path, ["user_id"], ["event_id"], 3, deleted=F.col("event_type") == "error", buckets=8)
    return kept.current(spark, path, rows.schema)


@query(ORACLES["ttl_claims"])
def streamed_claims(spark, sf_dir):
    """ttl_claims as a stream: the events in four batches by time, each of as many files as Spark writes, with a restart between them."""
    path, rows = new_path(spark, "claims"), log(spark, sf_dir).select("user_id", "event_type", "event_id", "ts")
    for i in range(4):
        low, high = (f"2024-01-{d:02d}" for d in (1 + 7 * i, 8 + 7 * i))
        part = (F.col("ts") >= F.lit(low) if i else F.lit(True)) & (F.col("ts") < F.lit(high) if i < 3 else F.lit(True))
        rows.filter(part).write.mode("append").parquet(f"{path}/in")
        stateful.run_available(lambda s: stateful.claims(s, ["user_id", "event_type"], "ts", "event_id", 86400), spark, f"{path}/in", rows.schema, path, files=None)
    return spark.read.parquet(f"{path}/rows")

"""Sessions, limits, claims, feedback, runs and versions: batch forms of stateful rules."""

from __future__ import annotations

import tempfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .scan import Breaker, Claims, scanned


def fixed_window_limit(rows: DataFrame, key: str, ts: str, order: list[str], limit: int, seconds: int) -> DataFrame:
    """allowed: at most ``limit`` requests of a key in each window of ``seconds``; refused ones count too."""
    bucket = F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / seconds)
    n = F.row_number().over(W.partitionBy(key, "bucket").orderBy(ts, *order))
    return rows.withColumn("bucket", bucket).withColumn("allowed", n <= limit)


def ttl_gap(rows: DataFrame, key: list[str], ts: str, order: list[str], seconds: int) -> DataFrame:
    """Rows more than ``seconds`` after the row before them (every row restarts the time)."""
    before = F.lag(ts).over(W.partitionBy(*key).orderBy(ts, *order))
    return rows.withColumn("_b", before).filter(F.col("_b").isNull() | (F.col(ts) > F.col("_b") + F.make_interval(secs=F.lit(seconds)))).drop("_b")


def ttl_claims(rows: DataFrame, key: list[str], ts: str, order: str, seconds: int) -> DataFrame:
    """First claims: a refused claim does not extend the time. Keys of any size are spread over tasks (``scan``)."""
    timed = rows.select(*key, F.col(order), F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"))
    return scanned(timed, key, "_t", [order], Claims(seconds * 1_000_000), "_won", T.BooleanType()).filter("_won").select(*key, order)


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of a key, by a pre-aggregated max over structs."""
    rest = [c for c in rows.columns if c not in {*key, *order}]
    return rows.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("_x")).select(*key, "_x.*")


def feedback(events: DataFrame, key: list[str], order: list[str], kind: str, none: str = "none") -> DataFrame:
    """Mutually exclusive feedback: the last event holds, ``none`` withdraws it."""
    return latest(events, key, order).filter(F.col(kind) != none)


def circuit(events: pd.DataFrame, threshold: int = 5, cooldown: float = 30.0) -> list[str]:
    """States of one service's breaker after each (t, ok): closed, open or half-open with one trial."""
    state, failures, since, out = "closed", 0, 0.0, []
    for t, ok in zip(events["t"], events["ok"]):
        if state == "open" and t - since >= cooldown:
            state = "half-open"
        if state == "open":
            out.append(state)
            continue
        if ok:
            state, failures = "closed", 0
        else:
            failures += 1
            if state == "half-open" or failures >= threshold:
                state, since = "open", t
        out.append(state)
    return out


def circuit_states(rows: DataFrame, service: str, t: str, ok: str, order: str, threshold: int = 5, cooldown: float = 30.0) -> DataFrame:
    """rows with the state of their service's breaker after them; services of any size are spread over tasks (``scan``)."""
    return scanned(rows, [service], t, [order], Breaker(threshold, cooldown), "state", T.StringType(), ok)


def memory_fold(turns: DataFrame, session: str, order: str, text: str, recent: int = 6, summary_chars: int = 2200, budget: int = 4200) -> DataFrame:
    """Session memory: the last turns as they are, older ones joined to a bounded summary, within a token budget.

    Aggregates inside the engine: the newest turns and the older texts' last characters.
    """
    w = W.partitionBy(session).orderBy(F.desc(order))
    n = turns.withColumn("_n", F.row_number().over(w))
    items = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct(order, text)))), lambda x: x[text])
    out = n.groupBy(session).agg(items(F.col("_n") <= recent).alias("recent"), F.array_join(items(F.col("_n") > recent), " ").alias("_old"), F.count("*").alias("n_turns"))
    summary = F.when(F.length("_old") > summary_chars, F.expr(f"right(_old, {summary_chars})")).otherwise(F.col("_old"))
    size = F.floor((F.length(F.array_join("recent", " ")) + F.length("summary")) / 4)
    return out.withColumn("summary", summary).drop("_old").withColumn("tokens", size).withColumn("over_budget", size > budget)


def after(rows: DataFrame, mark: DataFrame, session: str, order: str) -> DataFrame:
    """Rows past each session's high-water mark (column ``covered``; none: all)."""
    return rows.join(mark.select(session, "covered"), session, "left").filter(F.col("covered").isNull() | (F.col(order) > F.col("covered"))).drop("covered")


def run_pairs(events: DataFrame, run: str, kind: str, ts: str) -> DataFrame:
    """Start and finish of each run in one pass: status running, done or failed, seconds."""
    out = events.groupBy(run).agg(F.min(F.when(F.col(kind) == "start", F.col(ts))).alias("started"), F.max(F.when(F.col(kind) != "start", F.col(ts))).alias("ended"), F.max_by(kind, F.struct(ts, kind)).alias("_last"))
    return out.withColumn("status", F.when(F.col("_last") == "start", "running").otherwise(F.col("_last"))).drop("_last")


def budget_check(steps: DataFrame, run: str, order: str, limits: dict[str, float]) -> DataFrame:
    """Running totals of each run and the first limit, in the order given, that is passed."""
    w = W.partitionBy(run).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    out = steps.withColumns({f"total_{c}": F.sum(c).over(w) for c in limits})
    stop = None
    for c, most in limits.items():
        over = F.col(f"total_{c}") > most
        stop = F.when(over, c) if stop is None else stop.when(over, c)
    return out.withColumn("stop", stop)


#: Words that make a remark worth remembering at all, hazards, and what regions and work habits are told by.
MARKERS = ("以后", "每次", "偏好", "重点关注", "请记得", "记得以后", "关注一下", "后续都")
HAZARDS = ("暴雨", "冰雹", "大风", "沙尘", "暴雪", "洪涝", "干旱", "雷电")
FOLLOWED, REGIONS = ("关注",), ("区域", "地区", "市", "县", "省")
HABITS = ("分析", "报告", "结论")


def memory_candidate(text: Column, markers=MARKERS, hazards=HAZARDS, followed=FOLLOWED, regions=REGIONS, habits=HABITS) -> Column:
    """(type, confidence) of a remark worth remembering, else null.

    A remark without a marker is none. preference .85: it names a hazard; region .8: it follows a region within
    a clause; habit .6: it is about reports; preference .5: any other.
    """
    low = F.lower(text)
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    region = low.rlike(f"(?:{'|'.join(followed)})[^，。；,.;]*(?:{'|'.join(regions)})")
    kind = lambda k, c: F.struct(F.lit(k).alias("type"), F.lit(c).alias("confidence"))
    return F.when(has(markers), F.when(has(hazards), kind("preference", 0.85)).when(region, kind("region", 0.8)).when(has(habits), kind("habit", 0.6)).otherwise(kind("preference", 0.5)))


def cut_lineage(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder of ``spark.checkpoint.dir``; where it is unset, in a temporary one, on a local master only."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="caseloom-"))
    return df.checkpoint()


def version_roots(rows: DataFrame, key: str, parent: str, group: str) -> DataFrame:
    """key -> root: follow parents to the first row that has a group, else to the oldest ancestor, however far; cycles end.

    Pointer doubling: about log2(depth) joins instead of one for each level, until no root moves. A
    root that still moves after log2(rows) joins is in a cycle.
    """
    p = rows.select(key, parent)
    known = rows.select(F.col(key).alias("_k"), F.col(group).alias("_g"))
    links = p.join(known, F.col(key) == F.col("_k"), "left").select(key, F.when(F.col("_g").isNull(), F.col(parent)).alias("up"))
    links = cut_lineage(links.join(rows.select(F.col(key).alias("_k")), F.col("up") == F.col("_k"), "left").select(key, F.coalesce("_k", key).alias("root")))
    for _ in range(links.count().bit_length()):
        above = links.select(F.col(key).alias("_k"), F.col("root").alias("_r"))
        moved = cut_lineage(links.join(above, F.col("root") == F.col("_k"), "left").select(key, F.coalesce("_r", "root").alias("root"), (~F.col("_r").eqNullSafe(F.col("root")) & F.col("_r").isNotNull()).alias("moves")))
        links = moved.drop("moves")
        if moved.filter("moves").isEmpty():
            break
    return links


def collapse_versions(rows: DataFrame, group: str, version: str, pos: str) -> DataFrame:
    """Each version group once, at its first place, with its latest version and how many there are."""
    rest = [c for c in rows.columns if c not in {group}]
    return rows.groupBy(group).agg(F.min(pos).alias("place"), F.count("*").alias("total"), F.max_by(F.struct(*rest), F.struct(version, pos)).alias("_x")).select(group, "place", "total", *[F.col(f"_x.{c}").alias(c) for c in rest])


def evict(states: DataFrame, status: str, seen: str, now: Column, ttl: dict[str, int], most: int, order: list[str] = ()) -> DataFrame:
    """States past the time of their status go, then the oldest beyond a maximum; ``order`` says which of equal times stay."""
    age = F.unix_timestamp(now) - F.unix_timestamp(F.col(seen))
    limit = None
    for k, s in ttl.items():
        limit = F.when(F.col(status) == k, s) if limit is None else limit.when(F.col(status) == k, s)
    left = states.filter(age <= limit.otherwise(1 << 40))
    return left.orderBy(F.desc(seen), *order).limit(most)


def revoke_families(tokens: DataFrame, bad: DataFrame, token: str, family: str) -> DataFrame:
    """A misused token revokes its whole family."""
    hit = tokens.join(bad.select(token), token, "left_semi").select(family).distinct().withColumn("_r", F.lit(True))
    return tokens.join(hit, family, "left").withColumn("revoked", F.coalesce("_r", F.col("revoked"))).drop("_r")

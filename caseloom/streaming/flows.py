"""Structured Streaming forms of the limiter, claims, breaker, memory and upsert.

Event time is cast to a timestamp with zone first (timestamp_ntz has no watermark). Late rows beyond
the watermark (10 minutes by default) are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "10 minutes"


def file_stream(spark: SparkSession, folder: str, schema, per_trigger: int = 64) -> DataFrame:
    """New Parquet files of a folder; the checkpoint is the high-water mark, so each file is read once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def with_time(rows: DataFrame, ts: str = "ts", late: str = LATE) -> DataFrame:
    return rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def window_counts(rows: DataFrame, key: str, limit: int, window: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Requests of each key and tumbling window, and how many of them a limit refuses."""
    n = with_time(rows, ts).groupBy(F.window(ts, window), key).agg(F.count("*").alias("n"))
    return n.select(key, F.col("window.start").alias("start"), "n", F.greatest(F.col("n") - limit, F.lit(0)).alias("refused"))


def claims(rows: DataFrame, key: list[str], ttl: str, ts: str = "ts") -> DataFrame:
    """First claim of a key within the watermark."""
    return with_time(rows, ts, ttl).dropDuplicatesWithinWatermark(key)


def breaker(rows: DataFrame, service: str, t: str, ok: str, threshold: int = 5, cooldown: float = 30.0) -> DataFrame:
    """(service, t, state) after each event: closed, open, half-open; state is kept by service across batches."""
    kind = rows.schema[service].dataType.simpleString()

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, failures, since = held.get if held.exists else ("closed", 0, 0.0)
        for pdf in batches:
            pdf, out = pdf.sort_values(t), []
            for at, good in zip(pdf[t], pdf[ok]):
                if state == "open" and at - since >= cooldown:
                    state = "half-open"
                if state != "open":
                    if good:
                        state, failures = "closed", 0
                    else:
                        failures += 1
                        if state == "half-open" or failures >= threshold:
                            state, since = "open", float(at)
                out.append(state)
            yield pd.DataFrame({"service": [key[0]] * len(pdf), "t": pdf[t].astype(float), "state": out})
        held.update((state, failures, since))

    return rows.groupBy(service).applyInPandasWithState(step, f"service {kind}, t double, state string", "state string, failures long, since double", "append", GroupStateTimeout.NoTimeout)


def memory(rows: DataFrame, session: str, turn: str, text: str, recent: int = 6, summary_chars: int = 2200) -> DataFrame:
    """Running session memory: the newest turns as they are, older ones in a bounded summary."""
    kind = rows.schema[session].dataType.simpleString()

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        kept, summary, n = (list(held.get[0]), held.get[1], held.get[2]) if held.exists else ([], "", 0)
        for pdf in batches:
            for line in pdf.sort_values(turn)[text].fillna(""):
                kept.append(line)
                n += 1
                if len(kept) > recent:
                    summary = f"{summary} {kept.pop(0)}".strip()[-summary_chars:]
        held.update((kept, summary, n))
        yield pd.DataFrame({"session": [key[0]], "n_turns": [n], "recent": ["\n".join(kept)], "summary": [summary]})

    return rows.groupBy(session).applyInPandasWithState(step, f"session {kind}, n_turns long, recent string, summary string", "kept array<string>, summary string, n long", "update", GroupStateTimeout.NoTimeout)


def latest_to(path: str, key: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the last row of each key; a batch rewrites only the buckets of its keys."""
    from ..sources.kept import sink

    return sink(path, key, order)

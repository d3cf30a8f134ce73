"""Claims and breakers over streams with state that ends: values by key in RocksDB, and timers on event time.

Claims are kept in buckets of keys; one goes with the next rows of its bucket after the watermark passed its end, as any
later row would win anyway, the last ones of a bucket by a timer; a breaker that is closed without failures has no state at all.
So the state holds the keys of the last ``ttl`` and the services in trouble, however long the stream runs. Rows of a batch are taken in the order of their time; rows behind the watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ClaimProcessor(StatefulProcessor):
    """Rows (claim_bucket, claim_key: keys as text, keys, at: microseconds, order) -> those that win; a winner holds its key for ttl microseconds.

    The claims of a bucket of keys are one value: a batch costs a state read and a write for each bucket, not for each key.
    """

    def __init__(self, keys: list[str], order: str, ttl: int):
        self.keys, self.order, self.ttl = keys, order, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", "names array<string>, until array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf = pd.concat(list(rows)).sort_values(["at", self.order])
        names, untils = self.held.get() if self.held.exists() else ((), ())
        held, last, won = dict(zip(names, untils)), max(untils, default=None), []
        for name, at in zip(pdf["claim_key"].tolist(), pdf["at"].tolist()):
            until = held.get(name)
            won.append(until is None or at >= until)
            if won[-1]:
                held[name] = at + self.ttl
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = {n: u for n, u in held.items() if u > passed}  # any later row would win anyway
        end = max(held.values(), default=None)
        if end != last:
            if last is not None:
                self.handle.deleteTimer(-(-last // 1000))
            if end is not None:
                self.handle.registerTimer(-(-end // 1000))
        if held:
            self.held.update((list(held), list(held.values())))
        elif last is not None:
            self.held.clear()
        yield pdf.loc[won, [*self.keys, self.order]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


class BreakerProcessor(StatefulProcessor):
    """Rows (service, at, ok, order) -> (service, order, at, state) after each; and half-open, without an order, when a cooldown passes."""

    def __init__(self, service: str, order: str, threshold: int, cooldown: int):
        self.service, self.order, self.threshold, self.cooldown = service, order, threshold, cooldown

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", "failures long, since long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf = pd.concat(list(rows)).sort_values(["at", self.order])
        failures, since = self.held.get() if self.held.exists() else (0, None)
        opened, out = since, []
        for at, ok in zip(pdf["at"].tolist(), pdf["ok"].tolist()):
            trial = since is not None and at >= since + self.cooldown
            if since is None or trial:
                failures = 0 if ok else failures + 1
                since = None if ok else at if trial or failures >= self.threshold else None
            out.append("closed" if since is None else "open")
        if since != opened:
            if opened is not None:
                self.handle.deleteTimer(-(-(opened + self.cooldown) // 1000))
            if since is not None:
                self.handle.registerTimer(-(-(since + self.cooldown) // 1000))
        if since is None and not failures:
            self.held.clear()
        else:
            self.held.update((failures, since))
        yield pd.DataFrame({self.service: pdf[self.service], self.order: pdf[self.order], "at": pdf["at"], "state": out})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        failures, since = self.held.get()
        yield pd.DataFrame({self.service: [key[0]], self.order: pd.array([None], "Int64"), "at": [since + self.cooldown], "state": ["half-open"]})

    def close(self) -> None:
        pass


def _timed(rows: DataFrame, ts: str, late: str) -> DataFrame:
    rows = rows.withColumn(ts, F.col(ts).cast("timestamp"))
    return rows.withColumn("at", F.unix_micros(ts)).withWatermark(ts, late)


def claims(rows: DataFrame, keys: list[str], ts: str, order: str, seconds: int, late: str = "0 seconds", buckets: int = 1024) -> DataFrame:
    """The rows (keys, order) of a stream that win their key. buckets: of keys that share a value of state, the same as long as the stream lives."""
    timed = _timed(rows, ts, late).withColumn("claim_key", F.to_json(F.struct(*keys))).withColumn("claim_bucket", F.pmod(F.xxhash64("claim_key"), F.lit(buckets)))
    made = timed.groupBy("claim_bucket").transformWithStateInPandas(ClaimProcessor(keys, order, seconds * 1_000_000), T.StructType([rows.schema[c] for c in [*keys, order]]), "append", "EventTime")
    return made


def breakers(rows: DataFrame, service: str, ts: str, ok: str, order: str, threshold: int = 5, cooldown: int = 30, late: str = "0 seconds") -> DataFrame:
    """(service, order, at, state) after each row of a stream, and when a service's cooldown passes."""
    kind = T.StructType([rows.schema[service], rows.schema[order], T.StructField("at", T.LongType()), T.StructField("state", T.StringType())])
    timed = _timed(rows.withColumn("ok", F.col(ok)), ts, late)
    return timed.groupBy(service).transformWithStateInPandas(BreakerProcessor(service, order, threshold, cooldown * 1_000_000), kind, "append", "EventTime")


def run_available(make: Callable[[DataFrame], DataFrame], spark: SparkSession, folder: str, schema: T.StructType, out: str, files: int | None = 1) -> None:
    """All files of a folder that the stream has not read yet, ``files`` a batch (None: all in one); rows to out/rows, checkpoint in out/state: a restart goes on from there."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        stream = spark.readStream.schema(schema)
        query = make((stream.option("maxFilesPerTrigger", files) if files else stream).parquet(folder)).writeStream.format("parquet").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start(f"{out}/rows")
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)

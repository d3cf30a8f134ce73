"""Folds over long sequences, spread over tasks: chunks become functions of the state that enters them.

A rule's outcome for a row depends on all earlier rows of its key, so a key would need one task. Instead its rows are
cut into chunks of ``CHUNK`` by place. Each chunk is summarised on its own as a table from entry state to exit state;
the summaries of a key are walked in order, which gives each chunk's entry state; then all chunks are
replayed at once. A key of any size is spread over tasks; only its summaries, one for each chunk, meet.
A key of one chunk needs none of this: such keys are replayed one after the other behind a single shuffle.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.shared import materialize
from .order import placed

CHUNK = 65_536


@dataclass(frozen=True)
class Claims:
    """A row at time t wins if no earlier winner holds; a winner holds for ``ttl``, a loser does not extend it. State: until when, or None."""

    ttl: float

    start = None

    def summarise(self, t: list, ok: list) -> list:
        """[(t, exit state if the row at t is the first winner) for rows within ttl of the first, and one more]: no entry state reaches farther."""
        n = len(t)
        out = [0.0] * n
        for i in range(n - 1, -1, -1):
            j = bisect_left(t, t[i] + self.ttl, i + 1)
            out[i] = out[j] if j < n else t[i] + self.ttl
        most = min(n, bisect_left(t, t[0] + self.ttl) + 1)
        return [t[:most], out[:most]]

    def advance(self, summary: list, state):
        times, exits = summary
        i = 0 if state is None else bisect_left(times, state)
        return exits[i] if i < len(times) else state

    def replay(self, t: list, ok: list, state) -> list:
        won = []
        for x in t:
            won.append(state is None or x >= state)
            if won[-1]:
                state = x + self.ttl
        return won


@dataclass(frozen=True)
class Breaker:
    """closed until ``threshold`` failures in a row, then open; ``cooldown`` later one trial closes or reopens it. State: failures while closed, or [time of opening]."""

    threshold: int = 5
    cooldown: float = 30.0

    start = 0

    def summarise(self, t: list, ok: list) -> list:
        """[exit state for each number of failures on entry; times of the rows that can be the first trial; exit states if they are]."""
        n, m = len(t), self.threshold
        trial = [None] * n
        closed = list(range(m))  # behind the last row: the number of failures itself

        def opened(i: int):
            j = bisect_left(t, t[i] + self.cooldown, i + 1)
            return trial[j] if j < n else [t[i]]

        for i in range(n - 1, -1, -1):
            trial[i] = closed[0] if ok[i] else opened(i)
            closed = [closed[0]] * m if ok[i] else [*closed[1:], trial[i]]
        most = min(n, bisect_left(t, t[0] + self.cooldown) + 1)
        return [closed, t[:most], trial[:most]]

    def advance(self, summary: list, state):
        closed, times, trials = summary
        if isinstance(state, int):
            return closed[state]
        i = bisect_left(times, state[0] + self.cooldown)
        return trials[i] if i < len(times) else state

    def replay(self, t: list, ok: list, state) -> list:
        out = []
        for x, good in zip(t, ok):
            trial = not isinstance(state, int) and x >= state[0] + self.cooldown
            if isinstance(state, int) or trial:
                state = 0 if good else [x] if trial or state + 1 >= self.threshold else state + 1
            out.append("closed" if isinstance(state, int) else "open")
        return out


def scanned(rows: DataFrame, keys: list[str], time: str, order: list[str], rule, out: str, kind: T.DataType, ok: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """rows with what the rule says of each, in the order of (time, order) of its key. time: numbers; ok: a boolean column that the rule reads.

    Null keys are one key; rows without a time come last; rows equal in time and order are taken in no stated order.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = {n: F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")) for n, k in zip(names, keys)}  # a key that joins where it is null
    whole = T.StructType([*rows.schema.fields, T.StructField(out, kind)])
    times = [F.col(time).asc_nulls_last(), *order]
    held = rows.withColumns(keyed).withColumn("_ok", F.col(ok) if ok else F.lit(True))
    large = materialize(held.groupBy(*names).agg(F.count("*").alias("_n")).filter(F.col("_n") > chunk).select(*names), "scan-large")
    if large.isEmpty():
        return _whole_keys(held, names, time, times, rule, whole)
    apart = F.broadcast(large)  # a row for each ``chunk`` rows at most
    cut = _cut_keys(held.join(apart, names, "left_semi").select(*rows.columns), keys, keyed, time, times, rule, whole, ok, chunk)
    return _whole_keys(held.join(apart, names, "left_anti"), names, time, times, rule, whole).unionAll(cut)


def _whole_keys(held: DataFrame, names: list[str], time: str, times: list, rule, schema: T.StructType) -> DataFrame:
    """Keys of one chunk: rows pass in order, and a key's rows are held until they are all there."""
    fields, kind = schema.names[:-1], to_arrow_type(schema[-1].dataType)

    def replayed(t: pa.Table, starts: list[int]) -> list[pa.RecordBatch]:
        at = [float("nan") if x is None else x for x in t[time].to_pylist()]
        ok, said = t["_ok"].to_pylist(), []
        for a, z in zip(starts, [*starts[1:], t.num_rows]):
            said += rule.replay(at[a:z], ok[a:z], rule.start)
        return t.select(fields).append_column(schema.names[-1], pa.array(said, kind)).combine_chunks().to_batches()

    def run(batches):
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t])
            new = np.zeros(max(t.num_rows - 1, 0), bool)
            for n in names:
                column = t[n].combine_chunks()
                new |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            starts = [0, *(np.flatnonzero(new) + 1).tolist()]
            rest = t.slice(starts[-1])
            if starts[-1]:
                yield from replayed(t.slice(0, starts[-1]), starts[:-1])
        if rest is not None and rest.num_rows:
            yield from replayed(rest, [0])

    return held.repartition(*names).sortWithinPartitions(*names, *times).mapInArrow(run, schema)


def _cut_keys(rows: DataFrame, keys: list[str], keyed: dict, time: str, times: list, rule, schema: T.StructType, ok: str | None, chunk: int) -> DataFrame:
    """Keys of several chunks: summarised, walked, replayed."""
    names, fields, out = list(keyed), rows.columns, schema.names[-1]
    held = placed(rows, times, keys, name="_place").withColumn("_chunk", F.floor(F.col("_place") / chunk).cast("long"))
    held = materialize(held.withColumn("_ok", F.col(ok) if ok else F.lit(True)), "scan-rows").withColumns(keyed)

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        said = json.dumps(rule.summarise(pdf[time].tolist(), pdf["_ok"].tolist()))
        return pd.DataFrame([[*pdf[names].iloc[0], pdf["_chunk"].iloc[0], said]], columns=[*names, "_chunk", "_said"])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        state, entries = rule.start, []
        for said in pdf["_said"]:
            entries.append(json.dumps(state))
            state = rule.advance(json.loads(said), state)
        return pdf[[*names, "_chunk"]].assign(_entry=entries)

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[fields].assign(**{out: rule.replay(pdf[time].tolist(), pdf["_ok"].tolist(), json.loads(pdf["_entry"].iloc[0]))})

    key = [T.StructField(n, T.StringType()) for n in names]
    whole = T.StructField("_chunk", T.LongType())
    said = _by_group(held.select(*names, "_chunk", "_place", time, "_ok"), [*names, "_chunk"], "_place", summarise, T.StructType([*key, whole, T.StructField("_said", T.StringType())]))
    entries = materialize(_by_group(said, names, "_chunk", walk, T.StructType([*key, whole, T.StructField("_entry", T.StringType())])), "scan-entries")
    both = held.join(entries, [*names, "_chunk"])
    return _by_group(both, [*names, "_chunk"], "_place", replay, schema)


def _by_group(rows: DataFrame, keys: list[str], order: str, each, schema: T.StructType) -> DataFrame:
    """each(a group's rows in order), as applyInPandas, but many small groups share an Arrow batch: a group costs no batch of its own."""

    def run(batches):
        held: list[pd.DataFrame] = []
        last = None
        for pdf in batches:
            if not len(pdf):
                continue
            new = (pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy()
            new[0] = last is None or tuple(pdf[keys].iloc[0]) != last
            cuts = [i for i in range(len(pdf)) if new[i]]
            if held and (not cuts or cuts[0] > 0):
                held.append(pdf.iloc[: cuts[0] if cuts else len(pdf)])
            made = []
            if cuts:
                if held:
                    made.append(each(pd.concat(held)))
                ends = [*cuts[1:], len(pdf)]
                made += [each(pdf.iloc[a:z]) for a, z in zip(cuts[:-1], ends[:-1])]
                held = [pdf.iloc[cuts[-1] :]]
            last = tuple(pdf[keys].iloc[-1])
            if made:
                yield pd.concat(made)
        if held:
            yield each(pd.concat(held))

    return rows.repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(run, schema)

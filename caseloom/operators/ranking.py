"""Selections over ranked rows: caps, strata, interleaving, neighbours, budgets and folds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .order import placed


def number(rows: DataFrame, partition: list[str], order: list[Column], out: str) -> DataFrame:
    return rows.withColumn(out, F.row_number().over((W.partitionBy(*partition) if partition else W.partitionBy(F.lit(0))).orderBy(*order)).cast("long"))


def capped(rows: DataFrame, source: str, pos: str, cap: int, limit: int) -> DataFrame:
    """At most ``cap`` of a source, then the others to fill up, all in rank order."""
    n = number(rows, [source], [F.asc(pos)], "_n")
    return n.orderBy(F.col("_n") > cap, pos).limit(limit).drop("_n")


def stratified(rows: DataFrame, stratum: str, pos: str, limit: int) -> DataFrame:
    """The best of each stratum first, then by rank."""
    return capped(rows, stratum, pos, 1, limit)


def round_robin(rows: DataFrame, group: str, order: list[Column], limit: int) -> DataFrame:
    """First rows of all groups, then second ones, ...; groups in their own order."""
    return number(rows, [group], order, "turn").orderBy("turn", group).limit(limit)


def top_mean(rows: DataFrame, group: str, score: str, order: str, k: int = 2) -> DataFrame:
    top = number(rows, [group], [F.desc(score), F.asc(order)], "_n").filter(F.col("_n") <= k)
    return top.groupBy(group).agg(F.round(F.avg(score), 6).alias("score"), F.count("*").alias("n"))


def keep_latest(rows: DataFrame, group: str, order: list[Column], keep: int) -> DataFrame:
    """Adds status: active for the newest ``keep`` of a group, expired for the others."""
    n = number(rows, [group], order, "age")
    return n.withColumn("status", F.when(F.col("age") <= keep, "active").otherwise("expired"))


def neighbours(rows: DataFrame, doc: str, pos: str, score: Column, limit: int) -> DataFrame:
    """Best rows first, each with the rows next to it, until a document has ``limit``; without a hit its first rows. In document order."""
    w = W.partitionBy(doc)
    hit = F.when(score > 0, score)
    out = rows.withColumn("_hit", hit).withColumn("_r", F.when(F.col("_hit").isNotNull(), F.row_number().over(w.orderBy(F.desc_nulls_last("_hit"), pos))))
    out = out.withColumn("_cover", F.least("_r", F.lag("_r").over(w.orderBy(pos)), F.lead("_r").over(w.orderBy(pos))))
    # taken: covered before the limit was reached, that is fewer than ``limit`` rows are covered by better hits
    before = F.count("_cover").over(w.orderBy("_cover").rangeBetween(W.unboundedPreceding, -1))
    taken = F.when(F.max("_r").over(w).isNull(), True).otherwise(F.col("_cover").isNotNull() & (before < limit))
    out = out.withColumn("_taken", taken).filter("_taken").drop("_hit", "_r", "_cover", "_taken")
    return number(out, [doc], [F.asc(pos)], "_n").filter(F.col("_n") <= limit).drop("_n")


def between_headings(rows: DataFrame, doc: str, pos: str, heading: Column, anchor: Column) -> DataFrame:
    """From the last heading before the last anchor to the row after the anchor."""
    w = W.partitionBy(doc)
    out = rows.withColumn("_a", F.max(F.when(anchor, F.col(pos))).over(w))
    out = out.withColumn("_h", F.max(F.when(heading & (F.col(pos) < F.col("_a")), F.col(pos))).over(w))
    return out.filter((F.col(pos) >= F.coalesce("_h", F.col("_a"))) & (F.col(pos) <= F.col("_a") + 1)).drop("_a", "_h")


def segments(rows: DataFrame, doc: str, start: str, end: str) -> DataFrame:
    """Each heading's segment ends where the next one starts."""
    return rows.withColumn(end, F.coalesce(F.lead(start).over(W.partitionBy(doc).orderBy(start)), F.col(end)))


def offsets(rows: DataFrame, doc: str, pos: str, text: str, gap: int = 1) -> DataFrame:
    """Running character spans of the pieces of a document."""
    w = W.partitionBy(doc).orderBy(pos).rowsBetween(W.unboundedPreceding, -1)
    out = rows.withColumn("start", F.coalesce(F.sum(F.length(text) + gap).over(w), F.lit(0)).cast("long"))
    return out.withColumn("end", F.col("start") + F.length(text))


def sequence_id(stem: str, kind: str, n: str, width: int = 3) -> Column:
    """Numbers of at least ``width`` digits."""
    return F.concat(F.col(stem), F.lit(f"-{kind}-"), F.lpad(F.col(n).cast("string"), F.greatest(F.lit(width), F.length(F.col(n).cast("string"))), F.lit("0")))


def rank_score(rows: DataFrame, order: list[Column], out: str = "rank_score") -> DataFrame:
    """1 for the first, 0 for the last of a ranking; places by prefix sums over ranges, so no task holds the table."""
    n = placed(rows, order, name="_n", total="_all")
    return n.withColumn(out, F.when(F.col("_all") > 1, 1 - F.col("_n") / (F.col("_all") - 1)).otherwise(1.0)).drop("_n", "_all")


def min_max(rows: DataFrame, score: str, out: str) -> DataFrame:
    """Scores stretched to [0, 1]; 1 when all are equal. Two aggregates, joined back as one row."""
    ends = rows.agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    x = (F.col(score) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    return rows.crossJoin(F.broadcast(ends)).withColumn(out, F.when(F.col("_hi") > F.col("_lo"), x).otherwise(1.0)).drop("_lo", "_hi")


def tie_break(rows: DataFrame, query: str, pos: str, score: str, compat: str, outside: str, gap: float = 0.08, compat_gap: float = 0.12) -> DataFrame:
    """Near ties by the distance to their group's head; inside a group an outside order decides.

    A group ends where the score falls more than ``gap`` below its head's, or compatibility differs by
    more than ``compat_gap``: relative to the head, so a fold over each query's candidates (a bounded
    shortlist), not a window.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("tie_group", T.LongType()), T.StructField("final_rank", T.LongType())])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos)
        groups, head = [], None
        for s, c in zip(pdf[score], pdf[compat]):
            if head is None or head[0] - s > gap or abs(head[1] - c) > compat_gap:
                head, n = (s, c), (groups[-1] + 1 if groups else 0)
            groups.append(n)
        pdf = pdf.assign(tie_group=groups).sort_values(["tie_group", outside, pos], na_position="last")
        return pdf.assign(final_rank=range(1, len(pdf) + 1))

    return rows.groupBy(query).applyInPandas(fold, schema)


def within_budget(rows: DataFrame, group: str, rank: str, text: str, order: str, limit: int, chars: int) -> DataFrame:
    """Ranked rows that fit a character budget; the first always does, those that do not fit are skipped.

    A fold inside the engine: the group's (rank, length, order) triples, no texts, are walked once.
    """
    items = F.array_sort(F.collect_list(F.struct(rank, F.length(text).alias("_len"), order)))
    zero = F.struct(F.lit(0).alias("used"), F.expr("cast(array() as array<bigint>)").alias("taken"))
    fits = lambda a, x: (F.size(a["taken"]) < limit) & (a["used"] < chars) & ((F.size(a["taken"]) == 0) | (a["used"] + x["_len"] <= chars))
    step = lambda a, x: F.when(fits(a, x), F.struct((a["used"] + x["_len"]).alias("used"), F.concat(a["taken"], F.array(x[rank].cast("long"))).alias("taken"))).otherwise(a)
    picked = rows.groupBy(group).agg(F.aggregate(items, zero, step, lambda a: a["taken"]).alias("_t"))
    return rows.join(picked.select(group, F.explode("_t").alias(rank)), [group, rank])


def context_pack(rows: DataFrame, group: str, pos: str, text: str, sections: dict[str, list[str]], focus: list[str], limit: int = 12) -> DataFrame:
    """Packs each group: first and last row, two best for each section and for the focus terms, then the rows
    after chosen ones, then by score, up to ``limit``. Windows of a group: its rows meet no Python, and texts only where they are asked for."""
    low, w = F.lower(F.coalesce(F.col(text), F.lit(""))), W.partitionBy(group)
    hits = lambda terms: sum((((F.length(low) - F.length(F.replace(low, F.lit(t), F.lit("")))) / len(t)).cast("long") for t in map(str.lower, terms)), F.lit(0))
    wanted = [*sections.values(), focus]
    names = [f"_k{i}" for i in range(len(wanted))]
    out = rows.withColumns({k: hits(v) for k, v in zip(names, wanted)})
    out = out.withColumns({"_i": F.row_number().over(w.orderBy(pos)), "_n": F.count(F.lit(1)).over(w)})
    # the order in which rows are chosen: first, last, then the two best of each section
    turn = [F.when(F.col("_i") == 1, 0), F.when(F.col("_i") == F.col("_n"), 1)]
    for j, k in enumerate(names):
        out = out.withColumn(f"_r{j}", F.row_number().over(w.orderBy(F.desc(k), "_i")))
        turn.append(F.when((F.col(f"_r{j}") <= 2) & (F.col(k) > 0), 1 + 2 * j + F.col(f"_r{j}")))
    out = out.withColumn("_turn", F.least(*turn)).withColumn("_seed", F.col("_turn").isNotNull() & (F.row_number().over(w.orderBy(F.asc_nulls_last("_turn"), "_i")) <= limit))
    by_place = w.orderBy("_i")
    out = out.withColumns({"_m": F.sum(F.col("_seed").cast("int")).over(w), "_next": ~F.col("_seed") & F.coalesce(F.lag("_seed").over(by_place), F.lit(False))})
    out = out.withColumn("_next", F.col("_next") & (F.sum(F.col("_next").cast("int")).over(by_place) <= limit - F.col("_m")))
    out = out.withColumns({"_two": F.col("_seed") | F.col("_next"), "_left": limit - F.sum((F.col("_seed") | F.col("_next")).cast("int")).over(w)})
    total = sum((F.col(k) for k in names), F.lit(0))
    place = F.row_number().over(w.orderBy(F.col("_two"), total.desc(), "_i"))  # chosen rows stand behind all others
    out = out.withColumn("_taken", F.col("_two") | (place <= F.col("_left")) | (F.col("_n") <= limit))
    return out.filter("_taken").select(*rows.columns)


def role_coverage(rows: DataFrame, group: str, rank: str, role: str, text: str, roles: list[str], chars: int) -> DataFrame:
    """Within-budget picks of each group; then a missing role replaces a repeated one if the budget allows it."""
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(rank).reset_index(drop=True)
        size = pdf[text].fillna("").str.len()
        taken, used = [], 0
        for i, n in size.items():
            if not taken or used + n <= chars:
                taken.append(i)
                used += n
        for want in roles:
            if want in set(pdf.loc[taken, role]):
                continue
            extra = [i for i in pdf.index if i not in taken and pdf.at[i, role] == want]
            twice = [i for i in reversed(taken) if (pdf.loc[taken, role] == pdf.at[i, role]).sum() > 1]
            swap = next(((i, j) for i in extra for j in twice if used - size[j] + size[i] <= chars), None)
            if swap:
                used += size[swap[0]] - size[swap[1]]
                taken = [i for i in taken if i != swap[1]] + [swap[0]]
        return pdf.loc[sorted(taken)]

    return rows.groupBy(group).applyInPandas(fold, rows.schema)


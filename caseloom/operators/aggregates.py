"""Counting, extremes with provenance, coverage and comparison profiles. Ties follow first occurrence (``pos``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalars import months


def ranked(rows: DataFrame, by: list[Column], out: str = "rank", partition: list[str] = ()) -> DataFrame:
    """Row numbers in a total order; without a partition the order is over all rows (use on aggregates)."""
    w = W.partitionBy(*partition) if partition else W.partitionBy(F.lit(0))
    return rows.withColumn(out, F.row_number().over(w.orderBy(*by)).cast("long"))


def label_counts(cases: DataFrame, array: str, once: bool = True, out: str = "label") -> DataFrame:
    """How many cases (or mentions) have each value of an array column."""
    return cases.select(F.explode(F.array_distinct(array) if once else F.col(array)).alias(out)).groupBy(out).agg(F.count("*").alias("n"))


def most_common(counts: DataFrame, k: int, label: str = "label", n: str = "n", first: str | None = None) -> DataFrame:
    return counts.orderBy(F.desc(n), F.asc(first or label)).limit(k)


def month_of(*sources: tuple[str, Column]) -> Column:
    """The first source that tells months: ("months", array), ("date", date) or ("text", text with months or ISO dates; days behind 月 are none)."""
    tries = []
    for kind, c in sources:
        if kind == "months":
            tries.append(F.when(F.size(c) > 0, c))
        elif kind == "date":
            tries.append(F.when(c.isNotNull(), F.array(F.month(c))))
        else:
            iso = F.transform(F.regexp_extract_all(c, F.lit(r"\d{4}-(\d{1,2})-\d{1,2}"), F.lit(1)), lambda x: x.cast("int"))
            found = F.array_sort(F.array_distinct(F.concat(F.filter(iso, lambda m: m.between(1, 12)), months(c))))
            tries.append(F.when(F.size(found) > 0, found))
    return F.coalesce(*tries, F.array().cast("array<int>"))


def cooccurrence(pairs: DataFrame, counts: DataFrame, top: int) -> DataFrame:
    """Square matrix of the top labels: diagonal their count, else the pair count; fewer than two labels: empty."""
    best = counts.orderBy(F.desc("n"), "label").limit(top)
    grid = best.select(F.col("label").alias("a"), F.col("n").alias("_na")).crossJoin(best.select(F.col("label").alias("b")))  # top x top
    n = pairs.groupBy("a", "b").agg(F.count("*").alias("_n"))
    both = n.unionByName(n.select(F.col("b").alias("a"), F.col("a").alias("b"), "_n"))
    out = grid.join(both, ["a", "b"], "left")
    size = F.count("*").over(W.partitionBy(F.lit(0)))
    return out.withColumn("_size", size).filter("_size > 1").select("a", "b", F.when(F.col("a") == F.col("b"), F.col("_na")).otherwise(F.coalesce("_n", F.lit(0))).cast("double").alias("value"))


def strongest_pair(matrix: DataFrame) -> DataFrame:
    return matrix.filter("a < b").orderBy(F.desc("value"), "a", "b").limit(1)


def extreme(rows: DataFrame, by: list[str], value: str, order: list[str], lowest: Column | bool = False) -> DataFrame:
    """One row for each group, the extreme value with all it came with; ties: first in ``order``.

    A pre-aggregated min over structs: no sort, and one row for each group and task in the shuffle.
    """
    low = lowest if isinstance(lowest, Column) else F.lit(lowest)
    key = F.when(low, F.col(value)).otherwise(-F.col(value))
    rest = [c for c in rows.columns if c not in {*by, *order}]
    packed = F.struct(key.alias("_k"), *order, *rest)
    one = rows.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.min(packed).alias("_x"))
    return one.select(*by, *[F.col(f"_x.{c}").alias(c) for c in [*order, *rest]])


def column_coverage(long: DataFrame, metric: str, case: str, n_cases: int, preferred: list[str], keep: int = 3) -> DataFrame:
    """Metrics of the best non-empty tier (all cases, at least 70 %, any), by coverage then preference."""
    cover = long.groupBy(metric).agg(F.count_distinct(case).alias("coverage"))
    tier = F.when(F.col("coverage") >= n_cases, 0).when(F.col("coverage") >= F.ceil(F.lit(0.7 * n_cases)), 1).otherwise(2)
    place = F.coalesce(F.array_position(F.array(*map(F.lit, preferred)), F.col(metric)), F.lit(0))
    place = F.when(place == 0, 1 << 20).otherwise(place)
    w = W.partitionBy(F.lit(0))
    best = cover.withColumn("_tier", tier).withColumn("_best", F.min("_tier").over(w)).filter("_tier = _best")
    return ranked(best.withColumn("_place", place), [F.desc("coverage"), F.asc("_place"), F.asc(metric)]).filter(F.col("rank") <= keep).select(metric, "coverage", "rank")


def peaks(counts: DataFrame, label: str, n: str = "n") -> DataFrame:
    """All labels at the maximum, and their share of the total in percent."""
    w = W.partitionBy(F.lit(0))
    out = counts.withColumn("_max", F.max(n).over(w)).withColumn("share", F.round(100.0 * F.col(n) / F.sum(n).over(w), 4))
    return out.filter(F.col(n) == F.col("_max")).drop("_max")


def season(months: Column) -> Column:
    """The first that holds all months: warm (4-9), winter (11-2), spring (3-5), autumn (9-11), else cross-season."""
    all_in = lambda *ms: F.forall(months, lambda m: m.isin(*ms))
    return F.when(all_in(4, 5, 6, 7, 8, 9), "warm").when(all_in(11, 12, 1, 2), "winter").when(all_in(3, 4, 5), "spring").when(all_in(9, 10, 11), "autumn").otherwise("cross-season")


def companions(cases: DataFrame, array: str, focus: list[str], keep: int = 3) -> DataFrame:
    """Cases that have every focus label, and what else they have most."""
    full = cases.filter(F.forall(F.array(*map(F.lit, focus)), lambda f: F.array_contains(array, f)))
    rest = full.select("case_id", F.explode(F.array_except(array, F.array(*map(F.lit, focus)))).alias("label"))
    return most_common(rest.groupBy("label").agg(F.count("*").alias("n")), keep)


def group_profile(rows: DataFrame, group: str, label: str, keep: int = 5) -> DataFrame:
    """Top labels of each group, as an ordered array."""
    n = rows.groupBy(group, label).agg(F.count("*").alias("n"))
    top = ranked(n, [F.desc("n"), F.asc(label)], partition=[group]).filter(F.col("rank") <= keep)
    return top.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", label))), lambda x: x[label]).alias("top"))


def common_to_all(profiles: DataFrame, array: str = "top") -> DataFrame:
    """The labels in every group's array."""
    lists = profiles.agg(F.collect_list(array).alias("_all"))  # a few short arrays
    fold = F.aggregate(F.slice("_all", 2, F.greatest(F.size("_all") - 1, F.lit(0))), F.get("_all", F.lit(0)), lambda a, b: F.array_intersect(a, b))
    return lists.select(F.explode(F.coalesce(fold, F.array().cast("array<string>"))).alias("label"))


def keep_first(rows: DataFrame, key: list[Column], order: list[Column]) -> DataFrame:
    named = rows.withColumns({f"_k{i}": k for i, k in enumerate(key)})
    w = W.partitionBy(*[f"_k{i}" for i in range(len(key))]).orderBy(*order)
    return named.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(*rows.columns)


def upgrade(rows: DataFrame, key: list[str], priority: Column, pos: str) -> DataFrame:
    """Among equal facts the one of highest priority, at the place of the first."""
    w = W.partitionBy(*key)
    out = rows.withColumn("_p", priority).withColumn("_pos", F.min(pos).over(w))
    out = out.withColumn("_n", F.row_number().over(w.orderBy(F.desc("_p"), pos))).filter("_n = 1")
    return out.withColumn(pos, F.col("_pos")).drop("_p", "_pos", "_n")


def status(known: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """confirmed or not present, over the union of known and found names."""
    f = found.select(name).distinct().withColumn("_f", F.lit(1))
    return known.select(name).distinct().join(f, name, "full_outer").select(name, F.when(F.col("_f").isNotNull(), "confirmed").otherwise("not present").alias("status"))


def histogram(rows: DataFrame, labels: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Cumulative buckets with sum and count by label tuple."""
    buckets = [F.sum(F.when(F.col(value) <= b, 1).otherwise(0)).alias(f"le_{str(b).replace('.', '_')}") for b in bounds]
    return rows.groupBy(*labels).agg(*buckets, F.round(F.sum(value), 4).alias("total"), F.count("*").alias("n"))


def status_class(code: Column) -> Column:
    return F.concat(F.floor(code / 100).cast("string"), F.lit("xx"))


def plot_kind(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Median, and box plot or histogram by whether there are four values."""
    return rows.groupBy(group).agg(F.round(F.median(value), 6).alias("median"), F.when(F.count(value) >= 4, "box").otherwise("histogram").alias("kind"))


def nearest_rank(rows: DataFrame, group: list[str], value: str, ratios: dict[str, float]) -> DataFrame:
    """Percentiles that are values of the data: index ceil(p n) - 1."""
    return rows.groupBy(*group).agg(*[F.expr(f"percentile_disc({p}) within group (order by {value})").alias(k) for k, p in ratios.items()])


def rollup(rows: DataFrame, means: list[str], sums: list[str]) -> DataFrame:
    """Macro means and sums, zero on empty input."""
    return rows.agg(*[F.coalesce(F.round(F.avg(c), 6), F.lit(0.0)).alias(c) for c in means], *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums])


def vocabulary_frequency(texts: DataFrame, text: str, terms: list[str]) -> DataFrame:
    """Mentions of each term, by count, then first place, then the list's order."""
    rows = texts.select(F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.lit(i).alias("ord"), F.regexp_count(F.col(text), F.lit(t)).cast("long").alias("n")) for i, t in enumerate(terms)])).alias("x"))
    return rows.groupBy("x.term", "x.ord").agg(F.sum("x.n").alias("n")).filter("n > 0").select("term", "ord", "n")


def coverage(cases: DataFrame, arrays: list[str]) -> DataFrame:
    return cases.agg(*[F.round(F.avg((F.size(a) > 0).cast("double")), 6).alias(a) for a in arrays])

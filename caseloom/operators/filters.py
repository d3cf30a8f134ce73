"""Predicates of case searches, as Columns and small plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlaps(start: Column, end: Column, lo, hi) -> Column:
    """Closed intervals that share a point; None is an open bound."""
    ok = F.lit(True)
    if hi is not None:
        ok = ok & (start <= F.lit(hi))
    return ok & (end >= F.lit(lo)) if lo is not None else ok


def month_overlap(year: Column, months: Column, lo, hi) -> Column:
    """For rows without dates: any whole month of (year, months) meets the interval."""
    first = lambda m: F.make_date(year, m.cast("int"), F.lit(1))
    return F.exists(months, lambda m: overlaps(first(m), F.last_day(first(m)), lo, hi))


def term_matches(text: Column, labels: Column, term: str, atoms: dict[str, list[str]] | None = None) -> Column:
    """The term is in the text or in a label; a compound term matches when all its atoms do."""
    hit = lambda t: F.contains(text, F.lit(t)) | F.exists(labels, lambda x: F.contains(x, F.lit(t)))
    whole = hit(term)
    parts = (atoms or {}).get(term)
    return whole | reduce(lambda a, b: a & b, map(hit, parts)) if parts else whole


def region_matches(regions: Column, terms: list[str], provinces: tuple[str, ...] = (), text: Column | None = None) -> Column:
    """A term is in the text, or it and a region contain one another; a province term matches every row that has any region."""
    near = F.exists(regions, lambda x: reduce(lambda a, b: a | b, [F.contains(x, F.lit(t)) | F.contains(F.lit(t), x) for t in terms]))
    if text is not None:
        near = near | reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in terms])
    return near | (F.size(regions) > 0) if any(t in provinces for t in terms) else near


def search(cases: DataFrame, dimensions: dict[str, Column | None]) -> DataFrame:
    """AND over the active dimensions; adds those that matched and the share of active ones that did."""
    active = {k: v for k, v in dimensions.items() if v is not None}
    names = F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in active.items()])) if active else F.array().cast("array<string>")
    keep = reduce(lambda a, b: a & b, active.values(), F.lit(True))
    return cases.filter(keep).withColumn("matched", names).withColumn("score", F.round(F.size("matched") / F.lit(max(1, len(active))), 4))


def metadata_matches(filters: dict[str, object], field=lambda k: F.element_at(F.col("metadata"), k)) -> Column:
    """Filter language over a string map: scalar, list, and {$in, $ne, $eq}; a missing key equals None."""
    ok = F.lit(True)
    for key, want in filters.items():
        x = field(key)
        if isinstance(want, dict):
            if "$in" in want:
                ok = ok & F.coalesce(x.isin(list(want["$in"])), F.lit(False))
            if "$ne" in want:
                ok = ok & ~x.eqNullSafe(F.lit(want["$ne"]))
            if "$eq" in want:
                ok = ok & x.eqNullSafe(F.lit(want["$eq"]))
        elif isinstance(want, (list, tuple, set)):
            ok = ok & F.coalesce(x.isin(list(want)), F.lit(False))
        else:
            ok = ok & x.eqNullSafe(F.lit(want))
    return ok


def contains_any(values: Column, wanted: list) -> Column:
    return F.arrays_overlap(values, F.array(*map(F.lit, wanted)))


def of_tenant(rows: DataFrame, user_id, column: str = "user_id") -> DataFrame:
    return rows.filter(F.col(column) == F.lit(user_id))


def live(revoked: Column, expires: Column, now: Column) -> Column:
    return revoked.isNull() & (expires.isNull() | (expires > now))


def active_memory(status: Column, deleted: Column, expires: Column | None = None, now: Column | None = None) -> Column:
    """Not deleted; with ``expires`` also not expired (stricter than status alone)."""
    ok = (status == "active") & deleted.isNull()
    return ok if expires is None else ok & (expires.isNull() | (expires > now))


def scoped(cases: DataFrame, ids: DataFrame, key: str, fall_back: bool = True) -> DataFrame:
    """Rows whose key is in ids; if none is, all rows (or none, without fall_back)."""
    hit = cases.join(ids.select(key).distinct(), key, "left_semi")
    if not fall_back:
        return hit
    none = hit.limit(1).agg((F.count("*") == 0).alias("_none"))
    return hit.unionByName(cases.crossJoin(F.broadcast(none)).filter("_none").drop("_none"))  # one row


def prior_warnings(sentences: DataFrame, term: str, key: str, text: str, issued: str, start: str, keep: int = 5) -> DataFrame:
    """Sentences with the term, issued strictly before the case starts; repeats dropped, newest kept."""
    from pyspark.sql.window import Window as W

    bare = F.regexp_replace(F.col(text), r"(?U)\s+", "")
    rows = sentences.filter(F.contains(F.col(text), F.lit(term)) & (F.col(issued) < F.col(start))).withColumn("_bare", bare)
    rows = rows.withColumn("_n", F.row_number().over(W.partitionBy(key, "_bare").orderBy(F.desc(issued), text))).filter("_n = 1")
    rows = rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(issued), text))).filter(F.col("_n") <= keep)
    return rows.drop("_n", "_bare")


def validate_conditions(raw: dict) -> dict:
    """Whitelisted query conditions: years 1900-2100, months 1-12, at most 20 strings of 200 characters, min or max."""
    out: dict = {}
    out["years"] = [y for y in raw.get("years") or [] if isinstance(y, int) and 1900 <= y <= 2100]
    out["months"] = [m for m in raw.get("months") or [] if isinstance(m, int) and 1 <= m <= 12]
    for k in ("disaster_types", "cities", "areas"):
        out[k] = [s for s in raw.get(k) or [] if isinstance(s, str) and 0 < len(s) <= 200][:20]
    if raw.get("operator") in ("min", "max"):
        out["operator"] = raw["operator"]
    return {k: v for k, v in out.items() if v}

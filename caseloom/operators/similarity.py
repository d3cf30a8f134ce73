"""Case similarity: dimension scores, weighted recall, fusion, penalties, gates and selection."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import jaccard, ring_distance, ring_score, weighted_mean
from .ranking import capped

#: Weights of the first matcher.
MATCHER_WEIGHTS = {"disaster": 0.28, "temporal": 0.18, "spatial": 0.20, "image": 0.16, "text": 0.14, "source": 0.04}
#: Area, disaster and temporal weights of the profiles.
PROFILES = {
    "snow": (0.22, 0.56, 0.22), "precipitation": (0.27, 0.53, 0.20), "wind": (0.25, 0.55, 0.20), "convection": (0.25, 0.55, 0.20),
    "cold": (0.25, 0.55, 0.20), "heat": (0.25, 0.55, 0.20), "fog": (0.27, 0.53, 0.20), "dust": (0.27, 0.53, 0.20), "generic": (0.30, 0.50, 0.20),
}


def profile(names: list[str]) -> dict[str, float]:
    """Largest weights over the profiles, made to sum to one."""
    rows = [PROFILES.get(n, PROFILES["generic"]) for n in names] or [PROFILES["generic"]]
    best = [max(r[i] for r in rows) for i in range(3)]
    return dict(zip(("area", "disaster", "temporal"), (x / sum(best) for x in best)))


def match_share(labels: Column, wanted: list[str]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, wanted)), lambda t: F.array_contains(labels, t))) / len(wanted)


def temporal_linear(months: Column, days: Column, q_month: int, q_days: list[int]) -> Column:
    """1 same month and day, .82 month only, .72 other days, .35 next month (December and January are not next)."""
    same, near = F.array_contains(months, q_month), F.exists(months, lambda m: F.abs(m - q_month) == 1)
    asked = F.array(*map(F.lit, q_days)).cast("array<int>")
    return F.when(same & (F.size(asked) == 0) | same & (F.size(days) == 0), 0.82).when(same & F.arrays_overlap(days, asked), 1.0).when(same, 0.72).when(near, 0.35).otherwise(0.0)


def matched(cases: DataFrame, scores: dict[str, Column], limit: int = 5, gate: Column | None = None) -> DataFrame:
    """First matcher: fixed weights, zero scores dropped, 1 to 5 cases."""
    total = sum((F.coalesce(scores[k], F.lit(0.0)) * w for k, w in MATCHER_WEIGHTS.items() if k in scores), F.lit(0.0))
    rows = cases.withColumn("score", F.round(total, 4)).filter("score > 0")
    return (rows.filter(gate) if gate is not None else rows).orderBy(F.desc("score"), "pos").limit(max(1, min(5, limit)))


def area_score(areas: Column, wanted: Column, province_wide: Column) -> Column:
    """.65 coverage + .35 Jaccard; a province-wide case at most .68, any other with a hit .08 more."""
    cover = F.when(F.size(wanted) > 0, F.size(F.array_intersect(areas, wanted)) / F.size(wanted)).otherwise(0.0)
    base = 0.65 * cover + 0.35 * jaccard(areas, wanted)
    return F.when(province_wide, F.least(base, F.lit(0.68))).when(base > 0, F.least(base + 0.08, F.lit(1.0))).otherwise(0.0)


def disaster_score(title: Column, labels: Column, wanted: dict[str, float], families: dict[str, list[str]]) -> Column:
    """By importance: 1 in the title, .85 its family in the title, .48 a label, else the family share times .35.

    A title that names other things only caps the result at .35.
    """
    parts, hits = [], F.lit(False)
    for term, weight in wanted.items():
        kin = families.get(term, [])
        in_title = F.contains(title, F.lit(term))
        kin_title = F.exists(F.array(*map(F.lit, kin)), lambda k: F.contains(title, k)) if kin else F.lit(False)
        share = match_share(labels, kin) * 0.35 if kin else F.lit(0.0)
        parts.append(weight * F.when(in_title, 1.0).when(kin_title, 0.85).when(F.array_contains(labels, term), 0.48).otherwise(share))
        hits = hits | in_title | kin_title
    mean = sum(parts, F.lit(0.0)) / sum(wanted.values())
    others = [t for t in families if t not in wanted and all(t not in families.get(w, []) for w in wanted)]
    conflict = ~hits & (F.exists(F.array(*map(F.lit, others)), lambda k: F.contains(title, k)) if others else F.lit(False))
    return F.when(conflict, F.least(mean, F.lit(0.35))).otherwise(mean)


def importance(text: str, terms: list[str], weak: list[str], strong: list[str], process: str = "") -> dict[str, tuple[float, str]]:
    """(weight, primary or secondary) of the terms of one query text; a mention near weak and strong words takes both factors."""
    first = re.split(r"[。！？；]", text, maxsplit=1)[0]
    scores = {}
    for t in terms:
        near = [text[max(0, m.start() - 8) : m.end() + 8] for m in re.finditer(re.escape(t), text)]
        factors = sum((0.55 if any(w in x for w in weak) else 1.0) * (1.25 if any(w in x for w in strong) else 1.0) for x in near)
        scores[t] = (1.0 if near else 0.75) + 0.45 * min(3.0, factors) + 0.55 * (t in first) + 0.75 * (t in process)
    most = max(scores.values(), default=0.0)
    return {t: (round(s, 4), "primary" if s >= 0.72 * most else "secondary") for t, s in scores.items()}


def temporal_ring(months: Column, wanted: list[int], days: Column | None = None, q_days: int | None = None) -> Column:
    """Nearest months on the ring; where both durations are known .85 of it and .15 of how alike they are."""
    best = F.array_min(F.flatten(F.transform(months, lambda m: F.transform(F.array(*map(F.lit, wanted)), lambda q: ring_distance(m, q)))))
    score = F.when(best.isNull(), 0.0).otherwise(ring_score(best))
    if days is None or q_days is None:
        return score
    alike = 1 - F.abs(days - q_days) / F.greatest(days, F.lit(q_days))
    return F.when(days.isNotNull(), 0.85 * score + 0.15 * alike).otherwise(score)


def recall(cases: DataFrame, scores: dict[str, Column], weights: dict[str, float], title_gate: Column, n: int, areas: Column | None = None) -> DataFrame:
    """Weighted mean of the requested dimensions, damped: .35 for a weak disaster, .5 for none of the areas (of a case that names some), .35 for a failed title gate.

    Keeps min(40, max(15, 30 % of n)) cases.
    """
    s = F.coalesce(weighted_mean(scores, weights), F.lit(0.0))
    if "disaster" in scores:
        s = s * F.when(scores["disaster"] < 0.45, 0.35).otherwise(1.0)
    if "area" in scores:
        s = s * F.when((scores["area"] == 0) & (F.size(areas) > 0 if areas is not None else F.lit(True)), 0.5).otherwise(1.0)
    s = s * F.when(title_gate, 1.0).otherwise(0.35)
    budget = min(40, max(15, -(-3 * n // 10)))
    return cases.withColumn("structured", F.round(s, 6)).orderBy(F.desc("structured"), F.desc("case_id")).limit(budget)


def fused(structured: Column, semantic: Column) -> Column:
    return F.round(F.when(semantic.isNotNull(), 0.65 * structured + 0.35 * semantic).otherwise(structured), 6)


def effective(compatibility: Column, coverage: Column) -> Column:
    return compatibility * (0.45 + 0.55 * coverage)


def penalised(score: Column, eff: Column, any_assessed: Column | None = None) -> Column:
    """Scaled by effective compatibility; cases without one get the floor if others have one."""
    missing = F.when(any_assessed, score * 0.55).otherwise(score) if any_assessed is not None else score
    return F.round(F.when(eff.isNotNull(), score * (0.55 + 0.45 * eff)).otherwise(missing), 6)


def gated(rows: DataFrame, structured: str, pos: str, least: float = 0.30, floor: float = 0.15) -> DataFrame:
    """Rows of enough structured score; if there are none, the first if it reaches the floor."""
    from pyspark.sql.window import Window as W

    w = W.partitionBy(F.lit(0))  # a shortlist
    n = rows.withColumn("_any", F.max((F.col(structured) >= least).cast("int")).over(w)).withColumn("_first", F.min(pos).over(w))
    keep = F.when(F.col("_any") == 1, F.col(structured) >= least).otherwise((F.col(pos) == F.col("_first")) & (F.col(structured) >= floor))
    return n.filter(keep).drop("_any", "_first")


def select(rows: DataFrame, structured: str, source: str, pos: str, n: int) -> DataFrame:
    """Gate, then at most two of a source with back-fill."""
    return capped(gated(rows, structured, pos), source, pos, 2, n)

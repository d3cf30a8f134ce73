"""Column functions: months, dates, vocabularies, text, units, similarity. All run inside the engine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lower bounds in m/s of wind forces 0 to 17.
WIND_FORCE = [0.0, 0.3, 1.6, 3.4, 5.5, 8.0, 10.8, 13.9, 17.2, 20.8, 24.5, 28.5, 32.7, 37.0, 41.5, 46.2, 51.0, 56.1]
#: Numerals of months.
NUMERALS = {"一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10, "十一": 11, "十二": 12}
#: Unit spellings.
UNITS = {"毫米": "mm", "厘米": "cm", "米": "m", "千米": "km", "公里": "km", "米/秒": "m/s", "摄氏度": "℃", "°C": "℃", "度": "℃"}


def numeral(c: Column) -> Column:
    """Digits or a month numeral as a number; null for anything else."""
    table = F.create_map(*[F.lit(x) for kv in NUMERALS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, c), c.try_cast("int"))


def months(text: Column) -> Column:
    """Months named in a text: ranges like 3-5月 and 11月至2月 (over the year's end), single ones, numerals.

    A number that stands behind 月 is a day, and so is one that no 月 follows: 7月28-8月3日 names July and August.
    """
    n = r"(?<![\d月/-])(1[0-2]|0?[1-9]|十[一二]?|[一二三四五六七八九])(?!\d)"
    pair = rf"{n}\s*月?\s*(?:-|—|~|～|至|到)\s*(?<![月])(1[0-2]|0?[1-9]|十[一二]?|[一二三四五六七八九])\s*月"
    lo, hi = (F.regexp_extract_all(text, F.lit(pair), F.lit(i)) for i in (1, 2))
    span = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.concat(F.sequence(a, F.lit(12)), F.sequence(F.lit(1), b)))
    ranges = F.flatten(F.transform(F.arrays_zip(lo.alias("a"), hi.alias("b")), lambda x: span(numeral(x["a"]), numeral(x["b"]))))
    single = F.transform(F.regexp_extract_all(text, F.lit(r"(?<!\d)(1[0-2]|0?[1-9]|十[一二]?|[一二三四五六七八九])\s*月"), F.lit(1)), numeral)
    return F.array_sort(F.array_distinct(F.filter(F.concat(ranges, single), lambda m: m.between(1, 12))))


def month_span(a: Column, b: Column) -> Column:
    return F.when(a <= b, F.sequence(a, b)).otherwise(F.concat(F.sequence(a, F.lit(12)), F.sequence(F.lit(1), b)))


def year(text: Column) -> Column:
    return F.regexp_extract(text, r"(20\d{2})", 1).try_cast("int")


def calendar_date(text: Column, default_year: int = 2000) -> Column:
    """ISO or year-month-day text; a missing year is the default; what is no date is null."""
    iso = F.try_to_date(F.regexp_extract(text, r"(\d{4}-\d{1,2}-\d{1,2})", 1), "yyyy-M-d")
    y, m, d = (F.regexp_extract(text, r"(?:(\d{4})年)?(\d{1,2})月(\d{1,2})日", i) for i in (1, 2, 3))
    built = F.try_to_date(F.concat_ws("-", F.when(y == "", F.lit(str(default_year))).otherwise(y), m, d), "yyyy-M-d")
    return F.coalesce(iso, F.when(m != "", built))


def duration_days(start: Column, end: Column) -> Column:
    """Inclusive days; an end before its start lies in the next year."""
    return F.datediff(F.when(end < start, F.add_months(end, 12)).otherwise(end), start) + 1


def month_days(start: Column, end: Column) -> Column:
    return F.transform(F.sequence(start, end), lambda d: F.struct(F.month(d).alias("month"), F.day(d).alias("day")))


def spotted(text: Column, terms: list[str]) -> Column:
    """Terms of an ordered vocabulary that the text contains."""
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t))


def spotted_longest(text: Column, terms: list[str]) -> Column:
    """Non-overlapping terms, longest first everywhere: a found term is blanked before shorter ones are sought."""
    zero = F.struct(text.alias("left"), F.expr("cast(array() as array<string>)").alias("found"))
    ordered = F.array(*map(F.lit, sorted(terms, key=lambda t: (-len(t), t))))
    step = lambda a, t: F.when(F.contains(a["left"], t), F.struct(F.replace(a["left"], t, F.lit("\x00")).alias("left"), F.concat(a["found"], F.array(t)).alias("found"))).otherwise(a)
    return F.aggregate(ordered, zero, step, lambda a: a["found"])


def expanded(labels: Column, parts: dict[str, list[str]]) -> Column:
    """Each label, and the parts of compound ones."""
    table = F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.array_distinct(F.flatten(F.transform(labels, lambda x: F.concat(F.array(x), F.coalesce(F.try_element_at(table, x), F.expr("cast(array() as array<string>)"))))))


def clean(text: Column) -> Column:
    """One line: blanks collapsed, none between CJK characters or between a digit and a date unit."""
    t = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    t = F.regexp_replace(t, r"(?<=\p{IsHan}) (?=\p{IsHan})", "")
    t = F.regexp_replace(t, r"(?<=\d) (?=[年月日号])", "")
    return F.regexp_replace(t, r"(?<=[年月日号]) (?=\d)", "")


def compact(text: Column, limit: int = 160) -> Column:
    flat = F.regexp_replace(text, r"(?U)\s+", "")
    cut = F.regexp_replace(F.substring(flat, 1, limit), r"[，、；：,;:。]+$", "")
    return F.when(F.length(flat) > limit, F.concat(cut, F.lit("。"))).otherwise(flat)


def lexical_terms(text: Column) -> Column:
    """Tokens between punctuation, then all pairs of neighbouring Han characters; each once, in order."""
    tokens = F.filter(F.split(F.lower(text), r"[\p{Punct}\p{IsPunctuation}\s]+"), lambda t: t != "")
    runs = F.regexp_extract_all(text, F.lit(r"(\p{IsHan}{2,})"), F.lit(1))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.array_distinct(F.concat(tokens, pairs))


def ngrams(text: Column, n: int, step: int = 1) -> Column:
    last = F.length(text) - n + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), last, F.lit(step)), lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array(text))


def token_estimate(text: Column, at_least: int = 1) -> Column:
    """Han characters, and a quarter of the others."""
    others = F.length(F.regexp_replace(text, r"\p{IsHan}", ""))
    quarter = F.floor(others / 4)
    return F.length(text) - others + (F.greatest(F.lit(at_least), quarter) if at_least else F.when(others == 0, 0).otherwise(F.greatest(F.lit(1), quarter)))


def sentences(text: Column, ends: str = "。；;") -> Column:
    return F.filter(F.split(text, f"(?<=[{ends}])"), lambda s: F.trim(s) != "")


def unit(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.trim(c)), F.trim(c))


def in_unit(value: Column, have: Column, want: str) -> Column:
    """Lengths in the wanted unit (m, km, cm, mm); others unchanged."""
    metres = {"m": 1.0, "km": 1000.0, "cm": 0.01, "mm": 0.001}
    return reduce(lambda acc, u: acc.when(have == u, value * metres[u] / metres[want]), metres, F.when(F.lit(False), value)).otherwise(value)


def wind_force(speed: Column) -> Column:
    out = F.lit(None).cast("int")
    for force, least in enumerate(WIND_FORCE):
        out = F.when(speed >= least, force).otherwise(out)
    return out


def redacted(text: Column) -> Column:
    """Keys, tokens and passwords masked."""
    t = F.regexp_replace(text, r"(?i)((?:api[_-]?key|token|secret|password)\s*[=:]\s*)\S+", "$1***")
    return F.regexp_replace(t, r"(?i)(bearer\s+)[A-Za-z0-9._-]+", "$1***")


def one_of(c: Column, allowed: list[str], other: str = "other") -> Column:
    return F.when(c.isin(allowed), c).otherwise(other)


def title_focus(title: Column, terms: list[str]) -> Column:
    """The term that comes first in the title; at one place, the longest."""
    found = F.transform(spotted(title, terms), lambda t: F.struct(F.position(t, title).alias("at"), (-F.length(t)).alias("neg"), t.alias("term")))
    return F.array_min(found)["term"]


def primary(labels: Column, title: Column, wanted: list[str]) -> Column:
    """A requested label, else one the title names, else the first."""
    asked = F.get(F.filter(labels, lambda x: x.isin(wanted)), F.lit(0)) if wanted else F.lit(None).cast("string")
    return F.coalesce(asked, F.get(F.filter(labels, lambda x: F.contains(title, x)), F.lit(0)), F.get(labels, F.lit(0)))


def classified(text: Column, table: list[tuple[str, list[str]]], other: str) -> Column:
    """The first class one of whose keywords the text contains."""
    out = None
    for name, words in table:
        hit = reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(other)


def merged(old: Column, patch: Column) -> Column:
    """Maps, the patch's values first."""
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(patch), k)), patch)


def dot(a: Column, b: Column) -> Column:
    product = lambda x, y: x.cast("double") * y.cast("double")
    return F.aggregate(F.zip_with(a, b, product), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 on empty vectors, unequal lengths or a zero norm."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def cosine_score(a: Column, b: Column) -> Column:
    """Cosine mapped to [0, 1]; the longer vector is cut to the shorter."""
    n = F.least(F.size(a), F.size(b))
    c = cosine(F.slice(a, 1, n), F.slice(b, 1, n))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (c + 1) / 2))


def weighted_mean(scores: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weights of absent (null) dimensions are given to the others; null if all are absent."""
    total = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), F.lit(weights[k])).otherwise(0.0) for k, c in scores.items()])
    value = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) * weights[k] for k, c in scores.items()])
    return F.when(total > 0, value / total)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def ring_distance(a: Column, b: Column) -> Column:
    """Months apart on the year's circle."""
    return F.least(F.abs(a - b), 12 - F.abs(a - b))


def ring_score(distance: Column) -> Column:
    return F.when(distance == 0, 1.0).when(distance == 1, 0.72).when(distance == 2, 0.5).when(distance == 3, 0.3).otherwise(0.12)

"""Requests of a dialogue: exact dates, operation, merge with what was confirmed, relation to the library, review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.dates import as_date, days, first_range
from ..functions.scalars import NUMERALS

#: Words that say what a turn does to the confirmed request, the first that occurs here holds.
OPERATIONS = [
    ("new", "重新|另查|新查|新检索|换一个查询"),
    ("restrict", "再限定|再加上|增加条件|继续限定|补充条件"),
    ("scope", "只看|仅看|只检索|仅检索|范围缩小到|筛到"),
    ("replace", "改成|改为|换成|调整为|替换成|改到"),
]
#: A self-contained question, and words that point back to the last one.
WHOLE_QUESTION, POINTS_BACK = "(?:查询|检索|查找|统计|分析).*(?:过程|个例|天气|报告)", "其中|这些|上述|刚才|上一轮|前面|原条件|范围内|结果里|继续|另外|也要|还要"


def exact_range(text: Column) -> Column:
    """struct(start, end): the first range of days, else the first marked day alone; the year must be said. No such date: null.

    The end of a range takes a year and month that it lacks from the start. A range with a day that is none is null.
    """
    found = F.filter(days(text), lambda x: x["y"].between(2000, 2099))
    pair, one = first_range(found), F.get(F.filter(found, lambda x: x["marked"]), F.lit(0))
    both = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("start"), b.alias("end")))
    return F.when(pair.isNotNull(), both(as_date(pair["a"]), as_date(pair["b"]))).otherwise(both(as_date(one), as_date(one)))


def operation(text: Column, first: Column, touched: Column) -> Column:
    """new, restrict, scope or replace; ``first``: nothing is confirmed yet; ``touched``: the dimensions of the turn."""
    said = None
    for name, words in OPERATIONS:
        said = F.when(text.rlike(words), name) if said is None else said.when(text.rlike(words), name)
    only = lambda d: (F.size(touched) == 1) & F.array_contains(touched, d)
    back = F.when(only("disaster"), "scope").when(only("time"), "replace").otherwise("restrict")
    rest = F.when(first | (text.rlike(WHOLE_QUESTION) & (F.size(touched) >= 2)), "new").when(text.rlike(POINTS_BACK), back).otherwise("new")
    return F.coalesce(said, rest)


def _years_of(start: Column, end: Column) -> Column:
    found = lambda c: F.regexp_extract(F.coalesce(c, F.lit("")), r"^(20\d{2})-", 1).try_cast("int")
    return F.array_distinct(F.array_compact(F.array(found(start), found(end))))


def dialogue(turns: DataFrame, session: str, turn: str) -> DataFrame:
    """The request that holds after each turn: touched dimensions are replaced, others inherited.

    turns has ``session, turn, operation, touched, cleared`` (arrays of time, disaster, region), ``start, end`` (ISO
    text or empty), ``years, months`` (arrays of int), ``disasters, cities, areas`` (arrays of string). The first
    turn and every ``new`` one start over. A date range removes years and months; months alone keep the years, also
    those of a range. Null arrays count as empty; turns of one number are in no defined order.
    The fold is a running last value of each dimension: one shuffle by session, no array of its turns.
    """
    since = W.partitionBy(session).orderBy(turn).rowsBetween(W.unboundedPreceding, 0)
    fresh = F.coalesce(F.col("operation") == "new", F.lit(False)) | (F.row_number().over(W.partitionBy(session).orderBy(turn)) == 1)
    rows = turns.withColumn("_new", fresh).withColumn("_part", F.sum(F.col("_new").cast("int")).over(since))
    w = W.partitionBy(session, "_part").orderBy(turn).rowsBetween(W.unboundedPreceding, 0)
    has = lambda c, d: F.coalesce(F.array_contains(c, d), F.lit(False))
    touches = lambda d: F.col("_new") | has(F.col("touched"), d)
    clears = lambda d: ~F.col("_new") & has(F.col("cleared"), d)
    held = lambda c: F.last(c, ignorenulls=True).over(w)
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    given = lambda c, kind: F.coalesce(F.col(c), empty(kind))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    dated = (text("start") != "") | (text("end") != "")
    years, months = given("years", "int"), given("months", "int")

    year_set = F.when(touches("time"), F.when(clears("time"), empty("int")).when(F.size(years) > 0, years).when(F.col("_new") | dated, _years_of(text("start"), text("end"))))
    year_set = F.when(touches("time") & ~F.col("_new") & ~clears("time") & dated, _years_of(text("start"), text("end"))).otherwise(year_set)
    hidden = F.when(touches("time"), ~clears("time") & dated & (~F.col("_new") | (F.size(years) == 0)))
    month_set = F.when(touches("time"), F.when(clears("time"), empty("int")).when(F.col("_new"), months).when(dated, empty("int")).when(F.size(months) > 0, months))
    bound = lambda c: held(F.when(touches("time"), F.when(clears("time"), "").otherwise(text(c))))
    labels = lambda c, d: held(F.when(touches(d), F.when(clears(d), empty("string")).otherwise(given(c, "string"))))
    return rows.select(
        session, turn, bound("start").alias("start"), bound("end").alias("end"),
        F.when(held(hidden), empty("int")).otherwise(held(year_set)).alias("years"), held(month_set).alias("months"),
        labels("disasters", "disaster").alias("disasters"), labels("cities", "region").alias("cities"), labels("areas", "region").alias("areas"),
    )


def asked_interval(start: Column, end: Column, years: Column, months: Column) -> Column:
    """struct(lo, hi): the dates (one stands for both), else the years and months as whole months; without either null."""
    ys = F.array_sort(F.filter(years, lambda y: y.between(1900, 2100)))
    ms = F.array_sort(F.filter(months, lambda m: m.between(1, 12)))
    edge = lambda a, i, other: F.coalesce(F.try_element_at(a, F.lit(i)), F.lit(other))
    first = F.make_date(F.try_element_at(ys, F.lit(1)), edge(ms, 1, 1), F.lit(1))
    last = F.last_day(F.make_date(F.try_element_at(ys, F.lit(-1)), edge(ms, -1, 12), F.lit(1)))
    dates = F.struct(F.coalesce(start, end).alias("lo"), F.coalesce(end, start).alias("hi"))
    return F.when(start.isNotNull() | end.isNotNull(), dates).when(F.size(ys) > 0, F.struct(first.alias("lo"), last.alias("hi")))


def relation(asked: Column, library_start: Column, library_end: Column) -> Column:
    """before, inside (also partly), after; unknown where an interval is missing."""
    known = asked.isNotNull() & library_start.isNotNull() & library_end.isNotNull()
    return F.when(~known, "unknown").when(asked["lo"] > library_end, "after").when(asked["hi"] < library_start, "before").otherwise("inside")


def review(evidence: DataFrame, question: str, asked: str, months: str) -> DataFrame:
    """retry for a question one of whose rows has months and none of the asked ones; otherwise ok."""
    outside = (F.size(asked) > 0) & (F.size(months) > 0) & ~F.arrays_overlap(asked, months)
    return evidence.groupBy(question).agg(F.when(F.max(F.coalesce(outside, F.lit(False))), "retry").otherwise("ok").alias("status"))


def date_conflict(said: Column, start: Column, end: Column, rule_start: Column, rule_end: Column, source: Column) -> Column:
    """Does a model's date expression not stand in the text, or do its ends differ from the rule's? Missing is empty."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    said, start, end, rule_start, rule_end = map(blank, (said, start, end, rule_start, rule_end))
    invented = (said != "") & ~F.contains(blank(source), said)
    differs = (rule_start == "") | (rule_end == "") | (start != rule_start) | (end != rule_end)
    return invented | (((start != "") | (end != "")) & differs)


def query_tokens(text: Column, terms: list[str], areas: dict[str, list[str]], images: list[str]) -> Column:
    """Known terms, areas named by themselves or an alias, image words, then the parts of two characters or more; each once."""
    from ..functions.scalars import spotted

    by_alias = F.array_compact(F.array(*[F.when(F.exists(F.array(*map(F.lit, [a, *more])), lambda x: F.contains(text, x)), F.lit(a)) for a, more in areas.items()]))
    parts = F.filter(F.split(text, r"[\s，。！？、；：,.!?;:（）()]+"), lambda p: F.length(p) >= 2)
    return F.array_distinct(F.concat(spotted(text, terms), by_alias, spotted(text, images), parts))


#: Words of an answer about the whole library, and of its statistics.
WHOLE_LIBRARY, STATISTICS = ("全库", "标准化个例库", "共筛选到", "按月份", "按灾种", "统计"), ("按月份", "按灾种")


def context_score(n_ids: Column, source: Column, content: Column, wanted: Column, question: Column) -> Column:
    """How well a list of ids from an earlier message fits a question that asks back for ``wanted`` cases (0 or null: no number).

    By source 18, 14, 8, 4; the exact number 100, each one too many -8 (at most -60), too few -25; a content that
    says the number 22; statistics of the whole library -45; a month of the question in the content 12.
    """
    base = F.when(source == "stored_context", 18).when(source == "visuals", 14).when(source == "evidence_cases", 8).when(source == "text", 4).otherwise(0)
    asks = F.coalesce(wanted, F.lit(0)) > 0
    count = F.when(n_ids == wanted, 100).when(n_ids > wanted, -F.least(F.lit(60), (n_ids - wanted) * 8)).otherwise(-25)
    numeral = F.try_element_at(F.create_map(*[F.lit(x) for k, v in NUMERALS.items() for x in (v, k)]), wanted.cast("int"))
    says = F.regexp_like(content, F.concat(F.lit("(?:"), wanted.cast("string"), F.coalesce(F.concat(F.lit("|"), numeral), F.lit("")), F.lit(r")\s*(?:次|个|条)")))
    listed = F.regexp_extract(content, r"共筛选到\s*(\d+)\s*个", 1).try_cast("long")
    says_any = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(content, w))
    whole = says_any(WHOLE_LIBRARY) & (F.coalesce(listed != wanted, F.lit(False)) | says_any(STATISTICS))
    extra = F.when(asks, count + F.when(says, 22).otherwise(0) - F.when(whole, 45).otherwise(0)).otherwise(0)
    named = F.transform(F.regexp_extract_all(question, F.lit(r"(\d{1,2})\s*月"), F.lit(1)), lambda m: F.concat(m.cast("int").cast("string"), F.lit("月")))
    return F.when(n_ids == 0, -1000).otherwise(base + extra + F.when(F.exists(named, lambda m: F.contains(content, m)), 12).otherwise(0))


def context_cases(candidates: DataFrame, session: str) -> DataFrame:
    """The best list of ids of each session; of equal scores the most recent.

    candidates has ``session, ids, score, wanted, recency`` (0: newest). With a wanted number only lists of just that length
    count; a session without one gives no row.
    """
    fits = candidates.filter((F.size("ids") > 0) & ((F.coalesce("wanted", F.lit(0)) == 0) | (F.size("ids") == F.col("wanted"))))
    return fits.groupBy(session).agg(F.max_by("ids", F.struct("score", -F.col("recency"))).alias("ids"))

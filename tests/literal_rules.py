"""Rules about words, dates and cases on rows worked out by hand."""

import datetime

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from caseloom.functions import scalars as X
from caseloom.operators import aggregates, build, evaluation, extraction, filters, joins, ranking, retrieval, similarity
from caseloom.operators import evidence as V
from caseloom.operators import requests as Q  # noqa: F401
from caseloom.sources import tables as S

FOUND: dict = {}


def query(sql):
    def add(f):
        FOUND[f.__name__] = (f, sql)
        return f

    return add


def _sql(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(_sql, x)) + "]"
    if isinstance(x, datetime.date):
        return f"DATE '{x}'"
    if isinstance(x, float):
        return f"CAST({x!r} AS DOUBLE)"
    return f"CAST({x} AS BIGINT)" if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def values(data: list[tuple], *columns: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in data) + f") t({', '.join(columns)})"


def expect(data: list[tuple], *columns: str) -> str:
    return "SELECT * FROM " + values(data, *columns)


def texts(spark, data: list[str]):
    return spark.createDataFrame([(i, t) for i, t in enumerate(data)], "id long, text string")


joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


DATES = ["2025-7-3 起", "2024年2月29日", "2023年2月29日", "5月16日夜间", "没有日期"]


WEATHER = ["雷暴大风和短时强降水", "大风降温，局地暴雨", "晴", "强对流：雷暴、冰雹"]


VOCABULARY = ["暴雨", "大风", "雷暴大风", "雷暴", "冰雹", "降水"]


CLEANED = ["2025 年 7 月 3 日", "太 原  大风", "a  b 号 5", "7 号\n到 8 号"]


TITLED = [(0, "雷暴大风转暴雨过程", ["暴雨", "大风"]), (1, "寒潮过程", ["大风", "寒潮"]), (2, "例行总结", ["冰雹"])]


EXPOSITION = ["# HELP x", 'http_total{route="a",code="200"} 3', 'http_total{route="b",code="200"} 4.5', 'http_total{route="a",code="500"} 1', "up 1", "", "broken{ nan?"]


CASES = [(0, "太原雷暴，阵风明显", ["大风"], ["太原"]), (1, "雷暴大风", ["雷暴大风"], ["大同市"]), (2, "晴热", ["高温"], []), (3, "运城暴雨", ["暴雨"], ["全省"])]


PROFILES = [(0, [7], [16], ["暴雨", "大风"], "暴雨过程"), (1, [7], [20], ["暴雨"], "高温天气"), (2, [8], [], ["高温"], "高温过程"), (3, [1], [], [], "寒潮")]


ANSWERS = [(0, ["苹果|香蕉", "桃子"], ["坏"], "只有桃子"), (1, ["a|"], [""], "b"), (2, [], [], ""), (3, ["", "x|y"], ["y", "z"], "y")]


@query(expect([(0, 2025, datetime.date(2025, 7, 3)), (1, 2024, datetime.date(2024, 2, 29)), (2, 2023, None), (3, None, datetime.date(2020, 5, 16)), (4, None, None)], "id", "year", "day"))
def calendar_dates(spark, sf_dir):
    return texts(spark, DATES).select("id", X.year(F.col("text")).cast("long").alias("year"), X.calendar_date(F.col("text"), 2020).alias("day"))


@query(expect([(0, "大风,雷暴大风,雷暴,降水", "雷暴大风,降水"), (1, "暴雨,大风", "大风,暴雨"), (2, "", ""), (3, "雷暴,冰雹", "冰雹,雷暴")], "id", "all_terms", "longest"))
def spotted_terms(spark, sf_dir):
    return texts(spark, WEATHER).select("id", joined(X.spotted(F.col("text"), VOCABULARY)).alias("all_terms"), joined(X.spotted_longest(F.col("text"), VOCABULARY)).alias("longest"))


@query(expect([(0, "2025年7月3日"), (1, "太原大风"), (2, "a b 号5"), (3, "7号到 8号")], "id", "text"))
def cleaned_text(spark, sf_dir):
    return texts(spark, CLEANED).select("id", X.clean(F.col("text")).alias("text"))


@query(expect([(0, 2, "大风。|降温；"), (1, 1, "雨"), (2, 0, "")], "id", "n", "parts"))
def sentence_split(spark, sf_dir):
    s = X.sentences(F.col("text"))
    return texts(spark, ["大风。降温；", "雨", " "]).select("id", F.size(s).cast("long").alias("n"), F.array_join(s, "|").alias("parts"))


@query(expect([(0, "mm", 0.003), (1, "m", 5.0), (2, "km", 2000.0), (3, "℃", 7.0), (4, "hPa", 8.0)], "id", "unit", "metres"))
def units_converted(spark, sf_dir):
    rows = spark.createDataFrame([(0, "毫米", 3.0), (1, " 米 ", 5.0), (2, "公里", 2.0), (3, "摄氏度", 7.0), (4, "hPa", 8.0)], "id long, u string, v double")
    return rows.select("id", X.unit(F.col("u")).alias("unit"), X.in_unit(F.col("v"), X.unit(F.col("u")), "m").alias("metres"))


@query(expect([(0, "雷暴大风", "暴雨"), (1, None, "寒潮"), (2, None, "冰雹")], "id", "focus", "main"))
def title_terms(spark, sf_dir):
    rows = spark.createDataFrame(TITLED, "id long, title string, labels array<string>")
    return rows.select("id", X.title_focus(F.col("title"), VOCABULARY).alias("focus"), X.primary(F.col("labels"), F.col("title"), []).alias("main"))


@query(expect([("http_total", 4.0, 8.5), ("up", None, 1.0)], "name", "of_a", "total"))
def exposition_totals(spark, sf_dir):
    lines = spark.createDataFrame([(x,) for x in EXPOSITION[:-1]], "value string")
    return S.metric_totals(lines).join(S.metric_totals(lines, route="a").withColumnRenamed("total", "of_a"), "name", "left").select("name", "of_a", "total")


@query(expect([(0, True, True, False), (1, True, True, False), (2, False, False, False), (3, False, True, True)], "id", "storm", "province", "yuncheng"))
def term_and_region(spark, sf_dir):
    rows = spark.createDataFrame(CASES, "id long, text string, labels array<string>, regions array<string>")
    storm = filters.term_matches(F.col("text"), F.col("labels"), "雷暴大风", {"雷暴大风": ["雷暴", "大风"]})
    region = lambda t: filters.region_matches(F.col("regions"), [t], ("山西", "全省"), F.col("text"))
    return rows.select("id", storm.alias("storm"), region("山西").alias("province"), region("运城").alias("yuncheng"))


@query(expect([("a", "发布 暴雨预警 二", 2), ("a", "发布暴雨预警一", 1)], "case_id", "text", "issued"))
def prior_warning_rows(spark, sf_dir):
    data = [("a", "发布暴雨预警一", 1, 5), ("a", "发布 暴雨预警 二", 2, 5), ("a", "发布暴雨预警二", 2, 5), ("a", "暴雨预警同日", 5, 5), ("a", "无关", 1, 5), ("b", "暴雨预警", 9, 3)]
    rows = spark.createDataFrame(data, "case_id string, text string, issued long, start long")
    return filters.prior_warnings(rows, "预警", "case_id", "text", "issued", "start").select("case_id", "text", "issued")


@query(expect([(0, 1.0, 1.0), (1, 0.5, 0.72), (2, 0.0, 0.35), (3, 0.0, 0.0)], "id", "labels", "temporal"))
def matcher_dimensions(spark, sf_dir):
    rows = spark.createDataFrame(PROFILES, "id long, months array<int>, days array<int>, labels array<string>, title string")
    return rows.select("id", similarity.match_share(F.col("labels"), ["暴雨", "大风"]).alias("labels"), similarity.temporal_linear(F.col("months"), F.col("days"), 7, [16]).alias("temporal"))


@query(expect([(0, 0.46), (1, 0.2696), (2, 0.063)], "id", "score"))
def matched_cases(spark, sf_dir):
    rows = spark.createDataFrame(PROFILES, "id long, months array<int>, days array<int>, labels array<string>, title string").withColumn("pos", F.col("id"))
    scores = {"disaster": similarity.match_share(F.col("labels"), ["暴雨", "大风"]), "temporal": similarity.temporal_linear(F.col("months"), F.col("days"), 7, [16])}
    return similarity.matched(rows, scores).select("id", "score")


@query(expect([(0, 1.0), (1, 0.35), (2, 0.0), (3, 0.0)], "id", "score"))
def disaster_scores(spark, sf_dir):
    rows = spark.createDataFrame(PROFILES, "id long, months array<int>, days array<int>, labels array<string>, title string")
    families = {"暴雨": ["强降水"], "高温": ["热浪"]}
    return rows.select("id", F.round(similarity.disaster_score(F.col("title"), F.col("labels"), {"暴雨": 1.0}, families), 6).alias("score"))


@query(expect([("大风", 1.5625, "secondary"), ("暴雨", 2.6094, "primary"), ("冰雹", 0.75, "secondary")], "term", "weight", "kind"))
def term_importance(spark, sf_dir):
    # 暴雨: 1 + 0.45 * 0.55 * 1.25 + 0.55 + 0.75 (process); 大风: 1 + 0.45 * 1.25, near a strong word only; 冰雹 is not mentioned
    found = similarity.importance("局地强暴雨！其后一段时间里各地出现持续大风", ["暴雨", "大风", "冰雹"], ["局地"], ["强", "持续"], "七月暴雨过程")
    rows = [(t, w, k) for t, (w, k) in found.items()]
    return spark.createDataFrame(rows, "term string, weight double, kind string")


@query(expect([(0, None), (1, "value not in text"), (2, "unit does not fit"), (3, "unknown chunk"), (4, None)], "id", "reason"))
def checked_facts(spark, sf_dir):
    chunks = spark.createDataFrame([("c", "最大雨量25毫米，最低气温−7.5℃")], "chunk_id string, text string")
    rows = spark.createDataFrame([(0, "c", "precipitation", 25.0, "毫米"), (1, "c", "precipitation", 5.0, "毫米"), (2, "c", "wind", 25.0, "毫米"), (3, "d", "wind", 25.0, "m/s"), (4, "c", "temperature", -7.5, "℃")], "id long, chunk_id string, metric string, value double, unit string")
    return extraction.checked(rows, chunks, "chunk_id", "text").select("id", "reason")


@query(expect([(0, 1, -4.0), (0, 7, 25.5)], "id", "month", "value"))
def values_of_months(spark, sf_dir):
    rows = texts(spark, ["7月平均气温为25.5度；1月平均气温为−4度；8月多雨。", "7月无数据"])
    return extraction.month_values(rows, "id", "text", [1, 7, 8], ["气温"]).select("id", F.col("month").cast("long").alias("month"), "value")


@query(expect([("a", "wind", 18.0, 0.9), ("a", "wind", 12.0, 0.5), ("a", "wind_force", 8.0, 0.78), ("b", "wind", 9.0, 0.6), ("b", "wind_force", 5.0, 0.9)], "case_id", "metric", "value", "confidence"))
def derived_force(spark, sf_dir):
    rows = [("a", "wind", 18.0, 0.9), ("a", "wind", 12.0, 0.5), ("b", "wind", 9.0, 0.6), ("b", "wind_force", 5.0, 0.9)]
    return extraction.derived_wind(spark.createDataFrame(rows, "case_id string, metric string, value double, confidence double"), "case_id")


@query(expect([("d", "个例一 暴雨", 1, 0, 12), ("d", "个例二 大风", 2, 12, 21)], "doc", "title", "case_no", "start", "end_at"))
def case_spans(spark, sf_dir):
    rows = spark.createDataFrame([("d", 1, "个例一 暴雨"), ("d", 2, "雨很大。"), ("d", 3, "个例二 大风"), ("d", 4, "风。")], "doc string, pos long, text string")
    found, _ = build.case_segments(rows, "doc", "pos", "text", "^个例")
    return found.select("doc", "title", F.col("case_no").cast("long").alias("case_no"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end_at"))


@query(expect([(0, "实况：大雨。"), (1, "没有小结")], "id", "seen"))
def observed_text(spark, sf_dir):
    return texts(spark, ["实况：大雨。预报着眼点：低涡。", "没有小结"]).select("id", build.observed(F.col("text"), ["预报着眼点", "个例总结"]).alias("seen"))


@query(expect([(0, "暴雨,强对流,冰雹", "全省"), (1, "高温", "太原")], "id", "labels", "areas"))
def closed_labels(spark, sf_dir):
    rows = spark.createDataFrame([(0, ["冰雹", "暴雨"], ["太原", "大同"]), (1, ["高温"], ["太原"])], "id long, labels array<string>, areas array<string>")
    labels = build.label_closure(F.col("labels"), [(["冰雹", "雷暴"], "强对流")], ["暴雨", "强对流", "冰雹", "高温"])
    return rows.select("id", joined(labels).alias("labels"), joined(build.collapse_areas(F.col("areas"), ["太原", "大同"], "全省")).alias("areas"))


@query(expect([("chunk exists", 1), ("same source", 1), ("unique case_id", 1)], "check_name", "failures"))
def build_checks(spark, sf_dir):
    cases = spark.createDataFrame([("a", "x.pdf", ["1", "2"]), ("a", "x.pdf", ["1"]), ("b", "y.pdf", ["9", "3"])], "case_id string, source_pdf string, source_chunk_ids array<string>")
    chunks = spark.createDataFrame([("1", "x.pdf"), ("2", "z.pdf"), ("3", "y.pdf")], "chunk_id string, source_pdf string")
    return build.validate(cases, chunks).select(F.col("check").alias("check_name"), "failures")


@query(expect([("a", 1, 3), ("a", 2, 6)], "case_id", "pos", "relevance"))
def relevant_parts(spark, sf_dir):
    rows = spark.createDataFrame([("a", 1, "暴雨 30毫米", False), ("a", 2, "暴雨", True), ("a", 3, "晴", False)], "case_id string, pos long, text string, hit boolean")
    return retrieval.relevant_chunks(rows, "case_id", "pos", "text", ["暴雨"], F.col("hit"), 2).select("case_id", "pos", F.col("relevance").cast("long").alias("relevance"))


@query(expect([(0, "雨大。"), (1, "晴。")], "id", "sentence"))
def evidence_sentences(spark, sf_dir):
    return texts(spark, ["晴。雨大。雨小。", "晴。"]).select("id", retrieval.evidence_sentence(X.sentences(F.col("text")), ["雨"]).alias("sentence"))


@query(expect([(1, 1, "a"), (1, 4, "b")], "grp", "rank", "role"))
def roles_covered(spark, sf_dir):
    rows = spark.createDataFrame([(1, 1, "a", "x" * 10), (1, 2, "a", "x" * 8), (1, 3, "b", "x" * 30), (1, 4, "b", "x" * 9)], "grp long, rank long, role string, text string")
    return ranking.role_coverage(rows, "grp", "rank", "role", "text", ["a", "b"], 20).select("grp", "rank", "role")


@query(expect([(0, 0.5, 0), (1, 0.0, 0), (2, 1.0, 0), (3, 1.0, 1)], "id", "coverage", "forbidden"))
def answer_facts(spark, sf_dir):
    rows = spark.createDataFrame(ANSWERS, "id long, facts array<string>, claims array<string>, answer string")
    return rows.select("id", evaluation.fact_coverage(F.col("facts"), F.col("answer")).alias("coverage"), evaluation.forbidden_claims(F.col("claims"), F.col("answer")).cast("long").alias("forbidden"))


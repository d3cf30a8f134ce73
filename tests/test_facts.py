"""Facts in texts: hand-worked strings, and a plain scan rule by rule."""

import random
import re

import pytest
from pyspark.sql import functions as F

from caseloom.functions import scalars
from caseloom.operators import aggregates
from caseloom.operators import facts as N


def found(text):
    return {(m, v, u, r) for m, v, u, r, *_ in N.Scanner().facts(text)}


@pytest.mark.parametrize("text, want", [
    ("过程累计降水量最高达303mm", {("process_rain", 303.0, "mm", "text")}),
    ("局地出现8-10级雷暴大风", {("wind_force", 10.0, "级", "range")}),
    ("雨强介于20～45mm/h", {("hourly_rain", 45.0, "mm/h", "range")}),
    ("中心点降水量为0.1～99毫米", set()),
    ("降温站点：太原8.5 大同 12：阳泉45。", {("temperature_drop", 8.5, "℃", "station"), ("temperature_drop", 12.0, "℃", "station")}),
    ("能见度200米，后升至1.5公里，风速3 m/s。", {("visibility", 0.2, "km", "text"), ("visibility", 1.5, "km", "text")}),
    ("最低气温为-25.6℃（新荣）", {("min_temperature", -25.6, "℃", "text")}),
    ("各地降温\n介于1.4-13.3℃之间。", {("temperature_drop", 13.3, "℃", "range")}),
    ("最大风速。43m/s", set()),
    ("积雪深度≧5cm 的有 8 站，最大为10cm", {("snow_depth", 5.0, "cm", "text"), ("snow_depth", 10.0, "cm", "text")}),
    ("中心气压998hPa，组合回波强度达55dBZ", {("centre_pressure", 998.0, "hPa", "centre"), ("radar_echo", 55.0, "dBZ", "centre")}),
    ("累计降水量为 0.1～150.4 毫米。", {("process_rain", 150.4, "mm", "text"), ("process_rain", 150.4, "mm", "range")}),
    ("", set()),
])
def test_sentences(text, want):
    assert found(text) >= want and {m for m, *_ in found(text)} == {m for m, *_ in want}


def test_offsets_are_those_of_the_original():
    text = "前文。各地\n  降温\r\n幅度\n达13.3℃，大同最低气温降至\n-7℃"
    for f in N.Scanner().facts(text):
        joined = re.sub(r"\s*\n\s*", "", text[f[6] : f[7]])
        assert joined.endswith(("13.3℃", "-7℃")) and joined.startswith(("降温", "气温", "最低气温")), joined


def plain(text, rule):
    """A rule by one expression, for rules without cues and kinds."""
    labels = "|".join(sorted(map(re.escape, rule.labels), key=lambda w: -len(w)))
    units = "|".join(re.escape(u) + (r"(?!\s*/)" if u == "m" else "") for u in sorted(rule.units, key=lambda u: -len(u)))
    out, at = [], 0
    while m := re.compile(rf"({labels})[^。；]{{0,{rule.gap}}}?(?<![\d.])(\d+(?:\.\d+)?)\s*({units})(?![A-Za-z])").search(text, at):
        out.append((m.start(), float(m[2]), rule.units[m[3]], m.end()))
        at = m.end()
    return out


def test_automaton_equals_a_plain_scan():
    random.seed(5)
    rules = tuple(N.Rule(f"r{i}", labels, units, gap) for i, (labels, units, gap) in enumerate([(("雨", "大雨"), N.MM, 10), (("雨量",), N.MM | N.CM, 3), (("风",), N.SPEED, 30), (("雨", "风速"), {"m": "m"} | N.SPEED, 6)]))
    scan = N.Scanner(rules, stations=False)
    words = ["雨", "大雨", "雨量", "风", "风速", "5", "12.5", " ", "mm", "cm", "m/s", "m", "。", "；", "很", "在", "3"]
    for _ in range(3000):
        text = "".join(random.choices(words, k=25))
        got = {(m, s, v, u, e) for m, v, u, _, _, _, s, e, _ in scan.facts(text)}
        want = {(r.metric, s, v, u, e) for r in rules for s, v, u, e in plain(text, r)}
        assert got == want, text


def test_reasons_and_best_proof(spark):
    texts = ["最高气温达38℃；500hPa最高气温35℃", "预计阵风风速可达30m/s。", "2025年7月山西省降水量介于1～90毫米，累计降水量90毫米", "降温站点：太原8。降温幅度介于2～8℃", "最高气温为60℃", "最大小时降水量达40毫米"]
    rows = N.judged(N.facts(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "id", "t"))
    got = {(r.id, r.metric, r.value, r.reason) for r in rows.collect()}
    assert {(0, "max_temperature", 38.0, None), (0, "max_temperature", 35.0, "upper air"), (1, "extreme_wind", 30.0, "forecast"), (2, "process_rain", 90.0, "overview of a month"), (4, "max_temperature", 60.0, "not plausible"), (5, "hourly_rain", 40.0, None)} <= got
    kept = N.best(rows.filter("id = 3"), ["id"], ["start"]).collect()
    assert [(r.value, r.relation) for r in kept] == [(8.0, "station")]
    assert N.facts(spark.createDataFrame([(1, None)], "id int, t string"), "id", "t").count() == 0


def test_readings(spark):
    texts = [
        ("2025年1月14日08时至15日，全省最低气温-25.6℃（新荣），南部-2.7℃（永济）。", "x"), ("2025年7月23日至26日，最大累计降水量出现在\n河曲303毫米。", "x"), ("极大风速43.4m/s（五台山）；850hPa风速核50m/s。", "x"),
        ("14日最低能见度0.6km，出现在太原站；", "case-2024-03"), ("850hPa气温-12℃；地面气温3℃", "x"), (None, None),
    ]
    rows = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(texts)], "id int, t string, s string")
    read = lambda k, **more: [(r.id, r.normalized_value, r.normalized_unit, r.time, r.place) for r in N.readings(rows, "id", "t", N.SPECS[k], source="s", **more).orderBy("id", "start").collect()]
    assert read("air_temperature", names=("最低气温",)) == [(0, -25.6, "℃", "2025-1-14T8/2025-1-15", "新荣"), (0, -2.7, "℃", "2025-1-14T8/2025-1-15", "永济")]
    assert read("precipitation") == [(1, 303.0, "mm", "2025-7-23/2025-7-26", "河曲")]
    assert read("wind_speed") == [(2, 43.4, "m/s", None, "五台山")]
    assert read("visibility") == [(3, 600.0, "m", "2024-3-14", "太原站")]
    assert read("air_temperature")[2:] == [(4, 3.0, "℃", None, None)]


@pytest.mark.parametrize("text, want", [("7月28-8月3日", [7, 8]), ("7月12-15日", [7]), ("3-5月", [3, 4, 5]), ("11月至2月多雪", [1, 2, 11, 12]), ("七月和9月", [7, 9]), ("十二月", [12]), ("无", []), ("13月", []), ("2025年06月", [6])])
def test_months(spark, text, want):
    row = spark.range(1).select(scalars.months(F.lit(text)).alias("m"), aggregates.month_of(("text", F.lit(text))).alias("o")).first()
    assert row.m == want and row.o == want


def test_month_sources(spark):
    iso = spark.range(1).select(aggregates.month_of(("text", F.lit("2024-11-02至12月"))).alias("m"), aggregates.month_of(("months", F.array().cast("array<int>")), ("text", F.lit("5-7"))).alias("n")).first()
    assert iso.m == [11, 12] and iso.n == []

"""Numeric facts from texts: all labels in one pass of an automaton, then the number that a label announces.

A rule says which labels name a metric, how far behind a label (or behind a cue after it) the number may
stand, and in which units. Rules are data: 16 metrics of weather reports below, other vocabularies as a
parameter. Of a text its labels and cues are found together by one Aho-Corasick automaton, its numbers with
units by one expression; a rule then looks its number up by place, never across the end of a sentence. So a sentence says the same wherever
it stands: what short sentences say is kept, and reports that repeat them are scanned once for each wording.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BREAKS = "。；"  # ends of sentences: a label says nothing about a number behind one


@dataclass(frozen=True)
class Rule:
    metric: str
    labels: tuple[str, ...]
    units: dict[str, str] = field(hash=False)  # spelling -> unit of the fact
    gap: int = 80  # characters at most between the label, or cue, and the number
    cues: tuple[str, ...] = ()  # one of them must stand between label and number
    cue_gap: int = 0  # characters at most between label and cue
    kind: str = "first"  # first: the next number; upper: the upper end of the next range; all: every number of the sentence
    relation: str = "text"
    confidence: float = 0.8
    without: tuple[str, ...] = ()  # not in sentences with one of these
    followed: tuple[str, ...] = ()  # one of these must stand at most six characters behind the unit
    low: float = 0.0  # numbers below are passed over
    words: bool = False  # labels are whole words


#: Spellings of units.
MM, PER_HOUR = {"mm": "mm", "毫米": "mm"}, {"mm/h": "mm/h", "mm / h": "mm/h", "毫米/小时": "mm/h", "毫米每小时": "mm/h"}
RAIN_RATE = PER_HOUR | {"mm": "mm/h", "毫米": "mm/h"}
CM = {"cm": "cm", "厘米": "cm"}
SPEED = {"m/s": "m/s", "m / s": "m/s", "m·s-1": "m/s", "米/秒": "m/s", "米每秒": "m/s"}
FORCE = {"级": "级", "级以上": "级"}
CELSIUS = {"℃": "℃", "°C": "℃", "C": "℃"}
DISTANCE = {"km": "km", "公里": "km", "千米": "km", "m": "m", "米": "m"}
#: Labels of metrics in weather reports, and the words that announce an extreme.
MOST, REACH = ("最大",), ("达到", "达", "为")
WEATHER = (
    Rule("process_rain", ("过程最大降水量", "过程降水量", "累计降水量"), MM, 6),
    Rule("process_rain", ("过程", "累计", "24h", "24小时", "48小时"), MM, 30, MOST, 80),
    Rule("process_rain", ("累计降水量",), MM, 8, ("最高", "最大"), 80, confidence=0.86, without=("中心点",)),
    Rule("process_rain", ("暴雨", "降水"), MM, 50, MOST, 100, confidence=0.86, without=("中心点",)),
    Rule("process_rain", ("降水量",), MM, 80, kind="upper", relation="range", confidence=0.86, without=("中心点",)),
    Rule("max_rain", ("最大降水量", "最大降水", "最大雨强", "最大雪强"), MM | PER_HOUR, 40),
    Rule("hourly_rain", ("最大小时雨强", "小时雨强", "小时最大雨量", "最大小时降水量", "1小时降水量", "1小时最大降水量"), RAIN_RATE, 6),
    Rule("hourly_rain", ("最大雨强", "小时最大降水量", "最大1小时降水量", "小时雪强", "小时雨量", "每小时雨强"), RAIN_RATE, 80),
    Rule("hourly_rain", ("雨强", "小时雨量", "短时强降水"), RAIN_RATE, 100, kind="upper", relation="range", confidence=0.86),
    Rule("hourly_rain", ("雨强", "短时强降水"), RAIN_RATE, 50, MOST, 140, confidence=0.86),
    Rule("hourly_rain", MOST, PER_HOUR, 50, confidence=0.86),
    Rule("snow_depth", ("最大积雪深度", "积雪深度", "雪深"), CM, 100),
    Rule("snow_depth", ("积雪深度", "雪深"), CM, 4, MOST, 120, confidence=0.86),
    Rule("snow_fall", ("降雪量", "过程降雪"), MM, 100),
    Rule("extreme_wind", ("极大风速", "最大阵风风速", "最大瞬时风速", "瞬时大风", "日极端阵风", "阵风风速"), SPEED, 140),
    Rule("max_wind", ("最大风速", "最大平均风速"), SPEED, 6),
    Rule("max_wind", ("最大", "最强风力"), SPEED, 70),
    Rule("max_wind", ("风力超过",), SPEED, 120),
    Rule("max_wind", ("最大值",), SPEED, 2, REACH, 80, confidence=0.86),
    Rule("wind_force", ("阵风风力", "最大风力等级", "阵风", "风力"), FORCE, 60),
    Rule("wind_force", ("大风", "阵风", "风力"), FORCE, 50, ("最大值", "最大", "达到", "达"), 140, confidence=0.86),
    Rule("wind_force", ("出现", "有"), FORCE, 40, kind="upper", relation="range", confidence=0.86, followed=("大风",)),
    Rule("max_temperature", ("日最高气温", "最高气温", "最高温度"), CELSIUS, 110, low=25.0),
    Rule("max_temperature", ("日最高气温", "最高气温", "最高温度"), CELSIUS, 80, kind="upper", relation="range", confidence=0.86),
    Rule("min_temperature", ("日最低气温", "最低气温", "最低温度"), CELSIUS, 110, low=-100.0),
    Rule("temperature_drop", ("过程降温幅度", "降温幅度", "最大降温", "降温最大值"), CELSIUS, 100),
    Rule("temperature_drop", ("最低气温", "气温"), CELSIUS, 100, ("下降",), 20),
    Rule("temperature_drop", ("降温幅度", "降温", "下降"), CELSIUS, 80, kind="upper", relation="range", confidence=0.86),
    Rule("visibility", ("最低能见度", "最小水平能见度"), DISTANCE, 60),
    Rule("visibility", ("能见度",), DISTANCE, kind="all", confidence=0.88),
    Rule("hail_size", ("冰雹直径", "最大冰雹", "冰雹"), MM | CM, 100),
    Rule("radar_echo", ("回波强度", "回波反射率因子", "雷达回波", "组合回波"), {"dBZ": "dBZ"}, 8),
    Rule("centre_pressure", ("中心气压", "中心点气压"), {"hPa": "hPa", "百帕": "hPa"}, 3),
    Rule("centre_temperature", ("中心温度", "中心点温度"), CELSIUS, 3, low=-100.0),
)
#: The places that a fact may name, first found first; and the word that makes it a centre's.
PLACES = ("太原", "大同", "朔州", "忻州", "阳泉", "晋中", "吕梁", "长治", "晋城", "临汾", "运城")
CENTRE, CENTRE_CONFIDENCE = "中心", 0.95
#: A list of stations, each with its drop of temperature behind it, after the first colon.
STATION_WORDS, STATION_MOST = ("降温", "站", "："), 30.0
#: Sentences of at most so many characters are kept, so many at a time in each Python worker; BEHIND: how far ``followed`` looks.
KEPT_CHARS, KEPT, BEHIND = 512, 1 << 16, 6

SIGN, RANGE = r"[-−－]", r"[～~\-－—至到]+"
NUMBER = r"\d+(?:\.\d+)?"
LINE_BREAK = re.compile(r"\s*\r?\n\s*")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
KIND = [("metric", T.StringType()), ("value", T.DoubleType()), ("unit", T.StringType()), ("relation", T.StringType()), ("confidence", T.DoubleType()), ("place", T.StringType()), ("start", T.IntegerType()), ("end", T.IntegerType()), ("sentence", T.StringType())]


class Scanner:
    """The rules made ready: one automaton of all labels and cues, one expression of all numbers with units."""

    def __init__(self, rules: tuple[Rule, ...] = WEATHER, breaks: str = BREAKS, places: tuple[str, ...] = PLACES, stations: bool = True, join_lines: bool = True, which: str | None = None):
        self.rules, self.places, self.stations, self.join_lines = rules, places, stations, join_lines
        self.automaton = ahocorasick.Automaton()
        of: dict[str, tuple[list[int], list[int]]] = {}
        for i, r in enumerate(rules):
            for w in r.labels:
                of.setdefault(w.translate(LOWER), ([], []))[0].append(i)
            for w in r.cues:
                of.setdefault(w.translate(LOWER), ([], []))[1].append(i)
        for w, (labels, cues) in of.items():
            self.automaton.add_word(w, (len(w), labels, cues))
        self.automaton.make_automaton()
        units = sorted({u for r in rules for u in r.units}, key=lambda u: (-len(u), u))
        bare = [u.replace(" ", "") for u in units]
        rate = {u for u in units if any(b.startswith(f"{u}/") for b in bare)}  # such a unit before a slash is part of a rate
        spelt = "|".join(re.escape(u).replace(r"\ ", r"\s*") + (r"(?!\s*/)" if u in rate else "") for u in units)
        self.unit = {u.translate(LOWER).replace(" ", ""): u.replace(" ", "") for u in units}
        # a letter behind makes a Latin unit another word
        self.measure = re.compile(rf"(?<![\d.])(?:({NUMBER})\s*{RANGE}\s*)?({SIGN}?{NUMBER})\s*({spelt})(?![A-Za-z])", re.I)
        self.breaks = re.compile(f"[{re.escape(breaks)}]")
        self.told = [{k.translate(LOWER).replace(" ", ""): v for k, v in r.units.items()} for r in rules]
        # no label, cue, number or unit goes beyond the end of a sentence, unless a rule is spelt with one
        spelling = "".join([*of, *units, *(STATION_WORDS if stations else ())])
        self.apart = not any(c in spelling or c.isspace() or c.isalnum() or c in "_./-−－～~至到" for c in breaks)
        self.looking = tuple(w for r in rules if r.followed for w in r.labels)  # labels of rules that look behind the sentence
        self.which, self.reasons = which, Reasons() if which else None
        self.kept: dict[tuple[str, str], tuple[list[tuple], list[tuple]]] = {}

    def joined(self, text: str) -> tuple[str, tuple[list[int], list[int]] | None]:
        """(text without the line breaks of a page layout; where its parts begin and how far they moved, if there is a break)."""
        if not self.join_lines or "\n" not in text:
            return text, None
        parts, begins, shifts, at, size = [], [], [], 0, 0
        for begin, end in [*(m.span() for m in LINE_BREAK.finditer(text)), (len(text), 0)]:
            parts.append(text[at:begin])
            begins.append(size)
            shifts.append(at - size)
            size += begin - at
            at = end
        return "".join(parts), (begins, shifts)

    def facts(self, original: str) -> Iterator[tuple]:
        """(metric, value, unit, relation, confidence, place, start, end, sentence), in the order of the text; with ``which`` their reasons behind them, facts of that kind only."""
        text, places = self.joined(original)
        late = []
        for begin, (first, last) in self.sentences(text):
            late += [(begin, f) for f in last]
            for f in first:
                yield self._moved(f, begin, places)
        for begin, f in late:
            yield self._moved(f, begin, places)

    def sentences(self, text: str) -> Iterator[tuple[int, tuple[list[tuple], list[tuple]]]]:
        """(where a sentence begins, (its facts, those of its list of stations), places counted from there); texts that cannot be parted are one."""
        begin = 0
        for stop in [*(m.start() for m in self.breaks.finditer(text)), len(text)] if self.apart else [len(text)]:
            if begin < stop:
                sentence, behind = text[begin:stop], ""
                for w in self.looking:
                    if w in sentence or w.lower() != w.upper():  # labels are found in either case
                        behind = text[stop : stop + BEHIND]
                        break
                said = self.kept.get((sentence, behind))
                if said is None:
                    said = self._judged(self._sentence(sentence + behind, stop - begin)), self._judged(self._stations(sentence) if self.stations else ())
                    if len(sentence) <= KEPT_CHARS:
                        if len(self.kept) >= KEPT:
                            self.kept.clear()
                        self.kept[sentence, behind] = said
                if said[0] or said[1]:
                    yield begin, said
            begin = stop + 1

    def _judged(self, found) -> list[tuple]:
        if not self.reasons:
            return list(found)
        found = [(*f, self.reasons.of(f[0], f[1], f[2], f[8])) for f in found]
        return [f for f in found if self.which == "all" or (f[9] is None) == (self.which == "observed")]

    @staticmethod
    def _moved(f: tuple, begin: int, places: tuple[list[int], list[int]] | None) -> tuple:
        start, end = begin + f[6], begin + f[7]
        if places is not None:
            begins, shifts = places
            start, end = start + shifts[bisect_right(begins, start) - 1], end + shifts[bisect_right(begins, end - 1) - 1]
        return (*f[:6], start, end, *f[8:])

    def _sentence(self, text: str, size: int) -> Iterator[tuple]:
        """Facts, without reasons, of the first ``size`` characters, in their order; what stands behind them is only looked at."""
        low = text[:size].translate(LOWER)
        labels: dict[int, list[tuple[int, int]]] = {}
        cues: dict[int, list[tuple[int, int]]] = {}
        for last, (n, of, cue_of) in self.automaton.iter(low):
            for i in of:
                labels.setdefault(i, []).append((last + 1 - n, last + 1))
            for i in cue_of:
                cues.setdefault(i, []).append((last + 1 - n, last + 1))
        if not labels:
            return
        ends = [m.start() for m in self.breaks.finditer(text, 0, size)] + [size]
        found = []
        measures = [(m.end(2) - len(m[2].lstrip("-−－")), m.end(), m) for m in self.measure.finditer(text) if m.end(2) <= size]
        starts = [m[0] for m in measures]
        for i, hits in labels.items():
            rule, done = self.rules[i], 0
            for begin, end in sorted(hits, key=lambda x: (x[0], -x[1])):
                if begin < done or rule.words and (self._letter(text, begin - 1) or self._letter(text, end)):
                    continue
                stop = ends[bisect_left(ends, end)]
                for last in self._places(rule, i, begin, end, stop, cues, measures, starts, ends):
                    done = max(done, last[1])
                    found.append((begin, i, *last))
        for begin, i, at, end, m in sorted(found, key=lambda x: (x[0], x[2], x[1])):
            rule = self.rules[i]
            where = bisect_left(ends, begin)
            sentence = text[ends[where - 1] + 1 if where else 0 : ends[where]].strip()
            if any(w in sentence for w in rule.without):
                continue
            yield self._fact(i, m, begin, end, sentence)

    def _letter(self, text: str, at: int) -> bool:
        return 0 <= at < len(text) and text[at].isascii() and (text[at].isalnum() or text[at] == "_")

    def _places(self, rule, i, begin, end, stop, cues, measures, starts, ends):
        """(number's place, end, match) of what the label announces."""
        if rule.kind == "all":
            begin = ends[bisect_left(ends, begin) - 1] + 1 if bisect_left(ends, begin) else 0
            at = bisect_left(starts, begin)
            while at < len(measures) and measures[at][0] < stop:
                if self._fits(rule, i, measures[at][2]):
                    yield measures[at]
                at += 1
            return
        after = [end]
        if rule.cues:
            known = cues.get(i, [])  # in the order of their ends; equal ends: the longer first or last, both will do
            at = bisect_left(known, end, key=lambda x: x[1])
            after = []
            while at < len(known) and known[at][1] <= end + rule.cue_gap + 8 and known[at][0] < stop:
                if end <= known[at][0] <= end + rule.cue_gap:
                    after.append(known[at][1])
                at += 1
        for begin in after:
            at = bisect_left(starts, begin)
            while at < len(measures) and measures[at][0] < stop:
                m = measures[at][2]
                # a range begins with its lower end
                if (m.start() if rule.kind == "upper" else measures[at][0]) > begin + rule.gap:
                    break
                if self._fits(rule, i, m) and (rule.kind != "upper" or m[1]):
                    yield measures[at]
                    return
                at += 1

    def _fits(self, rule: Rule, i: int, m: re.Match) -> bool:
        known = m[3].translate(LOWER).replace(" ", "") in self.told[i]
        return known and not (rule.words and self._letter(m.string, m.end())) and self._value(rule, m) >= rule.low and (not rule.followed or any(w in m.string[m.end() : m.end() + 6] for w in rule.followed))

    @staticmethod
    def _value(rule: Rule, m: re.Match) -> float:
        """A dash counts as a sign only where a number may be below zero."""
        digits = m[2].lstrip("-−－")
        return -float(digits) if rule.low < 0 and digits != m[2] else float(digits)

    def _fact(self, i, m, begin, end, sentence):
        rule = self.rules[i]
        value, unit = self._value(rule, m), self.told[i][m[3].translate(LOWER).replace(" ", "")]
        if rule.metric == "visibility" and unit == "m":
            value, unit = value / 1000, "km"
        centre = rule.relation == "text" and rule.confidence == 0.8 and CENTRE in sentence
        return rule.metric, value, unit, "centre" if centre else rule.relation, CENTRE_CONFIDENCE if centre else rule.confidence, next((p for p in self.places if p in sentence), None), begin, end, sentence[:240]

    def _stations(self, text):
        begin = 0
        for stop in [*(m.start() for m in self.breaks.finditer(text)), len(text)]:
            sentence = text[begin:stop]
            if all(w in sentence for w in STATION_WORDS):
                at = begin + sentence.index(STATION_WORDS[2]) + 1
                for m in re.compile(rf"[一-鿿]{{1,10}}\s*({SIGN}?{NUMBER})").finditer(text, at, stop):
                    digits = m[1].lstrip("-−－")
                    if digits == m[1] and 0 < float(digits) <= STATION_MOST:
                        yield "temperature_drop", float(digits), "℃", "station", 0.9, next((p for p in self.places if p in sentence), None), m.start(), m.end(), sentence.strip()[:240]
            begin = stop + 1


@lru_cache(maxsize=4)
def ready(*how) -> Scanner:
    """One scanner for all tasks of a Python worker."""
    return Scanner(*how)


def facts(chunks: DataFrame, key: str, text: str, rules: tuple[Rule, ...] = WEATHER, breaks: str = BREAKS, places: tuple[str, ...] = PLACES, stations: bool = True, join_lines: bool = True, fields: tuple[str, ...] = tuple(n for n, _ in KIND), which: str = "all", once: bool = False) -> DataFrame:
    """key, metric, value, unit, relation, confidence, place, start, end, sentence: a row for each number that a rule finds.

    join_lines: whether line breaks are a page's layout inside sentences. start and end are code points of the original text, from the label to the unit. A null or empty text has
    none; of very long texts all is read; a number that two rules find is there twice (``best`` keeps one). fields: the columns to return, ``reason`` (see ``judged``) may be one.
    which: all, observed (without a reason) or rejected. once: of each text a (metric, value, unit) once, by the best proof, then the first, as ``best`` does for a group of texts.
    """
    kinds = dict(KIND) | {"reason": T.StringType()}
    arrow = {T.StringType(): pa.string(), T.DoubleType(): pa.float64(), T.IntegerType(): pa.int32()}
    take = [[*dict(KIND), "reason"].index(n) for n in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = ready(rules, breaks, places, stations, join_lines, which if which != "all" or "reason" in fields else None)

        def told(said: str) -> list[tuple]:
            found = scanner.facts(said)
            if once:
                kept: dict[tuple, tuple] = {}
                for f in found:
                    have = kept.setdefault(f[:3], f)
                    if (-PROOF.get(f[3], 1), f[6], -f[4]) < (-PROOF.get(have[3], 1), have[6], -have[4]):
                        kept[f[:3]] = f
                found = kept.values()
            return found

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                whose, out = [], []
                for i, t in enumerate(part.column("text").to_pylist()):
                    n = len(out)
                    out += told(t or "")
                    whose += [i] * (len(out) - n)
                columns = list(zip(*out)) if out else [[]] * 10
                yield pa.record_batch([part.column("key").take(pa.array(whose, pa.int32())), *[pa.array(columns[j], arrow[kinds[n]]) for j, n in zip(take, fields)]], names=[key, *fields])

    kind = T.StructType([T.StructField(key, chunks.schema[key].dataType), *[T.StructField(n, kinds[n]) for n in fields]])
    return chunks.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, kind)


#: What is no observed extreme. A metric's number must lie above, from, and not above these bounds.
ABOVE_ZERO = ("process_rain", "max_rain", "hourly_rain", "snow_depth", "snow_fall", "max_wind", "extreme_wind", "wind_force", "temperature_drop")
WINDS, RAINS, TEMPERATURES = ("max_wind", "extreme_wind", "wind_force"), ("process_rain", "max_rain", "hourly_rain"), ("max_temperature", "min_temperature")
HOT = (30.0, 55.0)
UNITS_OF = {"process_rain": ("mm",), "max_rain": ("mm",), "snow_fall": ("mm",), "hourly_rain": ("mm/h",), "max_temperature": ("℃",), "min_temperature": ("℃",), "temperature_drop": ("℃",), "centre_temperature": ("℃",), "extreme_wind": ("m/s",), "max_wind": ("m/s",), "wind_force": ("级",), "snow_depth": ("cm",), "visibility": ("km",), "hail_size": ("mm", "cm"), "radar_echo": ("dBZ",), "centre_pressure": ("hPa",)}
WARNING, EXPECTED, MAY = "预警", "预计", ("预计", "可达", "未来")
OVERVIEW, PROVINCE = ("月降水量", "平均降水量", "全省平均", "较常年", "气候概况", "气象概况"), "山西省降水量"
UPPER_AIR = ("冷中心", "中心气温", "500hPa", "700hPa", "850hPa")


class Reasons:
    """Why a fact is no observed value of its metric (None: it is one). What a sentence says about all its facts is kept."""

    BLANK, MONTH = re.compile(r"[ \t\n\x0b\f\r]+"), re.compile(r"[0-9]{4}年[0-9]{1,2}月")

    def __init__(self):
        self.kept: dict[str, tuple[bool, ...]] = {}

    def signs(self, sentence: str) -> tuple[bool, ...]:
        """forecast, overview of a month, upper air, a place of the lowest temperature, an hourly value."""
        found = self.kept.get(sentence)
        if found is None:
            said = self.BLANK.sub("", sentence)
            has = lambda *words: any(w in said for w in words)
            forecast = has("预警区域") or has(WARNING) and has(*MAY) or has(EXPECTED) and has("阵风", "风力", "风速")
            overview = bool(self.MONTH.search(said)) and has(PROVINCE + "介于") or has(PROVINCE) and has(*OVERVIEW)
            found = forecast, overview, has(*UPPER_AIR), has("最低气温出现在"), has("最大小时", "小时最大", "小时雨强", "每小时雨强")
            if len(self.kept) >= KEPT:
                self.kept.clear()
            self.kept[sentence] = found
        return found

    def of(self, metric: str | None, value: float | None, unit: str | None, sentence: str | None) -> str | None:
        forecast, overview, aloft, place_of_lowest, hourly = self.signs(sentence or "")
        if metric in UNITS_OF and unit is not None and unit not in UNITS_OF[metric]:
            return "unit does not fit"
        if value is not None and metric in ABOVE_ZERO and value <= 0:
            return "not above zero"
        if metric in WINDS and forecast:
            return "forecast"
        if metric in RAINS and overview:
            return "overview of a month"
        if metric in TEMPERATURES and aloft:
            return "upper air"
        if value is not None and (metric == "max_temperature" and not HOT[0] <= value <= HOT[1] or metric == "min_temperature" and value >= 0 or metric == "temperature_drop" and place_of_lowest and value > 25):
            return "not plausible"
        return "an hourly value" if metric in ("max_rain", "process_rain") and hourly else None


def judged(found: DataFrame) -> DataFrame:
    """found with ``reason``: why a fact is no observed value of its metric (null: it is one)."""

    @F.pandas_udf("string")
    def reason(metric: pd.Series, value: pd.Series, unit: pd.Series, sentence: pd.Series) -> pd.Series:
        of = Reasons().of
        number = (None if v != v else v for v in value)
        return pd.Series([of(*x) for x in zip(metric, number, unit, sentence)], dtype=object)

    return found.withColumn("reason", reason("metric", "value", "unit", "sentence"))


# --- readings of one metric, with time and place ---------------------------------------------------------------


@dataclass(frozen=True)
class Spec:
    """A metric to compare: what names it in a sentence, its units, the factor and unit that make values comparable, and words near a number that is not measured at the ground."""

    names: tuple[str, ...]
    units: dict[str, float]
    unit: str
    aloft: tuple[str, ...] = ()
    aloft_sentence: tuple[str, ...] = ()  # a sentence with one of these counts only with one of ``ground``
    ground: tuple[str, ...] = ()


#: Names and units of the metrics that questions compare, and words of the upper air.
SPECS = {
    "air_temperature": Spec(("最低气温", "最高气温", "最低温度", "最高温度", "气温"), {"℃": 1.0, "°C": 1.0}, "℃", ("hPa", "冷涡", "冷中心", "暖中心", "等温线", "高空", "对流层")),
    "precipitation": Spec(("累计降水量", "过程降水量", "降水量", "雨量"), {"毫米": 1.0, "mm": 1.0}, "mm"),
    "wind_speed": Spec(("最大风速", "极大风速", "极大风", "阵风风速", "风速"), {"m/s": 1.0, "米/秒": 1.0}, "m/s", ("风速核", "高空急流", "低空急流"), ("风速核", "高空急流", "低空急流"), ("实况", "国家站", "区域站", "观测站", "阵风")),
    "visibility": Spec(("最低能见度", "最小水平能见度", "能见度"), {"千米": 1000.0, "公里": 1000.0, "km": 1000.0, "米": 1.0, "m": 1.0}, "m"),
}
ALOFT_BEFORE, ALOFT_AFTER, TIME_BEFORE, PLACE_NEAR = 65, 18, 50, 80
SAYS_WHERE = ("出现在", "位于", "分别为", "为", "达")
LAYOUT, SENTENCE = re.compile(r"[ \t]*\r?\n[ \t]*"), re.compile(r"[^。；;]+[。；;]?|[。；;]")
DATE_PART = re.compile(rf"(\d{{1,4}})\s*([年月日时])|(\d{{1,2}})\s*(?={RANGE}\s*\d{{1,2}}\s*[月日])|({RANGE})")


def dates(text: str) -> list[tuple[int, int, str, bool]]:
    """(start, end, date, whether it ends a range) of every day that a text names, read from left to right.

    Each number sets its part (year, month, day, hour) and forgets the smaller ones; larger ones are
    inherited from what was named before. A number before a dash and another day is a day too. Dates are
    ``[year-]month-day[Thour]``; days without a month so far are ``?-day``.
    """
    out: list[list] = []
    year = month = None
    dash = -1
    for m in DATE_PART.finditer(text):
        if m[4]:
            dash = m.end()
            continue
        n, mark = (int(m[1]), m[2]) if m[1] else (int(m[3]), "日")
        if mark == "年" and n >= 1000:
            year, month = n, None
        elif mark == "月" and 1 <= n <= 12:
            month = n
        elif mark == "日" and 1 <= n <= 31:
            day = f"{f'{year}-' if year else ''}{month if month else '?'}-{n}"
            ranged = bool(out) and dash >= 0 and 0 <= dash - out[-1][1] <= 4 and m.start() - dash <= 4
            out.append([m.start(), m.end(), day, ranged])
        elif mark == "时" and n < 24 and out and m.start() - out[-1][1] <= 2 and "T" not in out[-1][2]:
            out[-1][1:3] = [m.end(), f"{out[-1][2]}T{n}"]
    return [tuple(x) for x in out]


def _time(said: list[tuple[int, int, str, bool]], begin: int, stop: int, at: int, source: str) -> str | None:
    """The last day or range before a number in its sentence, else the first one of the sentence, else of the text; its month from the source's name, if from nowhere else."""
    before = [i for i, d in enumerate(said) if begin <= d[0] and d[1] <= at and d[0] >= at - TIME_BEFORE]
    inside = [i for i, d in enumerate(said) if begin <= d[0] < stop]
    if not said:
        return None
    i = before[-1] if before else inside[0] if inside else 0
    if not before and i + 1 < len(said) and said[i + 1][3]:
        i += 1
    time = f"{said[i - 1][2]}/{said[i][2]}" if said[i][3] and i else said[i][2]
    named = re.search(r"(20\d\d)\D{1,2}(1[0-2]|0?[1-9])(?!\d)", source) if "?" in time else None
    return time.replace("?", f"{named[1]}-{int(named[2])}") if named else None if "?" in time else time


def _place(sentence: str, begin: int, end: int, bracket: str | None) -> str | None:
    """The bracketed name behind a number, else the name that stands before it or is said behind it."""
    if bracket and not re.search(r"[\d级%～~]", bracket):
        return bracket
    before = re.search(rf"(?:{'|'.join(SAYS_WHERE)})[:：]?\s*([一-鿿]{{2,12}})\s*[（(]?\s*$", sentence[max(0, begin - 35) : begin])
    behind = re.match(rf"(?:[（(][^）)]*[）)])?[，,\s]*(?:最高值)?(?:{'|'.join(SAYS_WHERE[:2])})\s*([一-鿿]{{2,24}})", sentence[end : end + PLACE_NEAR])
    return before[1] if before else behind[1] if behind else None


READING = "value double, unit string, normalized_value double, normalized_unit string, time string, place string, start int, sentence string"


def readings(chunks: DataFrame, key: str, text: str, spec: Spec, names: tuple[str, ...] | None = None, source: str | None = None) -> DataFrame:
    """key and READING: every number with a fitting unit in a sentence that names the metric (by ``names``, if given), measured at the ground.

    source: a column with the name of the text's source, for the year and month of days without one. A null or empty text has none.
    """
    spelt = "|".join(re.escape(u) for u in sorted(spec.units, key=lambda u: (-len(u), u)))
    number = re.compile(rf"(?<![\d.])({SIGN}?{NUMBER})\s*({spelt})(?![A-Za-z/])(?:[（(]([^）)]{{1,30}})[）)])?", re.I)
    factor = {u.translate(LOWER): f for u, f in spec.units.items()}
    known, columns = tuple(names or spec.names), [c.split(" ")[0] for c in READING.split(", ")]

    def measured(sentence: str) -> Iterator[tuple]:
        """(value, unit, value and unit to compare, place, where it stands in the sentence) of one sentence's numbers."""
        if not any(n in sentence for n in known) or any(w in sentence for w in spec.aloft_sentence) and not any(w in sentence for w in spec.ground):
            return
        for v in number.finditer(sentence):
            if any(w in sentence[max(0, v.start() - ALOFT_BEFORE) : v.start() + ALOFT_AFTER] for w in spec.aloft):
                continue
            digits = v[1].lstrip("-−－")
            ranged = digits != v[1] and v.start() and (sentence[v.start() - 1].isdigit() or sentence[v.start() - 1] in "℃")  # a dash that joins a range
            value = float(digits) if digits == v[1] or ranged else -float(digits)
            yield value, v[2], value * factor[v[2].translate(LOWER)], spec.unit, _place(sentence, v.start(), v.end(2), v[3]), v.start()

    kept: dict[str, tuple] = {}  # short sentences of a task: their numbers, and those that name days

    def one(said: str, name: str) -> Iterator[tuple]:
        said = LAYOUT.sub("", said)
        named = None
        for sentence, base in [(m[0], m.start()) for m in SENTENCE.finditer(said)]:
            numbers = kept.get(sentence)
            if numbers is None:
                numbers = tuple(measured(sentence))
                if len(sentence) <= KEPT_CHARS:
                    if len(kept) >= KEPT:
                        kept.clear()
                    kept[sentence] = numbers
            if not numbers:
                continue
            named = dates(said) if named is None else named
            # days of this sentence, the one before them, the one behind them: no others are looked at
            first, last = bisect_left(named, base, key=lambda d: d[0]), bisect_left(named, base + len(sentence), key=lambda d: d[0])
            near, plain = named[max(0, first - 1) : last + 1] if first < last else named[:2], sentence.strip()[:500]
            for value, unit, normal, normal_unit, place, at in numbers:
                yield value, unit, normal, normal_unit, _time(near, base, base + len(sentence), base + at, name), place, base + at, plain

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.float64(), pa.string(), pa.float64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                which, out = [], []
                for i, (t, name) in enumerate(zip(part.column("text").to_pylist(), part.column("source").to_pylist())):
                    for f in one(t or "", name or ""):
                        which.append(i)
                        out.append(f)
                held = list(zip(*out)) if out else [[] for _ in columns]
                yield pa.record_batch([part.column("key").take(pa.array(which, pa.int32())), *[pa.array(c, k) for c, k in zip(held, kinds)]], names=[key, *columns])

    kind = T.StructType([T.StructField(key, chunks.schema[key].dataType), *T._parse_datatype_string(READING).fields])
    name = F.col(source) if source else F.lit(None).cast("string")
    return chunks.select(F.col(key).alias("key"), F.col(text).alias("text"), name.alias("source")).mapInArrow(run, kind)


#: Of equal values the better proof stays: a station's over a sentence's, that over a range's end.
PROOF = {"range": 0, "station": 2}


def best(found: DataFrame, per: list[str], order: list[str]) -> DataFrame:
    """Each (metric, value, unit) of a group once: by the best proof, the first of equal ones in the given order."""
    proof = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PROOF.items() for x in kv]), F.col("relation")), F.lit(1))
    rest = [c for c in found.columns if c not in (*per, "metric", "value", "unit")]
    kept = found.groupBy(*per, "metric", "value", "unit").agg(F.min_by(F.struct(*rest), F.struct(-proof, *order)).alias("_x"))
    return kept.select(*per, "metric", "value", "unit", *[F.col(f"_x.{c}").alias(c) for c in rest])

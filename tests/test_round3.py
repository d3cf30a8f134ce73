"""Faults that the findings of round 3 named."""

import random

import pytest
from pyspark.sql import functions as F

from caseloom.operators import build, extraction, ranking, retrieval
from caseloom.operators import facts as N


def test_paragraphs_lose_blanks_only(spark):
    docs = spark.createDataFrame([(7, "card 4072374829496490\n\n 171 by 205.171.1 \n   \n22 of 2")], "doc_id long, text string")
    rows = [tuple(r) for r in build.paragraphs(docs, "doc_id", "text", r"\n+").collect()]
    assert rows == [(7, 1, "card 4072374829496490"), (7, 2, "171 by 205.171.1"), (7, 3, "22 of 2")]


def test_reranked_halves_round_as_products(spark):
    """0.7 * mean and 0.3 * stretched score as doubles, then rounded as x * 10^6."""
    cosines = [(i, i % 2 + 1, (1000 + 13 * i) / 1e6) for i in range(2000)]
    rows = spark.createDataFrame([(i, case, c, float(r)) for i, case, c in cosines for r in (0, 1)], "query_id long, case_id long, cosine double, rerank double")
    have = {r.query_id: r.score for r in retrieval.rerank_merge(rows).collect()}
    want = {}
    for i, _, c in cosines:
        x = (0.7 * ((c + c) / 2) + 0.3 * 1.0) * 1e6
        want[i] = (int(x) + (x - int(x) >= 0.5)) / 1e6
    assert have == pytest.approx(want, abs=1e-12)


WORDING = ["7月3日累计降水量最高达12毫米（原平）", "局地出现5-8级", "大风", "雷暴大风", "最高气温介于6～31℃", "能见度120米，后升\n至1.5公里", "预警区域内阵风可达9级", "过程最大降水量达30mm", "降温站点：太原8.5 大同 12", "最低气温-7℃", ""]


def test_kept_sentences_say_what_whole_texts_say():
    """A scanner that has seen the sentences, one that has not, and one that may not part the text."""
    random.seed(3)
    used = N.Scanner()
    for _ in range(400):
        text = "".join(random.choice(WORDING) + random.choice("。；") for _ in range(6)) + random.choice(WORDING)
        new, whole = N.Scanner(), N.Scanner()
        whole.apart = False
        want = list(whole.facts(text))
        assert list(new.facts(text)) == want and list(used.facts(text)) == want, text
    assert len(used.kept) < 1000  # 2,800 sentences were said


def test_a_report_that_repeats_itself_is_scanned_once(monkeypatch):
    calls = []
    plain = N.Scanner._sentence
    monkeypatch.setattr(N.Scanner, "_sentence", lambda self, *a: calls.append(a) or plain(self, *a))
    assert len(list(N.Scanner().facts("最高气温31℃。" * 500))) == 500
    assert len(calls) <= 2


def test_facts_once_and_by_reason_as_their_tables(spark):
    random.seed(4)
    texts = [(i, "".join(random.choice(WORDING) + random.choice("。；") for _ in range(8))) for i in range(300)]
    rows = spark.createDataFrame(texts, "id int, t string")
    found = N.judged(N.facts(rows, "id", "t"))
    columns = ["id", "metric", "value", "unit", "relation", "start", "end"]
    best = N.best(found.filter("reason is null"), ["id"], ["start", -F.col("confidence")]).select(*columns)
    once = N.facts(rows, "id", "t", fields=tuple(columns[1:]), which="observed", once=True)
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert same(once.drop("end"), best.drop("end"))
    fields = ("metric", "relation", "reason")
    assert same(N.facts(rows, "id", "t", fields=fields, which="rejected"), found.filter("reason is not null").select("id", *fields))


def test_values_of_months_by_sentence(spark):
    rows = spark.createDataFrame([(1, "12月3日降水量为5毫米。1月无雨；降水量9毫米。2月和3月降水量-1.5毫米"), (2, None)], "id int, t string")
    got = {tuple(r) for r in extraction.month_values(rows, "id", "t", [1, 2, 3, 12], ["降水量"]).collect()}
    assert got == {(1, 2, 5.0), (1, 12, 5.0), (1, 2, -1.5), (1, 3, -1.5)}


def test_readings_of_repeated_sentences_keep_their_own_times(spark):
    """The same sentence after other days; a range that begins before it."""
    texts = ["7月1日晴。能见度200米。", "7月2日至3日晴。能见度200米。8月9日能见度200米，9日至10日能见度100米。", "能见度200米。5月6日晴。"]
    got = [(r.id, r.time) for r in N.readings(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "id", "t", N.SPECS["visibility"]).orderBy("id", "start").collect()]
    assert got == [(0, "7-1"), (1, "7-2/7-3"), (1, "8-9"), (1, "8-9/8-10"), (2, "5-6")]


def test_candidate_scores_without_pairs(spark, monkeypatch):
    """Shards of three chunks; a case that no query asks for, a zero vector, equal scores."""
    monkeypatch.setattr(retrieval, "CASE_SHARD", 3)
    random.seed(6)
    chunks = [(i % 3, i, [random.uniform(-1, 1) for _ in range(4)]) for i in range(40)] + [(1, 50, [0.0] * 4), (2, 51, [1.0, 0.0, 0.0, 0.0]), (2, 52, [1.0, 0.0, 0.0, 0.0])]
    asked = {7: [1.0, 0.0, 0.0, 0.0], 8: [0.2, -0.4, 0.1, 0.9]}
    pairs = [(7, 0), (7, 2), (8, 1)]
    df = spark.createDataFrame
    made = retrieval.candidate_scores(df(pairs, "query_id long, case_id long"), df(chunks, "case_id long, vec_id long, embedding array<float>"), df(list(asked.items()), "query_id long, query_vector array<float>"), "vec_id")

    def mapped(a, b):
        norm = sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5
        return ((sum(x * y for x, y in zip(a, b)) / norm if norm else 0.0) + 1) / 2

    want = {}
    for q, c in pairs:
        s = sorted((mapped(asked[q], v) for case, _, v in chunks if case == c), reverse=True)
        want[q, c] = (pytest.approx(sum(s[:2]) / 2, abs=1e-5), 4)
    assert {(r.query_id, r.case_id): (r.semantic, r.hits) for r in made.collect()} == want


def test_context_pack_needs_no_python(spark):
    rows = spark.createDataFrame([(d, i, "plain " + "storm " * (i % 5 == d) + "heat " * (i in (6, 17))) for d in (1, 2) for i in range(1, 10 + 10 * d)], "doc long, pos long, t string")
    made = ranking.context_pack(rows, "doc", "pos", "t", {"a": ["storm"]}, ["heat"], 6)
    got = {d: sorted(r.pos for r in made.collect() if r.doc == d) for d in (1, 2)}
    # document 1: 1 and 6 are the best of storm, 6 and 17 of heat; 2 and 7 follow chosen rows
    assert got == {1: [1, 2, 6, 7, 17, 19], 2: [1, 2, 6, 7, 17, 29]}
    assert "Pandas" not in made._jdf.queryExecution().toString()


def test_lines_lose_blanks_only_when_they_merge(spark):
    """A tab or another script's digit is text; a title stands alone; documents (a null one too) do not join; as the fold of the SQL."""
    lines = [(1, 1, "ab\t"), (1, 2, "　cd"), (1, 3, "٣、x"), (1, 4, "3、y"), (1, 5, "z"), (None, 1, "p"), (None, 2, "q "), (2, 1, "\t")]
    rows = spark.createDataFrame([(d, p, 0, t) for d, p, t in lines], "d long, pos long, page long, t string")
    have = sorted(((r.doc or 0, r.chunk_no, r.content) for r in build.merge_lines(rows, "d", "pos", "page", "t").collect()))
    assert have == [(0, 1, "p q"), (1, 1, "ab\t　cd٣、x"), (1, 2, "3、y"), (1, 3, "z"), (2, 1, "\t")]

import random

from caseloom.operators import terms


def plain(text, words):
    """Longest terms blanked out first, of equal length the earlier place."""
    found = [(i, i + len(w), w) for w in words for i in range(len(text)) if text.startswith(w, i)]
    taken, out = set(), []
    for a, z, w in sorted(found, key=lambda x: (x[0] - x[1], x[0])):
        if not taken & set(range(a, z)):
            taken |= set(range(a, z))
            out.append((a, z, w))
    return sorted(out)


def test_longest_first_equals_blanking_out(spark, monkeypatch):
    random.seed(0)
    words = sorted({"".join(random.choices("abc", k=random.randint(1, 4))) for _ in range(30)})
    texts = [(i, "".join(random.choices("abcd", k=random.randint(0, 40)))) for i in range(200)] + [(200, None)]
    rows, known = spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame([(w,) for w in [*words, words[0], ""]], "term string")
    want = {(i, *x) for i, t in texts for x in plain(t or "", words)}
    for most in (1000, 7):  # one automaton, and several passes
        monkeypatch.setattr(terms, "MOST", most)
        got = [tuple(r) for r in terms.occurrences(rows, "id", "t", known).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert terms.occurrences(rows, "id", "t", known.limit(0)).count() == 0
    alone = {tuple(r) for r in terms.occurrences(spark.createDataFrame([(1, "ab abc ab\nb")], "id long, t string"), "id", "t", spark.createDataFrame([("ab",), ("b",)], "term string"), words=True).collect()}
    assert alone == {(1, 0, 2, "ab"), (1, 7, 9, "ab"), (1, 10, 11, "b")}


def grams(t, n, step=1):
    return {t[i : i + n] for i in range(0, len(t) - n + 1, step)} if len(t) >= n else {t}


def test_containment_equals_all_pairs(spark):
    random.seed(1)
    base = ["".join(random.choices("abcdefgh ", k=60)) for _ in range(20)]
    items = [(i, b) for i, b in enumerate(base)] + [(20, "abc"), (21, ""), (22, None), (23, base[0])]
    texts = [(i, "x" * 9 + b[: random.randint(10, 60)] + "".join(random.choices("abcdefgh ", k=50)) + "common piece") for i, b in enumerate(base * 5)] + [(100, None), (101, "")]
    got = {(r.i, r.k): round(r.share, 9) for r in terms.gram_containment(spark.createDataFrame(items, "i long, t string"), "i", "t", spark.createDataFrame(texts, "k long, t string"), "k", "t", 8, 4, 0.5).collect()}
    want = {}
    for i, a in items:
        for k, b in texts:
            g = grams(a or "", 8, 4) - {""}
            hits = sum(x in (b or "") for x in g)
            if g and hits / len(g) >= 0.5:
                want[i, k] = round(hits / len(g), 9)
    assert got == want and len(want) > 30


def test_related_texts(spark):
    items = [("d", 1, "the quick brown fox jumps over the lazy dog and then it runs away"), ("d", 2, "zzz"), ("e", 1, "the quick brown fox"), ("d", 3, None)]
    texts = [("d", 10, "x the quick brown fox\njumps over the lazy dog and then it runs away home"), ("d", 11, "the quick brown fox sleeps"), ("d", 12, "qqq"), ("d", 13, "lazy dog"), ("d", 14, "over the lazy dog"), ("d", 15, "and then it runs")]
    got = [tuple(r) for r in terms.related(spark.createDataFrame(items, "doc string, i long, t string"), "i", "t", spark.createDataFrame(texts, "doc string, k long, t string"), "k", "t", ["doc"]).orderBy("i", "rank").collect()]
    assert [x[:3] for x in got] == [("d", 1, 10), ("d", 1, 13), ("d", 1, 14), ("d", 1, 15)] and got[0][3:] == (1.0, 1)

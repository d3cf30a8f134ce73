import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from caseloom.llm import simhash as S

from .data import docs, empty, odd


def plain(text, k=3):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps, radius=3):
    label = list(range(len(fps)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = sorted((top(i), top(j)))
                label[b] = a
    return [top(i) for i in range(len(fps))]


def test_fingerprint():
    for t in ("", "a", "a b", "A b C d", "Ünï cODE x y\x0bz", "x " * 500):
        assert S.simhash(t.encode(), 3) == plain(t), t


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**32), st.integers(2, 400), st.integers(1, 40))
def test_tree_loses_no_link(seed, n, centres):
    r = np.random.default_rng(seed)
    fp = r.integers(0, 2**63, centres, dtype=np.uint64)[r.integers(0, centres, n)]
    for _ in range(3):
        fp ^= np.uint64(1) << r.integers(0, 64, n, dtype=np.uint64)
    fp = np.unique(fp)
    tree = S.VantageTree(fp, len(fp), 3, shard_rows=20)
    links = []
    for _, rows in tree.route(fp):
        a, b = S.shard_links(fp[rows], 3)
        links += list(zip(rows[a].tolist(), rows[b].tolist()))
    label = S._least(np.array([a for a, _ in links], int), np.array([b for _, b in links], int), len(fp))
    assert label.tolist() == groups([int(x) for x in fp])


def test_components_of_texts(spark):
    rows = odd(spark)
    got = {(r.doc_id, r.fp): r.component_id for r in S.near_duplicates(rows).collect()}
    known = sorted({r.doc_id: r.text for r in rows.collect() if r.doc_id is not None}.items())
    fps = [plain(t) for _, t in known]
    for (i, _), f, g in zip(known, fps, groups(fps)):
        assert got[(i, f - (1 << 64) if f >> 63 else f)] == known[g][0]
    assert got[(None, 0)] == 1
    assert S.near_duplicates(empty(spark)).count() == 0


def test_chain_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101)], "a long, b long")
    assert {(r.id, r.component) for r in S.components(links).collect()} == {(i, 0) for i in range(1, 41)} | {(101, 100)}


def test_near_copies_by_words(spark):
    r = np.random.default_rng(0)
    words = [f"w{i}" for i in range(5000)]
    base = [r.choice(words, 120).tolist() for _ in range(20)]
    near = [w[:60] + ["changed"] + w[61:] for w in base]  # 5 of 116 shingles differ
    far = [[*w[:20], *r.choice(words, 100).tolist()] for w in base]
    texts = [" ".join(w) for w in base + near + far]
    got = {x.doc_id: x.component_id for x in S.near_duplicate_groups(docs(spark, [*texts, texts[0], None, ""])).collect()}
    for i in range(20):
        assert got[20 + i] == i and got[40 + i] == 40 + i
    assert got[60] == 0 and got[62] == 61
    assert S.near_duplicate_groups(empty(spark)).count() == 0


@pytest.mark.parametrize("leads", [0, 1])
def test_near_copies_with_a_common_core(spark, monkeypatch, leads):
    """Families that share most shingles: only mates and a few chance pairs are similar, in buckets large and small."""
    monkeypatch.setattr(S, "LIGHT", 3)
    monkeypatch.setattr(S, "LEADS", leads)
    k, texts = 5, []
    r = np.random.default_rng(3)
    for size in (60, 25):
        core = " ".join(f"core{size}-{i}" for i in range(178))  # 174 shingles
        for i in range(0, size, 2):
            mates = " ".join(f"m{size}-{i}-{j}" for j in range(16))  # 12 shingles
            texts += [f"{core} \n {mates} " + " ".join(f"u{size}-{i}-{x}-{j}" for j in range(int(r.integers(8, 14)))) for x in range(2)]
    words = [f"w{i}" for i in range(9000)]
    for _ in range(4):  # long texts: 300 to 900 shingles, changed at some places
        base = r.choice(words, int(r.integers(300, 900))).tolist()
        for share in (0.01, 0.02, 0.024, 0.026, 0.04):
            texts.append(" ".join(f"x{r.integers(1e9)}" if r.random() < share else w for w in base))
    sets = [set(S._shingle_hashes(t.encode(), k).tolist()) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    got = {x.doc_id: x.component_id for x in S.near_duplicate_groups(docs(spark, texts), k, 0.8, radius=0).collect()}
    assert [got[i] for i in range(len(texts))] == label
    assert len(set(label)) > 20


def test_recall_of_a_thousand_pairs_just_above_the_threshold(spark):
    """Pairs of similarity 0.80 to 0.85 are all joined, and pairs just below are not."""
    r = np.random.default_rng(12)
    texts, similarity = [], []
    while len(texts) < 3600:
        words = [f"w{x}" for x in r.integers(0, 20_000, int(r.integers(60, 400)))]
        other = list(words)
        for _ in range(max(1, round(len(words) * r.uniform(0.018, 0.026)))):
            other[int(r.integers(len(other)))] = f"x{r.integers(10**9)}"
        a, b = (set(S._shingle_hashes(" ".join(w).encode(), 5).tolist()) for w in (words, other))
        j = len(a & b) / len(a | b)
        if 0.76 <= j <= 0.85:
            texts += [" ".join(words), " ".join(other)]
            similarity.append(j)
    got = {x.doc_id: x.component_id for x in S.near_duplicate_groups(docs(spark, texts), 5, 0.8, radius=0).collect()}
    joined = [got[2 * i] == got[2 * i + 1] for i in range(1800)]
    assert sum(j >= 0.8 for j in similarity) >= 1000
    assert joined == [j >= 0.8 for j in similarity]


def test_wide_bitmaps_differ_in_no_more_bits_than_sets_in_shingles(spark):
    r = np.random.default_rng(4)
    rows, far = [], 0
    for both, one, other in [(0, 0, 0), (1, 0, 0), (0, 1, 2), (256, 0, 1), (512, 1, 0), (0, 300, 5), (0, 2000, 2000), *r.integers(0, 2500, (150, 3)).tolist()]:
        h = r.permutation(np.unique(r.integers(0, 2**64, both + one + other, dtype=np.uint64)))
        x, y = np.sort(h[: both + one]), np.sort(np.concatenate((h[:both], h[both + one :])))
        rows.append((len(x), len(y), len(np.setxor1d(x, y)), S._wide(x).tolist(), S._wide(y).tolist()))
    found = spark.createDataFrame(rows, "m long, n long, differ long, x array<long>, y array<long>").select("m", "n", "differ", S._apart(S.F.col("x"), S.F.col("y")).alias("apart")).collect()
    assert all(f.apart <= f.differ for f in found)
    for f in found:
        if f.differ > 0.5 * (f.m + f.n) > 300 and 0.8 * max(f.m, f.n) <= min(f.m, f.n):
            far += 1
            assert f.apart > 0.2 / 1.8 * (f.m + f.n)  # far from similar, and the bitmaps show it
    assert far > 10


def test_texts_that_cannot_be_similar_do_not_meet(spark, monkeypatch):
    """Long texts share a few frequent lines: their bitmaps part them before any text is shuffled."""
    r = np.random.default_rng(5)
    lines = [" ".join(f"line{i}-{j}" for j in range(9)) for i in range(3)]
    texts = ["\n".join([lines[i % 3], " ".join(f"w{x}" for x in r.integers(0, 10**9, 1500)), lines[i % 2]]) for i in range(40)]
    texts.append(texts[7] + " one more end")
    rows = S.id_text(docs(spark, texts)).withColumn("body", S.F.xxhash64("text"))
    sets = [S._shingle_hashes(t.encode(), 5) for t in texts]
    body = {x.doc_id: x.body for x in rows.collect()}
    nodes = spark.createDataFrame([(body[i], i, len(h), S._wide(h).tolist()) for i, h in enumerate(sets)], "body long, id long, n int, wide array<long>")
    pairs = spark.createDataFrame([(body[i], body[j]) for i in range(41) for j in range(i)], "a long, b long")
    read = {}

    def told(df, tag):
        out = materialize(df, tag)
        read[tag] = out.count()
        return out

    materialize = S.materialize
    monkeypatch.setattr(S, "materialize", told)
    assert {frozenset(x) for x in S._similar(pairs, nodes, rows, 5, 0.8).collect()} == {frozenset((body[7], body[40]))}
    assert read["pairs"] == 820 and read["texts"] == 2


def test_the_sample_that_orders_shingles_grows_with_the_table(spark, monkeypatch):
    """A line in one text of 20 is known as frequent, however small the least sample is."""
    monkeypatch.setattr(S, "ORDER_SAMPLE", 10)
    line = " ".join(f"often{j}" for j in range(7))
    texts = [" ".join(f"t{i}-{j}" for j in range(30)) + ("\n" + line if i % 20 == 0 else "") for i in range(4800)]
    rows = S.id_text(docs(spark, texts)).withColumn("body", S.F.xxhash64("text"))
    known, counts = S._common(rows, 5)
    assert set(S._shingle_hashes(line.encode(), 5).tolist()) <= set(known.tolist()) and counts.min() >= 2


def test_near_dedup_leaves_only_the_tables_of_its_result(spark):
    """Tables of the phases go when they are read for the last time, shuffle files with the query that wrote them."""
    import os

    words = [f"w{i}" for i in range(3000)]
    r = np.random.default_rng(8)
    texts = [" ".join(r.choice(words, 150)) for _ in range(60)]
    texts += [t + " tail" for t in texts[:20]] + [f"{texts[0]} {' '.join(r.choice(words, 9))}" for _ in range(60)]
    shuffled = lambda: {x.rsplit("/", 1)[-1] for x in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}
    home = S.materialize.__globals__["shared_dir"](spark).removeprefix("file://")
    before, files = set(os.listdir(home)), shuffled()
    found = S.near_duplicate_groups(docs(spark, texts))
    assert {x.rsplit("-", 1)[0] for x in set(os.listdir(home)) - before} == {"ids", "groups"}
    assert len(shuffled() - files) <= 16, "a materialized table leaves its shuffle files"
    got = {x.doc_id: x.component_id for x in found.collect()}
    assert len(got) == 140 and all(got[60 + i] == i for i in range(20)) and all(got[i] == 0 for i in range(80, 140))

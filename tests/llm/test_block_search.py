import math

import numpy as np
import pytest

from caseloom.llm import block_search as B
from caseloom.llm import queries as Q

from ..conftest import SMALL


def plain(rows, every=50, k=5, scale=256):
    whole = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(whole):
        if i is None or i % every:
            continue
        scores = [(-max(1 - 2**63, min(2**63 - 1, sum(a * b for a, b in zip(q, v)))), j is None, j or 0) for m, (j, v) in enumerate(whole) if m != n]
        out += [(i, r + 1, None if null else j, -s) for r, (s, null, j) in enumerate(sorted(scores)[:k])]
    return out


def write(spark, path, rows, parts=3):
    spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, at int, block string").repartition(parts).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def same(got, rows):
    return sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, plain(rows)))


def test_query_equals_plain_search(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert same(Q.op11_block_search(spark, SMALL).collect(), rows)


def test_ties_repeats_nulls_and_odd_vectors(spark, tmp_path):
    random = np.random.default_rng(1)
    rows = [(i, [float(x) for x in random.integers(-2, 3, 4) / 4]) for i in range(700)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(700, 1100)]  # a third alike
    rows += [(None, [9.0, 9.0, 9.0, 9.0]), (50, [1.0, 1.0, 1.0, 1.0]), (50, [1.0, 1.0, 1.0, 1.0]), (1150, None), (1200, [None, 1.0, 1.0, 1.0]), (1250, [float("nan")] * 4), (1300, [float("inf"), 0.0, 0.0, 0.0])]
    rows += [(1350, []), (1400, [1.0]), (1401, [1.0] * 6), (-50, [0.25, -0.25, 0.25, -0.25])]
    assert same(Q.op11_block_search(spark, write(spark, tmp_path / "a", rows)).collect(), rows)


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 2.0])], [(0, [1.0]), (50, [2.0]), (3, [-1.0])], [(0, [1e30, 1e20]), (50, [-3e25, 1.0]), (1, [2.0**30, 5.0]), (2, [1e38, 1e38])]])
def test_few_rows_and_huge_numbers(spark, tmp_path, rows):
    assert same(Q.op11_block_search(spark, write(spark, tmp_path / "b", rows, 1)).collect(), rows)


def test_blocks_below_the_kth_score_are_left_out():
    random = np.random.default_rng(2)
    centres = random.normal(size=(16, 32)) * 100
    m = np.floor(np.concatenate([c + random.normal(size=(B.BLOCK, 32)) for c in centres]))
    cuts = np.arange(0, len(m), B.BLOCK)
    high, low = np.maximum.reduceat(m, cuts), np.minimum.reduceat(m, cuts)
    q = np.floor(centres + random.normal(size=centres.shape))
    whose, rows, values, scored = B.search(q, np.full(16, -1), np.full(16, B.LEAST), m, high, low, 5)
    s = (q @ m.T).astype(int)
    for i in range(16):
        got = sorted(values[whose == i])[-5:]
        assert got == sorted(s[i])[-5:]
    assert scored < 16 * 16 / 4  # of 256 pairs of query and block
    assert (B.bounds(q, high, low)[:, :, None] >= s.reshape(16, 16, -1)).all()


def test_similar_vectors_share_a_cell():
    random = np.random.default_rng(3)
    centres = random.normal(size=(8, 16)) * 50
    which = random.integers(0, 8, 4000)
    m = centres[which] + random.normal(size=(4000, 16))
    at = B.cells(m, B.bisections(m, 3))
    assert at.min() >= 0 and at.max() < 8
    assert np.mean([np.bincount(which[at == c]).max() / max(1, (at == c).sum()) for c in np.unique(at)]) > 0.6

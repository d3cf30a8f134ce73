import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from caseloom.llm import suffix_dedup as D

from .data import docs, empty, odd


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=80))
def test_suffix_array(t):
    t = np.array([*t, 0], np.int16)
    assert D.suffix_array(t, 258).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def brute(rows, length):
    first, out = {}, []
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for i, t in rows:
        b, n = (t or "").encode(), len((t or "").encode())
        for k in range(n - length + 1 if i is not None else 0):
            first.setdefault(b[k : k + length], i)
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1 if i is not None else 0):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = True
        left = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    r = np.random.default_rng(11)
    words = ["alpha", "beta", "gamma", "é", "delta", "\n", "ooooooooooooooo"]
    passage = " ".join(r.choice(words, 60))
    texts = []
    for i in range(60):
        own = " ".join(r.choice(words, int(r.integers(0, 120))))
        texts.append(own + (passage[i % 7 :] + own if i % 3 == 0 else "") + ("o" * 200 if i % 5 == 0 else ""))
    ids = [int(x) for x in r.permutation(2000)[:60]]
    rows = docs(spark, [*texts, texts[0], texts[1], None], [*ids, 3000, ids[0], 5000])
    got = sorted((tuple(x) for x in D.removed(rows, 50).collect()), key=str)
    assert got == brute([(x.doc_id, x.text) for x in rows.collect()], 50)


def test_edges(spark):
    rows = odd(spark)
    got = sorted((tuple(x) for x in D.removed(rows, 50).collect()), key=str)
    assert got == brute([(x.doc_id, x.text) for x in rows.collect()], 50)
    assert D.removed(empty(spark), 50).count() == 0


def test_long_documents_are_read_in_parts(monkeypatch):
    monkeypatch.setattr(D, "CHUNK", 1000)
    r = np.random.default_rng(2)
    text = bytes(r.integers(97, 101, 5000).astype(np.uint8))
    whole = D.cells(np.frombuffer(text, np.uint8), np.array([len(text)]), 50)
    starts = np.concatenate([np.arange(a, z + 1) for _, _, _, first, last, _ in D.all_cells([text], 50) for a, z in zip(first, last)])
    assert sorted(starts.tolist()) == list(range(len(text) - 49)) and len(whole[0])
    key = {}
    for _, _, _, first, last, h in D.all_cells([text, text], 50):
        for a, z, k in zip(first, last, h):
            for s in range(a, z + 1):
                key.setdefault(s % len(text), set()).add(int(k))
    assert all(len(v) == 1 for v in key.values())


def test_recursion_and_common_prefixes_on_repetitive_strings():
    import numpy as np

    from caseloom.llm import suffix_dedup as S

    r = np.random.default_rng(5)
    for n, k in [(1, 2), (40, 2), (300, 3), (800, 3), (600, 500)]:
        for _ in range(10):
            t = np.append(np.tile(r.integers(1, k, max(1, n // 4)), 4), 0)
            want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
            assert S.suffix_array(t, k).tolist() == want
            waves, S.WAVES = S.WAVES, 0  # both ways of inducing, at every level
            assert S.suffix_array(t, k).tolist() == want
            S.WAVES = waves
    raw = bytes(r.integers(97, 99, 400, dtype=np.uint8)) * 2
    text = np.frombuffer(raw + b"\0" * 8, np.uint8)
    a, b = r.integers(0, 700, 300), r.integers(0, 700, 300)
    plain = [next((i for i in range(50) if raw[x + i : x + i + 1] != raw[y + i : y + i + 1]), 50) for x, y in zip(a.tolist(), b.tolist())]
    assert S._common(text, a, b, 50).tolist() == plain


def test_a_shard_is_sorted_in_parts_of_whole_anchors():
    """Every text that shares its anchor is in one part, all of an anchor together, parts are bounded where anchors are."""
    random = np.random.default_rng(5)
    anchor, sizes = random.integers(0, 400, 1000).astype(np.uint64), random.integers(50, 90, 1000)
    parts = list(D.together(anchor, sizes, 2000))
    alone = np.isin(anchor, [k for k, n in zip(*np.unique(anchor, return_counts=True)) if n == 1])
    assert sorted(np.concatenate(parts).tolist()) == np.flatnonzero(~alone).tolist() and len(parts) > 20
    of = [set(anchor[p].tolist()) for p in parts]
    assert sum(map(len, of)) == len(set.union(*of)) and max(sizes[p].sum() for p in parts) < 2000 + 90 * 15
    assert list(D.together(np.arange(5, dtype=np.uint64), sizes[:5])) == []


def test_only_texts_that_may_share_a_string_are_sorted():
    """Texts that alone have a long core around their anchor are in no suffix array; whoever shares a string is in one."""
    random = np.random.default_rng(8)
    stem = bytes(random.integers(97, 123, 84).astype(np.uint8))
    anchor = {}
    for cut in range(0, 35):  # the same string of 50 bytes, with its anchor at each place, in two texts
        for k in range(2):
            text = bytes(random.integers(97, 123, 40).astype(np.uint8)) + stem[cut : cut + 50] + bytes(random.integers(97, 123, 40).astype(np.uint8))
            for _, data, _, first, last, h in D.all_cells([text], 50):
                anchor |= {data[a : z + 50]: int(x) for a, z, x in zip(first.tolist(), last.tolist(), h.tolist())}
    for _ in range(300):  # texts with the anchor of another, and little else of it
        text = bytes(random.integers(97, 123, 34).astype(np.uint8)) + stem[34:50] + bytes(random.integers(97, 123, 34).astype(np.uint8))
        for _, data, _, first, last, h in D.all_cells([text], 50):
            anchor |= {data[a : z + 50]: int(x) for a, z, x in zip(first.tolist(), last.tolist(), h.tolist())}
    texts, anchors = list(anchor), np.array(list(anchor.values()), np.uint64)
    of = {}
    for k, t in enumerate(texts):
        for i in range(len(t) - 49):
            of.setdefault(t[i : i + 50], set()).add(k)
    share = set().union(*[x for x in of.values() if len(x) > 1])
    may = set(D.meeting(texts, anchors, 50).tolist())
    several = sum(n for n in np.unique(anchors, return_counts=True)[1] if n > 1)
    assert share <= may and len(share) > 30 and len(may) < several / 2
    assert D.meeting([], np.empty(0, np.uint64), 50).tolist() == []

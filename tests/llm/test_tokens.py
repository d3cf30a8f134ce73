import random
import zlib

import numpy as np
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

from caseloom.llm.packing import B, GAP, K1, QUERY_IDS, Shard, pack, pack_shard
from caseloom.llm.token_counts import count_tokens
from caseloom.llm.token_files import read_token_files, write_token_files
from caseloom.llm.tokens import PieceCounts, TokenEncoder

from .data import docs, empty, odd

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ALPHABET = " \n\t\r\x1c\x1f\x85 　aB1é'tsm.,!<|日٣²​"


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_ids_and_counts_equal_the_library():
    enc, r = TokenEncoder(PATH), random.Random(1)
    whole, every = enc.prove_whole_tokens()
    assert every
    counts = PieceCounts(enc, whole, most=500)
    for _ in range(3000):
        text = "".join(r.choice(ALPHABET) for _ in range(r.randint(0, 14)))
        assert enc.ids(text) == library(text), repr(text)
        assert sum(map(counts.__getitem__, enc._pieces(text))) == len(library(text)), repr(text)
    for text in ("a<|endoftext|> b", "<|endoftext|><|endoftext|>", "I'll  go"):
        assert enc.ids(text) == library(text)
    assert len(whole) > 40_000


def test_counts(spark):
    rows = odd(spark).unionAll(docs(spark, ["a<|endoftext|> b"], [9]))
    for r in count_tokens(rows, PATH).join(rows.select("doc_id", "text"), "doc_id").collect():
        assert (r.n_bytes, r.n_tokens) == (len((r.text or "").encode()), len(library(r.text)))
    assert count_tokens(rows, PATH).count() == 10
    assert count_tokens(empty(spark), PATH).count() == 0


def test_files_round_trip(spark, tmp_path):
    rows = odd(spark)
    shards = write_token_files(rows, str(tmp_path / "a"), PATH, 2)
    got = sorted(read_token_files(spark, str(tmp_path / "a"), shards, 2).collect(), key=lambda r: r.start)
    want = sorted(((r.doc_id, r.text or "") for r in rows.collect()), key=lambda x: (x[0] is not None, x[0] or 0, xxhash.xxh64_intdigest(x[1].encode(), 42) - (xxhash.xxh64_intdigest(x[1].encode(), 42) >> 63 << 64)))
    at = 0
    for g, (i, text) in zip(got, want, strict=True):
        ids = np.array([*library(text), 2], "<u4")
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert write_token_files(empty(spark), str(tmp_path / "b"), PATH, 2) == []
    assert read_token_files(spark, str(tmp_path / "b"), [], 2).count() == 0


def test_packing_keeps_every_id_once(spark):
    rows = odd(spark).filter("doc_id is not null").dropDuplicates(["doc_id"])
    texts = {r.doc_id: r.text for r in rows.collect()}
    pieces = pack(rows, PATH, window=128).collect()
    for i, text in texts.items():
        ids, at = np.array([*library(text), 0], "<u4"), 0
        for p in sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes()) and p.doc_tokens == len(ids)
            at += p.length
        assert at == len(ids)
    by_sequence = {}
    for p in sorted(pieces, key=lambda p: p.offset):
        assert p.offset == by_sequence.get(p.sequence_id, 0)
        by_sequence[p.sequence_id] = p.offset + p.length
    assert max(by_sequence.values()) <= 128
    assert pack(odd(spark), PATH).filter("doc_id is null").count() == 1
    assert pack(empty(spark), PATH).count() == 0


def test_neighbours_share_terms():
    a, b = np.arange(100, 140, dtype=np.uint16), np.arange(300, 340, dtype=np.uint16)
    pieces = [a, b, a[:30], b[:30], a[5:], b[5:]]
    rows = pack_shard(pieces, np.ones(400, np.float32), 40.0, 128)
    assert {p % 2 for p, _, _ in rows[0][:3]} == {0}
    assert sum(j - i for r in rows for _, i, j in r) == sum(map(len, pieces))


def test_entries_out_of_reach_of_the_merges(spark, tmp_path):
    """A vocabulary with "abc" but no merge that makes it: the proof leaves it out, and counts follow the library."""
    import json

    from caseloom.llm.tokens import _byte_of_char

    letters = sorted(_byte_of_char(), key=_byte_of_char().get)
    vocab = {c: i for i, c in enumerate(letters)} | {"ab": 256, "bc": 257, "abc": 258, "abab": 259}
    model = {"type": "BPE", "vocab": vocab, "merges": ["a b", "b c", "ab ab"], "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    path = str(tmp_path / "toy.json")
    with open(path, "w") as f:
        json.dump({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": level, "post_processor": None, "decoder": level, "model": model}, f)
    toy = Tokenizer.from_file(path)
    assert toy.encode("abc").ids == [256, vocab["c"]]
    whole, every = TokenEncoder(path).prove_whole_tokens()
    assert "abc" not in whole and {"ab", "bc", "abab"} <= whole and not every
    texts = ["abc", "abab abc", "xabcab", "bc"]
    got = {r.doc_id: r.n_tokens for r in count_tokens(docs(spark, texts), path).collect()}
    assert got == {i: len(toy.encode(t).ids) for i, t in enumerate(texts)}
    shards = write_token_files(docs(spark, texts), str(tmp_path / "toy"), path, 2)
    files = {r.doc_id: r.n_tokens for r in read_token_files(spark, str(tmp_path / "toy"), shards, 2).collect()}
    assert files == {i: n + 1 for i, n in got.items()}


def test_neighbours_equal_a_plain_bm25():
    r = np.random.default_rng(6)
    pieces = [(r.zipf(1.4, int(r.integers(1, 60))) % 300).astype(np.uint16) for _ in range(300)]
    idf = r.random(400).astype(np.float32) * 5
    shard = Shard(pieces, idf, 30.0)
    shard.free[r.integers(0, 300, 60)] = False

    def weight(t, p):
        tf = int((p == t).sum())
        return idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(p) / 30.0))

    for seed in range(0, 300, 7):
        query = sorted({int(t) for t in pieces[seed]}, key=lambda t: (-weight(t, pieces[seed]), t))[:QUERY_IDS]
        plain = {i: sum(weight(t, p) for t in query) for i, p in enumerate(pieces) if shard.free[i]}
        got = [plain[int(i)] for i in shard.neighbours(seed)]
        want = sorted((x for x in plain.values() if x > 0), reverse=True)[:64]
        assert np.allclose(got, want, rtol=1e-4)


def test_short_pieces_take_all_neighbours_before_others():
    a, b = ([np.array([base + i % 5, base + 7], np.uint16) for i in range(400)] for base in (10, 50))
    rows = pack_shard([x for pair in zip(a, b) for x in pair], np.ones(100, np.float32), 2.0, 512)
    assert {p % 2 for p, _, _ in rows[0]} == {0} and sum(j - i for _, i, j in rows[0]) >= 512 - GAP

"""Removal of byte strings that an earlier document has, by sharded suffix arrays (operator 8).

A byte goes if a ``length``-byte string over it also starts in a document of smaller doc_id. Every
such string holds exactly one *anchor*: the least-ranked ``GRAM``-byte substring, a function of the
string alone. So strings that are equal share an anchor, and only anchors' neighbourhoods must meet:

1. ``anchors``: documents are read in blocks (doc_id // ``BLOCK``); a block sends each different
   anchor hash once to the hash's shard, packed into one row for each shard.
2. ``shared``: a shard returns to the blocks the hashes that occur in two documents or more.
3. ``segments``: a block sends the text around shared anchors, each different text once, with the
   least doc_id that has it there.
4. A shard sets texts aside that agree with no other for long enough around their anchor, concatenates the others, whole anchors of about ``TOGETHER`` bytes at a time, and builds their suffix array by induced sorting:
   suffixes are classified, the leftmost-smaller substrings are sorted by a first induction and
   the string of their names is sorted in the same way, recursively, and all suffixes are induced from them, bucket by bucket.
   Common prefixes of neighbours, permuted to text order and cut at ``length``, give the classes of equal
   strings, and their least doc_id goes back to the blocks that sent them.
5. ``removed``: blocks mark the bytes and hash what is left.

Texts cross the network compressed. A key that every document has costs each block one entry.
Defined results: null and empty texts have nothing to remove; very long texts are read in parts that overlap; other
columns are ignored; equal texts lose all but the least doc_id's; rows with a null doc_id are neither
cut nor a reason to cut; rows that share a doc_id do not cut each other; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, materialize, sliced

GRAM, BLOCK = 16, 256
CHUNK = 1 << 17  # bytes whose anchors are found at once: their arrays stay in a core's cache
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

# --- anchors ---------------------------------------------------------------------------------------------------

_BYTE = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POS_BITS = np.uint64(23)


def _grams(raw: np.ndarray) -> np.ndarray:
    """Hashes of the ``GRAM``-byte substrings."""
    h, span = _BYTE[raw], 1
    while span < GRAM:
        h = h[:-span] * np.uint64(0x9E3779B97F4A7C15 ^ span) + h[span:]
        span *= 2
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def cells(raw: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, last start, anchor hash) of the runs of strings with a common anchor.

    raw: bytes of documents one after the other; bounds: their ends. No string crosses a bound.
    """
    n = len(raw)
    if n < length:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
    h = _grams(raw)
    mask = (np.uint64(1) << _POS_BITS) - np.uint64(1)
    key = (h & ~mask) | np.arange(len(h), dtype=np.uint64)  # the hash's upper bits, ties to the left
    width, have = length - GRAM + 1, 1
    while 2 * have <= width:
        key, have = np.minimum(key[:-have], key[have:]), 2 * have
    if have < width:
        key = np.minimum(key[: len(key) - (width - have)], key[width - have :])
    at = (key & mask).astype(np.int64)
    doc = np.repeat(np.arange(len(bounds), dtype=np.int32), np.diff(np.minimum(bounds, n), prepend=0))
    ok = doc[: len(at)] == doc[length - 1 :]
    new = np.empty(len(at), bool)
    new[0] = True
    new[1:] = (at[1:] != at[:-1]) | (ok[1:] != ok[:-1]) | (doc[1 : len(at)] != doc[: len(at) - 1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    good = ok[first]
    return first[good], last[good], h[at[first[good]]]


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """(number of the first document, bytes, ends) of runs of documents; a longer document comes alone."""
    i = 0
    while i < len(texts):
        j, size = i + 1, len(texts[i])
        while j < len(texts) and size + len(texts[j]) <= CHUNK:
            size, j = size + len(texts[j]), j + 1
        yield i, b"".join(texts[i:j]), np.cumsum([len(t) for t in texts[i:j]])
        i = j


def all_cells(texts: list[bytes], length: int) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first document, bytes, ends, first starts, last starts, hashes) of each chunk; very long documents in parts."""
    for i, data, bounds in _chunks(texts):
        raw = np.frombuffer(data, np.uint8)
        for a in range(0, max(1, len(raw) - length + 1), CHUNK):
            part = raw[a : a + CHUNK + length - 1]
            first, last, h = cells(part, bounds - a, length)
            yield i, data, bounds, first + a, last + a, h


def _runs(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """at[0], at[0] + 1 and so on, size[0] of them, then those of the next."""
    return np.arange(size.sum()) + np.repeat(at - (np.cumsum(size) - size), size)


# --- suffix arrays by induced sorting ----------------------------------------------------------------------------


def _spread(into: list[list[np.ndarray]], rows: np.ndarray, symbols: np.ndarray) -> None:
    if len(rows):
        order = np.argsort(symbols, kind="stable")
        rows, symbols = rows[order], symbols[order]
        cut = np.flatnonzero(np.diff(symbols)) + 1
        for part, s in zip(np.split(rows, cut), symbols[np.concatenate(([0], cut))]):
            into[s].append(part)


def _induce(t: np.ndarray, smaller: np.ndarray, lms: np.ndarray, n_symbols: int) -> np.ndarray:
    """The suffix array that sorted leftmost-smaller suffixes induce; whole waves of a bucket at once."""
    none = np.empty(0, np.int64)
    by_symbol = np.split(lms, np.searchsorted(t[lms], np.arange(1, n_symbols)))
    larger_in: list[list[np.ndarray]] = [[] for _ in range(n_symbols)]
    smaller_in: list[list[np.ndarray]] = [[] for _ in range(n_symbols)]
    smaller_in[0].append(np.array([len(t) - 1]))  # the end itself follows from nothing
    larger: list[np.ndarray] = []
    for c in range(n_symbols):
        parts = list(larger_in[c])
        wave = np.concatenate(parts) if parts else none
        while len(wave):
            before = wave[wave > 0] - 1
            wave = before[(t[before] == c) & ~smaller[before]]
            parts.append(wave)
        larger.append(np.concatenate(parts) if parts else none)
        both = np.concatenate((larger[c], by_symbol[c]))
        before = both[both > 0] - 1
        before = before[(t[before] > c) & ~smaller[before]]
        _spread(larger_in, before, t[before])
    out: list[np.ndarray] = []
    for c in reversed(range(n_symbols)):
        parts = list(smaller_in[c])
        wave = np.concatenate(parts) if parts else none
        while len(wave):
            before = wave[wave > 0] - 1
            wave = before[(t[before] == c) & smaller[before]]
            parts.append(wave)
        mine = np.concatenate(parts) if parts else none
        both = np.concatenate((mine, larger[c][::-1]))
        before = both[both > 0] - 1
        before = before[(t[before] < c) & smaller[before]]
        _spread(smaller_in, before, t[before])
        out.append(np.concatenate((larger[c], mine[::-1])))
    return np.concatenate(out[::-1])


def _induce_each(t: np.ndarray, smaller: np.ndarray, lms: np.ndarray, n_symbols: int) -> np.ndarray:
    """As _induce, suffix by suffix with a pointer for each bucket: for reduced strings, whose symbols are many and their waves short."""
    ends = np.cumsum(np.bincount(t, minlength=n_symbols))
    sa = np.full(len(t), -1, np.int64)
    # sorted leftmost-smaller suffixes stand at the ends of their buckets
    symbols = t[lms]
    order = np.argsort(symbols, kind="stable")
    left = np.searchsorted(symbols[order], symbols[order], "right")
    sa[ends[symbols[order]] - (left - np.arange(len(lms)))] = lms[order]
    sa = sa.tolist()
    # by suffix: the symbol before it, if the suffix that begins there is larger (smaller); entry -1 stands for no suffix
    first = np.append(np.concatenate(([-1], t[:-1])), -1)
    before_larger = np.where(np.concatenate(([False], ~smaller[:-1], [False])), first, -1).tolist()
    before_smaller = np.where(np.concatenate(([False], smaller[:-1], [False])), first, -1).tolist()
    head = np.concatenate(([0], ends[:-1])).tolist()
    for p in sa:
        c = before_larger[p]
        if c >= 0:
            sa[head[c]] = p - 1
            head[c] += 1
    tail = ends.tolist()
    for at in range(len(sa) - 1, -1, -1):
        c = before_smaller[sa[at]]
        if c >= 0:
            tail[c] -= 1
            sa[tail[c]] = sa[at] - 1
    return np.array(sa, np.int64)


WAVES = 1024  # symbols up to which whole waves of a bucket are induced at once


def suffix_array(t: np.ndarray, n_symbols: int) -> np.ndarray:
    """Suffix array of symbols t, of which the last is 0 and the only 0; all symbols are below n_symbols."""
    n, induce = len(t), _induce if n_symbols <= WAVES else _induce_each
    if n == 1:
        return np.zeros(1, np.int64)
    differ = np.flatnonzero(t[:-1] != t[1:])
    to = differ[np.searchsorted(differ, np.arange(n - 1))]
    smaller = np.append(t[to] < t[to + 1], True)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if len(lms) > 1:
        first = induce(t, smaller, lms[np.argsort(t[lms], kind="stable")], n_symbols)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        order = first[is_lms[first]]  # sorted by leftmost-smaller substring
        size = np.append(np.diff(lms) + 1, 1)[np.searchsorted(lms, order)]
        same = size[1:] == size[:-1]
        for k in range(int(size.max())):
            look = np.flatnonzero(same & (size[1:] > k))
            if not len(look):
                break
            same[look] = (t[order[1:][look] + k] == t[order[:-1][look] + k]) & (smaller[order[1:][look] + k] == smaller[order[:-1][look] + k])
        name = np.empty(n, np.int64)
        name[order] = np.concatenate(([0], np.cumsum(~same)))
        names, reduced = len(order) - int(same.sum()), name[lms]  # the end is a leftmost-smaller suffix of its own, so the last name is 0
        # names that all differ are the order; others are a string to sort in the same way
        lms = lms[np.argsort(reduced) if names == len(reduced) else suffix_array(reduced, names)]
    return induce(t, smaller, lms, n_symbols)


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Lengths of the common prefixes of suffixes a and b, up to most; eight bytes at a time. text ends with eight bytes more."""
    words = np.ndarray(len(text) - 7, "<u8", text, strides=(1,))
    out, left = np.full(len(a), most), np.arange(len(a))
    for k in range(0, most, 8):
        k = min(k, most - 8)
        odd = words[a[left] + k] ^ words[b[left] + k]
        bad = odd != 0
        low = odd[bad] & (~odd[bad] + np.uint64(1))  # the lowest bit that differs
        out[left[bad]] = k + np.log2(low.astype(np.float64)).astype(np.int64) // 8
        left = left[~bad]
    return out


def least_owner(segments: list[bytes], owner: np.ndarray, length: int) -> np.ndarray:
    """For each start of a string in the segments, one after the other: the least owner of any segment with that string."""
    sizes = np.array([len(s) for s in segments])
    text = np.frombuffer(b"\0".join(segments) + b"\0" * 8, np.uint8)
    begin = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    n = int(begin[-1] + sizes[-1]) + 1
    t = text[:n].astype(np.int16) + 2
    t[begin[1:] - 1] = 1  # between segments
    t[n - 1] = 0
    starts = sizes - length + 1
    seg = np.repeat(np.arange(len(segments)), starts)
    pos = np.arange(len(seg)) - np.repeat(np.cumsum(starts) - starts, starts) + begin[seg]
    whole = np.full(n, -1, np.int64)
    whole[pos] = seg
    sa = suffix_array(t, 258)
    sa = sa[whole[sa] >= 0]
    common = np.zeros(n, np.int64)  # permuted: of each suffix with the one before it, in text order
    common[sa[1:]] = _common(text, sa[1:], sa[:-1], length)
    head = np.flatnonzero(common[sa] < length)
    least = np.minimum.reduceat(owner[whole[sa]], head) if len(sa) else np.empty(0, np.int64)
    out = np.empty(n, np.int64)
    out[sa] = np.repeat(least, np.diff(np.append(head, len(sa))))
    return out[pos]


TOGETHER = 200_000  # bytes of a suffix array, about: one that stays in a core's cache costs half as much a byte as one of megabytes


def together(anchor: np.ndarray, sizes: np.ndarray, most: int = TOGETHER) -> Iterator[np.ndarray]:
    """Numbers of the texts of each suffix array: whole anchors, in order, until there are ``most`` bytes.

    Equal strings share their anchor: a text that alone has its anchor meets no other text and is in none.
    """
    _, group, count = np.unique(anchor, return_inverse=True, return_counts=True)
    meet = np.flatnonzero(count[group] > 1)
    meet = meet[np.argsort(group[meet], kind="stable")]
    if len(meet):
        first = np.append(True, np.diff(group[meet]) > 0)  # of an anchor
        before = np.cumsum(sizes[meet]) - sizes[meet]
        number = before[first][np.cumsum(first) - 1] // most
        yield from np.split(meet, np.flatnonzero(np.diff(number)) + 1)


CUTS = 4  # parts of the places that an anchor can have in a string


def meeting(texts: list[bytes], anchor: np.ndarray, length: int) -> np.ndarray:
    """Numbers of the texts that may share a string with another text; all others meet none and need no suffix array.

    Equal strings have their anchor at the same place. A string whose anchor has from a to z bytes before it holds
    the a bytes before the anchor and the length - GRAM - z after it, so that texts which share such a string share this core as well.
    """
    _, group, count = np.unique(anchor, return_inverse=True, return_counts=True)
    several = np.flatnonzero(count[group] > 1)
    sizes = np.array([len(texts[k]) for k in several], np.int64)
    may = np.zeros(len(several), bool)
    at = np.empty(len(several), np.int64)  # of the anchor: the first place with its hash, as a text begins with a string that has it
    for part in np.split(np.arange(len(several)), np.flatnonzero(np.diff(np.cumsum(sizes) // CHUNK)) + 1) if len(several) else ():
        h = _grams(np.frombuffer(b"".join([texts[k] for k in several[part]]), np.uint8))
        begin = np.cumsum(sizes[part]) - sizes[part]
        hit = np.flatnonzero(h == np.repeat(anchor[several[part]], sizes[part])[: len(h)])
        at[part] = hit[np.searchsorted(hit, begin)] - begin
    width = length - GRAM + 1
    for a in range(0, width, step := -(-width // CUTS)):
        first, end = at - a, at + length - min(a + step, width) + 1
        ok = np.flatnonzero((first >= 0) & (end <= sizes))
        number: dict[bytes, int] = {}
        core = np.array([number.setdefault(texts[k][i:j], len(number)) for k, i, j in zip(several[ok].tolist(), first[ok].tolist(), end[ok].tolist())], np.int64)
        may[ok] |= np.bincount(core)[core] > 1
    return several[may]


# --- Spark ----------------------------------------------------------------------------------------------------


def _zip(texts: list[bytes]) -> pa.Array:
    codec = pa.Codec("zstd", compression_level=1)
    return pa.array([codec.compress(t, asbytes=True) for t in texts], pa.binary())


def _unzip(t: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    codec = pa.Codec("zstd")
    texts = [codec.decompress(z, n, asbytes=True) if n else b"" for z, n in zip(t["z"].to_pylist(), t["n"].to_pylist())]
    return t["doc_id"].to_numpy(), texts


def _longs(columns) -> np.ndarray:
    return np.frombuffer(b"".join(columns), np.uint64)


def removed(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    spark = docs.sparkSession
    shards = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    source = id_text(docs)
    named = source.filter("doc_id is not null")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_numpy(), b.column(1).cast(pa.binary()).to_pylist()
            block = ids // BLOCK
            for k in np.unique(block):
                at = np.flatnonzero(block == k)
                found, who = [], []
                for i, _, bounds, first, _, h in all_cells([texts[x] for x in at], length):
                    found.append(h)
                    who.append(ids[at][i + np.searchsorted(bounds, first, side="right")])
                h, who = np.concatenate(found), np.concatenate(who)
                order = np.lexsort((who, h))
                h, who = h[order], who[order]
                head = np.flatnonzero(np.append(True, h[1:] != h[:-1]) if len(h) else [])
                if not len(head):
                    continue
                tail = np.append(head[1:], len(h)) - 1
                several, h = who[head] != who[tail], h[head]
                shard = (h % np.uint64(shards)).astype(np.int32)
                order = np.argsort(shard, kind="stable")
                h, several, shard = h[order], several[order], shard[order]
                cut = np.flatnonzero(np.diff(shard)) + 1
                parts = np.split(h, cut), np.split(several, cut)
                yield pa.RecordBatch.from_pydict({"shard": pa.array(shard[np.append(0, cut)], pa.int32()), "block": pa.array(np.full(len(cut) + 1, k), pa.int64()), "h": pa.array([x.tobytes() for x in parts[0]], pa.binary()), "several": pa.array([x.tobytes() for x in parts[1]], pa.binary())})

    def shared(t: pa.Table) -> pa.Table:
        rows = t["h"].to_pylist()
        h, several = _longs(rows), np.frombuffer(b"".join(t["several"].to_pylist()), bool)
        keys, number, count = np.unique(h, return_inverse=True, return_counts=True)
        keep = (count > 1)
        keep[number[several]] = True
        cut = np.cumsum([len(r) // 8 for r in rows])[:-1]
        left = [p[k].tobytes() for p, k in zip(np.split(h, cut), np.split(keep[number], cut))]
        out = pa.table({"block": t["block"], "h": pa.array(left, pa.binary())})
        return out.filter(pa.array([len(x) > 0 for x in left], pa.bool_()))

    def segments(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, texts = _unzip(left)
        order = np.argsort(ids, kind="stable")
        ids, texts = ids[order], [texts[i] for i in order]
        wanted = np.unique(_longs(right["h"].to_pylist()))
        number: dict[bytes, int] = {}  # of each different text around an anchor
        found: list[tuple[np.ndarray, ...]] = []
        for i, data, bounds, first, last, h in all_cells(texts, length) if len(wanted) else ():
            ok = wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h
            first, last = first[ok], last[ok]
            mine = [number.setdefault(data[a:z], len(number)) for a, z in zip(first.tolist(), (last + length).tolist())]
            found.append((np.array(mine, np.int64), h[ok], ids[i + np.searchsorted(bounds, first, side="right")]))
        which, h, who = map(np.concatenate, zip(*found)) if found else (np.empty(0, np.int64),) * 3
        kept, key = list(number), np.empty(len(number), np.uint64)
        low, high = np.full(len(kept), np.iinfo(np.int64).max), np.full(len(kept), np.iinfo(np.int64).min)
        key[which] = h
        np.minimum.at(low, which, who)
        np.maximum.at(high, which, who)
        shard = (key % np.uint64(shards)).astype(np.int32)
        order = np.argsort(shard, kind="stable")
        rows = np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if kept else []
        each = lambda make: pa.array([make(r) for r in rows], pa.binary())
        return pa.table({
            "shard": pa.array([shard[r[0]] for r in rows], pa.int32()),
            "block": pa.array([int(ids[0]) // BLOCK if len(ids) else 0] * len(rows), pa.int64()),
            "size": each(lambda r: np.array([len(kept[k]) for k in r], np.int32).tobytes()),
            "text": each(lambda r: b"".join([kept[k] for k in r])),
            "h": each(lambda r: key[r].tobytes()), "low": each(lambda r: low[r].tobytes()), "high": each(lambda r: high[r].tobytes()),
        })

    def owners(t: pa.Table) -> pa.Table:
        number: dict[bytes, int] = {}
        which: list[np.ndarray] = []
        for size, text in zip(t["size"].to_pylist(), t["text"].to_pylist()):
            ends = np.cumsum(np.frombuffer(size, np.int32)).tolist()
            which.append(np.array([number.setdefault(text[a:z], len(number)) for a, z in zip([0, *ends], ends)], np.int64))
        mine, kept, h = np.concatenate(which), list(number), _longs(t["h"].to_pylist())
        lo, hi = (np.frombuffer(b"".join(t[c].to_pylist()), np.int64) for c in ("low", "high"))
        low, anchor = np.full(len(kept), np.iinfo(np.int64).max), np.empty(len(kept), np.uint64)
        np.minimum.at(low, mine, lo)
        anchor[mine] = h
        starts = np.array([len(s) for s in kept]) - length + 1
        at, least = np.cumsum(starts) - starts, np.repeat(low, starts)
        may = meeting(kept, anchor, length)
        for part in together(anchor[may], starts[may] + length - 1):
            meet = may[part]
            least[_runs(at[meet], starts[meet])] = least_owner([kept[k] for k in meet], low[meet], length)
        hit = np.flatnonzero(np.minimum.reduceat(least, at)[mine] < hi)
        used, name = np.unique(mine[hit]), np.empty(len(kept), np.uint64)
        name[used] = [xxhash.xxh64_intdigest(kept[k]) for k in used]
        row = np.repeat(np.arange(len(which)), [len(w) for w in which])[hit]
        rows = np.split(hit, np.flatnonzero(np.diff(row)) + 1) if len(hit) else []
        each = lambda make: pa.array([make(mine[r]) for r in rows], pa.binary())
        return pa.table({
            "block": t["block"].combine_chunks().take(pa.array(np.unique(row))), "h": each(lambda k: anchor[k].tobytes()), "name": each(lambda k: name[k].tobytes()),
            "starts": each(lambda k: starts[k].astype(np.int32).tobytes()), "least": each(lambda k: least[_runs(at[k], starts[k])].tobytes()),
        })

    def digest(doc: int | None, text: bytes, gone: np.ndarray | None) -> tuple:
        if gone is None or not gone.any():
            return doc, len(text), 0, 0, hashlib.sha256(text).hexdigest()
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        left = np.frombuffer(text, np.uint8)[~gone].tobytes()
        return doc, len(text), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()

    def rows_of(rows: list[tuple]) -> dict:
        names = [x.split(" ") for x in RESULT.split(", ")]
        return {c: pa.array(v, pa.string() if k == "string" else pa.int64()) for (c, k), v in zip(names, zip(*rows) if rows else [[]] * 5)}

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, texts = _unzip(left)
        wanted, names = np.unique(_longs(right["h"].to_pylist())), _longs(right["name"].to_pylist())
        starts, least = np.frombuffer(b"".join(right["starts"].to_pylist()), np.int32).astype(np.int64), np.frombuffer(b"".join(right["least"].to_pylist()), np.int64)
        place = dict(zip(names.tolist(), (np.cumsum(starts) - starts).tolist())).get
        dead: dict[int, list[np.ndarray]] = {}  # first document of a chunk -> starts of the strings that an earlier document has
        for i, data, bounds, first, last, h in all_cells(texts, length) if len(wanted) else ():
            ok = wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h
            first, last = first[ok], last[ok]
            found = np.array([place(xxhash.xxh64_intdigest(data[a:z]), -1) for a, z in zip(first.tolist(), (last + length).tolist())], np.int64)
            first, size, found = first[found >= 0], (last - first + 1)[found >= 0], found[found >= 0]
            doc = ids[i + np.searchsorted(bounds, first, side="right")]
            dead.setdefault(i, []).append(_runs(first, size)[least[_runs(found, size)] < np.repeat(doc, size)])
        rows = []
        for i, data, bounds in _chunks(texts):
            at = np.concatenate(dead.get(i, [np.empty(0, np.int64)]))
            if len(at):
                cover = np.zeros(len(data) + 1, np.int32)
                cover[at] += 1
                cover[at + length] -= 1
                gone = np.split(np.cumsum(cover[:-1]) > 0, bounds[:-1])
            for k in range(len(bounds)):
                rows.append(digest(int(ids[i + k]), texts[i + k], gone[k] if len(at) else None))
        return pa.table(rows_of(rows))

    def compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = b.column(1).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(b.column(0).to_numpy() // BLOCK), b.column(0), pa.array([len(t) for t in texts], pa.int64()), _zip(texts)], names=["block", "doc_id", "n", "z"])

    def unnamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield pa.RecordBatch.from_pydict(rows_of([digest(None, t, None) for t in b.column(1).cast(pa.binary()).to_pylist()]))

    blocks = named.mapInArrow(compressed, "block long, doc_id long, n long, z binary")
    sent = named.mapInArrow(anchors, "shard int, block long, h binary, several binary")
    common = sent.groupBy("shard").applyInArrow(shared, "block long, h binary")
    parts = blocks.groupBy("block").cogroup(common.groupBy("block")).applyInArrow(segments, "shard int, block long, size binary, text binary, h binary, low binary, high binary")
    answers = materialize(parts.groupBy("shard").applyInArrow(owners, "block long, h binary, name binary, starts binary, least binary"), "owners")
    done = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(cut, RESULT)
    return done.unionAll(source.filter("doc_id is null").mapInArrow(unnamed, RESULT))

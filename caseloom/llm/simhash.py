"""Near-duplicates by SimHash fingerprints and a vantage-point tree (operator 1).

1. ``fingerprints``: 64-bit SimHash of the word shingles of each whole text.
2. ``VantageTree``: fitted on a bounded sample of distinct fingerprints (``SAMPLE`` rows, those of
   least hash); it only decides where rows go, every fingerprint is indexed. A node splits at the
   median Hamming distance ``m`` to its vantage point. Rows farther than ``m`` go outside; those of
   them not farther than ``m + radius`` visit the inside as well. By the triangle inequality any two
   rows within ``radius`` then share a shard: both inside, both outside, or one of them visiting.
   A region too dense to split is cut into blocks by a hash, and each pair of blocks is a shard.
3. Each shard compares its rows, in blocks, after splitting itself further by the same rule, and
   returns at most one link for each row: to the least row it is joined with there. Groups of
   thousands of near copies thus never give all their pairs.
4. Links of all shards become components by alternating large-star and small-star steps, each
   written to the shared folder.

Exact copies share one fingerprint row from the start. Defined results: null and empty texts have
fingerprint zero and link like any other; rows with a null doc_id get their fingerprint and the
component of the least known doc_id; repeated rows give repeated results; empty tables give none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_heap_back, id_text, materialize, remove, shuffles_dropped, sliced

SAMPLE = 32_768  # fingerprints that the tree is fitted on
SHARD_ROWS = 100_000  # rows aimed at in a shard: each level of the tree repeats about a quarter of its rows
BLOCK = 1_024  # rows compared at once inside a shard


def simhash(text: bytes, k: int, seed: int = 42) -> int:
    words = text.lower().split()  # of bytes: A-Z only, and exactly the six ASCII white-space characters
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = (np.concatenate(([0], ends[:-1] + 1))[: max(1, len(words) - k + 1)]).tolist()
    stops = ends[k - 1 :].tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops)], dtype="<u8")
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long); no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            fp = np.array([simhash(t, k) for t in b.column(1).cast(pa.binary()).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return id_text(docs).mapInArrow(run, "doc_id long, fp long")


def _distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


@dataclass
class Node:
    vantage: np.uint64 | None = None
    split: int = 0
    inside: "Node | None" = None
    outside: "Node | None" = None
    shard: int = -1
    blocks: int = 1


def _vantage(points: np.ndarray) -> tuple[np.uint64, int, float] | None:
    """Of a few candidates the one that splits with the fewest visitors: (point, split, share inside)."""
    best = None
    for v in points[:: max(1, len(points) // 8)][:8]:
        d = _distance(points[:4096], v)
        m = int(np.median(d))
        inside = float((d <= m).mean())
        if 0.2 <= inside <= 0.8 and (best is None or d.std() > best[0]):
            best = (d.std(), v, m, inside)
    return best and best[1:]


class VantageTree:
    """Routes fingerprints to shards so that rows within ``radius`` meet."""

    def __init__(self, sample: np.ndarray, n: int, radius: int, shard_rows: int = SHARD_ROWS):
        self.radius, self.shards = radius, 0
        self._rows = n / max(1, len(sample))  # rows for which one of the sample stands
        self._most = shard_rows
        self.root = self._build(sample)

    def _build(self, points: np.ndarray) -> Node:
        if len(points) * self._rows > self._most and len(points) >= 16 and (found := _vantage(points)):
            v, m, _ = found
            d = _distance(points, v)
            near, out = d <= m + self.radius, d > m
            if near.mean() + out.mean() < 1.45 and near.mean() < 0.9:  # else the split prunes too little to pay
                return Node(v, m, self._build(points[near]), self._build(points[out]))
        # what no split prunes is cut into blocks, and each pair of blocks is a shard
        blocks = max(1, round(len(points) * self._rows / self._most))
        self.shards += blocks * (blocks + 1) // 2
        return Node(shard=self.shards - blocks * (blocks + 1) // 2, blocks=blocks)

    def route(self, fp: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(shard, row numbers) for every shard that gets rows."""
        todo = [(self.root, np.arange(len(fp)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node.vantage is None:
                block = (fp[rows] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(node.blocks)
                for k, (i, j) in enumerate(combinations_with_replacement(range(node.blocks), 2)):
                    if i < j or node.blocks == 1:
                        yield node.shard + k, rows[(block == i) | (block == j)]
                continue
            d = _distance(fp[rows], node.vantage)
            todo += [(node.inside, rows[d <= node.split + self.radius]), (node.outside, rows[d > node.split])]


def _least(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows the least row it is joined with by the links u-v."""
    label = np.arange(n)
    while True:
        m = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], m)
        np.minimum.at(new, label[v], m)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def shard_links(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (a, b), a < b, that join what is within radius; at most one for each row and part."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    todo = [np.arange(len(fp))]
    while todo:
        rows = todo.pop()
        points = fp[rows]
        if len(rows) > 2 * BLOCK and (split := _vantage(points)):
            d = _distance(points, split[0])
            near, out = d <= split[1] + radius, d > split[1]
            if near.sum() + out.sum() < 1.5 * len(rows) and near.sum() < 0.9 * len(rows):
                todo += [rows[near], rows[out]]
                continue
        u, v = np.empty(0, np.int64), np.empty(0, np.int64)
        for i in range(0, len(rows), BLOCK):
            for j in range(i, len(rows), 4 * BLOCK):
                a, b = np.nonzero(_distance(points[i : i + BLOCK, None], points[None, j : j + 4 * BLOCK]) <= radius)
                a, b = a + i, b + j
                u, v = np.concatenate((u, a[a < b])), np.concatenate((v, b[a < b]))
                if len(u) > 4_000_000:  # dense: keep a link to the least row only
                    label = _least(u, v, len(rows))
                    u = np.flatnonzero(label != np.arange(len(rows)))
                    v = label[u]
        if len(u):
            label = _least(u, v, len(rows))
            u = np.flatnonzero(label != np.arange(len(rows)))
            found.append((rows[label[u]], rows[u]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def near_links(nodes: DataFrame, radius: int) -> DataFrame:
    """nodes (id, fp, fp distinct) -> links (a, b), a < b, whose components are those of all pairs within radius."""
    n = nodes.count()
    sample = nodes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toPandas()["fp"].to_numpy(np.int64)
    tree = nodes.sparkSession.sparkContext.broadcast(VantageTree(sample.view(np.uint64), n, radius))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, fp = b.column(0).to_numpy(), b.column(1).to_numpy()
            for shard, rows in tree.value.route(fp.view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), shard, np.int32)), pa.array(ids[rows]), pa.array(fp[rows])], names=["shard", "id", "fp"])

    def link(t: pa.Table) -> pa.Table:
        order = np.argsort(ids := t["id"].to_numpy())
        a, b = shard_links(t["fp"].to_numpy()[order].view(np.uint64), radius)
        ids = ids[order]
        return pa.table({"a": ids[a], "b": ids[b]})

    dealt = nodes.select("id", "fp").mapInArrow(deal, "shard int, id long, fp long")
    return dealt.groupBy("shard").applyInArrow(link, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (id, component): the least id of each connected component, for all ids but the least."""

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a"))) if large else edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        near = both.join(least, "u")
        if large:
            out = near.filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        else:
            out = near.select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.select(F.col("m"), F.col("u")))
        return out.filter("a <> b").distinct()

    edges, before = materialize(links, "edges"), None
    while True:
        old, edges = edges, materialize(star(star(edges, large=True), large=False), "stars")
        remove(links.sparkSession, old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("b").alias("id"), F.col("a").alias("component"))
        before = now


def near_duplicates(docs: DataFrame, k: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fp, component_id for every document."""
    marks = materialize(fingerprints(docs, k), "fingerprints")
    nodes = materialize(marks.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id")), "nodes")
    parts = components(near_links(nodes, radius))
    named = nodes.join(parts, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return marks.join(named, "fp", "left").select("doc_id", "fp", "component_id")


# Looser copies, for pipelines: exact similarity of word shingles ------------------------------------------

ORDER_SAMPLE = 10_000  # texts, at the least, whose shingle counts give the order, rare ones first; it decides cost, never results
ORDER_SHARE = 24  # and one of so many: else shingles that are rare in the sample are in ever more texts, whose pairs grow with the square
ORDER_SHINGLES = 250_000  # of their repeated shingles so many, the most frequent, are broadcast
SHARED = 2  # shingles that two prefixes must share
LIGHT = 32  # texts that all meet in a bucket; in larger ones leaders come first
LEADS, SALTS = 2, 8  # rounds of leaders; parts of a bucket that is compared in full
CACHED = 2_000_000  # shingle hashes that a task keeps while it compares
BITS = 8  # 64-bit words of a parity bitmap
BROADCAST_ROWS = 1_000_000  # doc_ids that may be broadcast


def _shingle_hashes(text: bytes, k: int) -> np.ndarray:
    words = text.lower().split()
    n = max(1, len(words) - k + 1) if words else 0
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(n)], dtype=np.uint64))


def _parity(h: np.ndarray) -> np.ndarray:
    """Each shingle flips a bit: two bitmaps differ in no more bits than their sets in shingles."""
    odd = np.bincount((h >> np.uint64(55)).astype(np.int64), minlength=64 * BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _wide(h: np.ndarray) -> np.ndarray:
    """The same with two bits or more for each shingle, 512 at the least: that of 512 bits says nothing of texts of more than a thousand shingles."""
    n = max(512, 1 << int(2 * len(h) - 1).bit_length())
    return np.packbits((np.bincount((h & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def _apart(x: Column, y: Column) -> Column:
    """Bits in which two wide bitmaps differ, one of twice the length folded to that of the other: so many shingles at the least are in one set only. Else zero."""
    xor = lambda a, b: F.zip_with(a, b, lambda p, q: p.bitwiseXOR(q))
    fold = lambda a, n: xor(F.slice(a, F.lit(1), n), F.slice(a, n + 1, n))
    bits = lambda a: F.aggregate(a, F.lit(0), lambda found, w: found + F.bit_count(w))
    m, n = F.size(x), F.size(y)
    return F.when(m == n, bits(xor(x, y))).when(m == 2 * n, bits(xor(fold(x, n), y))).when(n == 2 * m, bits(xor(x, fold(y, m)))).otherwise(0)


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of two sorted sets, each of different shingle hashes."""
    both = len(np.intersect1d(x, y, True))
    return both / max(1, len(x) + len(y) - both)


def _need(m, n, similarity: float):
    """Shingles in common at the least."""
    return similarity / (1 + similarity) * (m + n) - 1e-6


def _prefix(n, similarity: float, any_size: bool, ceil=np.ceil):
    """Shingles of a text of n among which it shares ``SHARED`` with any similar one (or any not smaller)."""
    return n - ceil((similarity if any_size else 2 * similarity / (1 + similarity)) * n - 1e-6) + SHARED


def _common(rows: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that occur in several texts of a sample, sorted, and in how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            for t in b.column(1).cast(pa.binary()).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(_shingle_hashes(t, k).view(np.int64))], names=["s"])

    every = max(1, min(rows.count() // ORDER_SAMPLE, ORDER_SHARE))
    few = rows.filter(F.pmod(F.col("body"), F.lit(every)) == 0).dropDuplicates(["body"]).select("body", "text")
    with shuffles_dropped(rows.sparkSession):
        found = few.mapInArrow(run, "s long").groupBy("s").count().filter("count > 1").orderBy(F.desc("count"), "s").limit(ORDER_SHINGLES).toArrow()
    s, n = found.column("s").to_numpy().view(np.uint64), found.column("count").to_numpy()
    order = np.argsort(s)
    return s[order], n[order]


def _similar(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, k: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of bodies whose whole texts have the similarity; only texts whose wide bitmaps allow for it meet."""
    spark = rows.sparkSession
    give_heap_back(spark)
    pairs = materialize(pairs, "pairs")
    give_heap_back(spark)
    meant = materialize(pairs.select(F.explode(F.array("a", "b")).alias("body")).distinct().join(nodes.select("body", "id", "n", "wide"), "body"), "meant")

    sides = meant.select("body", "n", "wide")
    near = pairs.join(sides.toDF("a", "m", "x"), "a").join(sides.toDF("b", "n", "y"), "b")
    near = materialize(near.filter(_apart(F.col("x"), F.col("y")) <= F.col("m") + F.col("n") - 2 * _need(F.col("m"), F.col("n"), similarity)).select("a", "b"), "near")
    ids = materialize(near.select(F.explode(F.array("a", "b")).alias("body")).distinct().join(meant.select("id", "body"), "body"), "compared")
    few = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    texts = materialize(rows.join(few.withColumnRenamed("id", "doc_id"), ["doc_id", "body"], "left_semi").dropDuplicates(["body"]).select("body", "text"), "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        held = [0]

        def shingles(body: int, text: bytes) -> np.ndarray:
            if body not in known:
                known[body] = _shingle_hashes(text, k)
                held[0] += len(known[body])
                while held[0] > CACHED and len(known) > 2:
                    held[0] -= len(known.pop(next(x for x in known if x != body)))
            return known[body]

        for b in sliced(batches):
            a, c, x, y = (b.column(i).cast(pa.binary()).to_pylist() if i > 1 else b.column(i).to_pylist() for i in range(4))
            yield b.filter(pa.array([jaccard(shingles(*p), shingles(*q)) >= similarity for p, q in zip(zip(a, x), zip(c, y))], pa.bool_())).select(["a", "b"])

    both = near.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b").select("a", "b", "x", "y")
    found = materialize(both.mapInArrow(run, "a long, b long"), "similar")
    remove(spark, pairs, meant, near, ids, texts)
    return found


def near_duplicate_groups(docs: DataFrame, k: int = 5, similarity: float = 0.8, radius: int = 3) -> DataFrame:
    """doc_id, component_id: groups joined by whole fingerprints within radius, or by k-word similarity.

    A similarity of 0.8 moves about 10 of 64 fingerprint bits, too far for a tree to prune. So the
    texts are also joined by prefixes: with the shingles of each text in one order, rare ones first,
    similar texts share ``SHARED`` among their first ones, and no later than their sizes allow. Texts
    of a small bucket (one shingle) all meet. Those of a large bucket are first compared with
    ``LEADS`` leaders; then whoever is not joined yet meets all others of the bucket. Each meeting
    pair is decided by all shingles of both texts, so no pair is missed and none is estimated.
    """
    need = lambda m, n: _need(m, n, similarity)
    spark = docs.sparkSession
    rows = id_text(docs).filter("doc_id is not null").withColumn("body", F.xxhash64("text"))
    common = spark.sparkContext.broadcast(_common(rows, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = common.value
        for b in sliced(batches):
            fp, sizes, firsts, bits, wide = [], [], [], [], []
            for t in b.column(1).cast(pa.binary()).to_pylist():
                h = _shingle_hashes(t, k)
                at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
                often = np.where(known[at] == h, counts[at], 0) if len(known) else np.zeros(len(h), np.int64)
                fp.append(simhash(t, k))
                sizes.append(len(h))
                bits.append(_parity(h))
                wide.append(_wide(h))
                firsts.append(h[np.lexsort((h, often))[: int(_prefix(len(h), similarity, True))]].view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(firsts, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64())), pa.array(wide, pa.list_(pa.int64()))], names=["doc_id", "body", "fp", "n", "first", "bits", "wide"])

    marks = materialize(rows.select("doc_id", "text", "body").mapInArrow(run, "doc_id long, body long, fp long, n int, first array<long>, bits array<long>, wide array<long>"), "marks")
    ids = materialize(marks.select("doc_id", "body"), "ids")
    least = ids.groupBy("body").agg(F.min("doc_id").alias("id"))
    held = materialize(marks.join(least, "body").filter("doc_id = id").drop("doc_id").dropDuplicates(["body"]), "held")
    remove(spark, marks)
    nodes = materialize(held.select("body", "id", "fp", "n", "wide"), "nodes")
    prints = materialize(nodes.groupBy("fp").agg(F.min("id").alias("id")), "prints")
    equal = nodes.join(prints.withColumnRenamed("id", "a"), "fp").filter("a <> id").select("a", F.col("id").alias("b"))

    give_heap_back(spark)
    every = held.select("body", "n", F.posexplode("first").alias("at", "s")).withColumn("indexed", F.col("at") < _prefix(F.col("n"), similarity, False, F.ceil))
    buckets = every.groupBy("s").agg(F.count("*").alias("met"), F.max("indexed").alias("any")).filter("met > 1 and any")
    met = materialize(every.join(buckets.select("s", "met"), "s").join(held.select("body", "bits"), "body"), "met")
    remove(spark, held)

    def may(a: str, b: str):
        """Sizes, places and bitmaps allow for the similarity."""
        m, n = F.col(f"{a}.n"), F.col(f"{b}.n")
        differ = sum((F.bit_count(F.col(f"{a}.bits")[i].bitwiseXOR(F.col(f"{b}.bits")[i])) for i in range(BITS)), F.lit(0))
        return (F.least(m, n) >= similarity * F.greatest(m, n) - 1e-6) & (SHARED + F.least(m - 1 - F.col(f"{a}.at"), n - 1 - F.col(f"{b}.at")) >= need(m, n)) & (differ <= m + n - 2 * need(m, n))

    smaller = F.col("x.indexed") & (F.struct("x.n", "x.body") < F.struct("y.n", "y.body")) & may("x", "y")
    light = met.filter(F.col("met") <= LIGHT)
    pairs = light.alias("x").join(light.alias("y"), (F.col("x.s") == F.col("y.s")) & smaller)
    pairs = pairs.groupBy(F.col("x.body").alias("a"), F.col("y.body").alias("b")).agg(F.count("*").alias("c"), F.first(need(F.col("x.n"), F.col("y.n"))).alias("need"))
    links = _similar(pairs.filter(F.col("c") >= F.least(F.lit(SHARED), F.ceil("need"))).select("a", "b"), nodes, rows, k, similarity)

    heavy = met.filter(F.col("met") > LIGHT).drop("met")
    for i in range(LEADS + 1 if not heavy.isEmpty() else 0):
        parts = components(links).toDF("body", "part")
        open_ = heavy.join(parts, "body", "left").withColumn("part", F.coalesce("part", "body"))
        split = open_.groupBy("s").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.min_by(F.struct("body", "n", "at", "part", "bits"), F.xxhash64("body", F.lit(i))).alias("y")).filter("p <> q")
        open_ = materialize(open_.join(split.select("s", "y"), "s"), "open")
        remove(spark, parts)
        if open_.isEmpty():
            remove(spark, open_)
            break
        if i < LEADS:
            pairs = open_.select(F.struct("body", "n", "at", "part", "bits").alias("x"), "y")
        else:
            salted = open_.drop("y").withColumn("salt", F.pmod(F.xxhash64("body"), F.lit(SALTS)))
            other = open_.drop("y").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
            pairs = salted.alias("x").join(other.alias("y"), (F.col("x.s") == F.col("y.s")) & (F.col("x.salt") == F.col("y.salt")) & smaller)
        pairs = pairs.filter(F.col("x.part") != F.col("y.part")).filter(may("x", "y")).select(F.col("x.body").alias("a"), F.col("y.body").alias("b")).distinct()
        more = _similar(pairs, nodes, rows, k, similarity)
        old, links = links, materialize(links.union(more), "links")
        remove(spark, old, more, open_)
    remove(spark, met)
    give_heap_back(spark)
    names = nodes.select("body", "id")
    named = links.join(names.toDF("a", "m"), "a").join(names.toDF("b", "n"), "b").select(F.least("m", "n").alias("a"), F.greatest("m", "n").alias("b")).filter("a <> b")
    parts = components(near_links(prints, radius).union(equal).union(named).distinct())
    done = materialize(names.join(parts, "id", "left").select("body", F.coalesce("component", "id").alias("component_id")), "groups")
    remove(spark, nodes, prints, links, parts)
    return ids.join(done, "body").select("doc_id", "component_id")

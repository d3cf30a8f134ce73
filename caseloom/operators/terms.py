"""Dictionaries of many terms over texts, all terms in one pass: a trie with failure links for each task.

Also the fuzzy join of texts by shared pieces: the pieces of the smaller side are such a dictionary.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left, insort
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions.scalars import ngrams
from ..sources.shared import materialize

MOST = 250_000  # terms of one automaton; a larger dictionary is dealt to several, each with a pass of its own
_MADE: dict[str, ahocorasick.Automaton] = {}  # of this Python process, the last one used


def _automaton(name: str, terms: list[str]) -> ahocorasick.Automaton:
    if name not in _MADE:
        _MADE.clear()
        made = ahocorasick.Automaton()
        for i, t in enumerate(terms):
            made.add_word(t, (i, len(t)))
        made.make_automaton()
        _MADE[name] = made
    return _MADE[name]


def longest_first(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (start, end, term) those that stay when the longest are placed first everywhere, then earlier ones, and none overlaps; in text order."""
    placed: list[tuple[int, int, int]] = []
    for x in sorted(found, key=lambda x: (x[0] - x[1], x[0], x[2])):
        at = bisect_left(placed, (x[0],))
        if (at == len(placed) or placed[at][0] >= x[1]) and (at == 0 or placed[at - 1][1] <= x[0]):
            insort(placed, x)
    return placed


def _dictionaries(terms: DataFrame, term: str) -> list[list[str]]:
    """The distinct terms in lists of at most MOST, by their hash (one list, where they are not more)."""
    rows = materialize(terms.select(F.col(term).alias("term")).filter(F.length(term) > 0).distinct(), "dictionary")
    n = max(1, -(-rows.count() // MOST))
    return [[r.term for r in rows.filter(F.pmod(F.xxhash64("term"), F.lit(n)) == i).orderBy("term").collect()] for i in range(n)]


def _scan(rows: DataFrame, key: str, text: str, words: list[str], name: str, each) -> DataFrame:
    """key, start, end, term: what ``each(text, occurrences)`` keeps of a text's occurrences (start, end, number of the term)."""
    shared = rows.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        made = _automaton(name, held) if held else None
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                which, out = [], []
                for i, t in enumerate(part.column("text").to_pylist()):
                    if t and made is not None:
                        kept = each(t, ((last + 1 - n, last + 1, w) for last, (w, n) in made.iter(t)))
                        which += [i] * len(kept)
                        out += kept
                start, end, term = zip(*out) if out else ((), (), ())
                yield pa.record_batch([part.column("key").take(pa.array(which, pa.int32())), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array([held[w] for w in term], pa.string())], names=[key, "start", "end", "term"])

    kind = T.StructType([T.StructField(key, rows.schema[key].dataType), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("term", T.StringType())])
    return rows.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, kind)


def occurrences(rows: DataFrame, key: str, text: str, terms: DataFrame, term: str = "term", words: bool = False) -> DataFrame:
    """key, start, end, term: the dictionary's terms in each text, longest first everywhere, none overlapping.

    words: only between blanks or the text's ends. A null or empty text has none; an empty term none; the dictionary may have any number of
    terms (beyond MOST the occurrences of several passes meet for each text); keys should be unique.
    """

    def alone(t: str, a: int, z: int) -> bool:
        return (a == 0 or t[a - 1].isspace()) and (z == len(t) or t[z].isspace())

    def every(t: str, found) -> list:
        return [x for x in found if not words or alone(t, x[0], x[1])]

    lists = _dictionaries(terms, term)
    name = uuid.uuid4().hex
    if len(lists) == 1:
        return _scan(rows, key, text, lists[0], name, lambda t, found: longest_first(every(t, found)))
    parts = [_scan(rows, key, text, x, f"{name}-{i}", every) for i, x in enumerate(lists)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)

    def resolve(pdf):
        held = pdf["term"].tolist()
        kept = longest_first([(a, z, i) for i, (a, z) in enumerate(zip(pdf["start"], pdf["end"]))])
        return pdf.iloc[[i for _, _, i in kept]]

    return both.groupBy(key).applyInPandas(resolve, both.schema)


def frequencies(found: DataFrame, key: str) -> DataFrame:
    """term, n, texts: how often, and in how many texts, each term occurs."""
    per = found.groupBy("term", key).agg(F.count("*").alias("_n"))
    return per.groupBy("term").agg(F.sum("_n").alias("n"), F.count("*").alias("texts"))


def gram_containment(items: DataFrame, item: str, item_text: str, texts: DataFrame, key: str, text: str, n: int = 8, step: int = 4, least: float = 0.5) -> DataFrame:
    """item, key, share: whole texts that hold at least that share of an item's pieces of n characters (every ``step``-th).

    The items' pieces are one dictionary, sought in each text in one pass, so only pieces that occur leave a text,
    each once. A text that holds the share holds one of any |pieces| - need + 1 pieces: texts and items are joined by
    each item's rarest ones, so a piece that all texts have pairs nothing; the candidates are then counted in full. Items shorter than n are one piece.
    """
    grams = materialize(items.filter(F.length(item_text) > 0).select(F.col(item).alias("_i"), F.explode(ngrams(F.col(item_text), n, step)).alias("term")), "item-grams")
    found = None
    for words in _dictionaries(grams, "term"):
        one = _scan(texts, key, text, words, uuid.uuid4().hex, lambda t, seen: [(0, 0, w) for w in {w for _, _, w in seen}])
        found = one if found is None else found.unionByName(one)
    found = materialize(found.select(F.col(key).alias("_k"), "term"), "text-grams")
    df = found.groupBy("term").agg(F.count("*").alias("_df"))
    sizes = grams.groupBy("_i").agg(F.count("*").alias("_all"))
    rare = W.partitionBy("_i").orderBy(F.coalesce("_df", F.lit(0)), "term")
    ranked = grams.join(df, "term", "left").withColumn("_at", F.row_number().over(rare)).join(sizes, "_i")
    prefix = ranked.filter(F.col("_at") <= F.col("_all") - F.ceil(least * F.col("_all") - 1e-9) + 1)
    pairs = materialize(prefix.select("_i", "term").join(found, "term").select("_i", "_k").distinct(), "gram-pairs")
    counted = pairs.join(grams, "_i").join(found, ["_k", "term"]).groupBy("_i", "_k").agg(F.count("*").alias("_n")).join(sizes, "_i")
    share = F.col("_n") / F.col("_all")
    return counted.filter(share >= least - 1e-9).select(F.col("_i").alias(item), F.col("_k").alias(key), share.alias("share"))


PROBE = 48  # characters, blanks removed


def related(items: DataFrame, item: str, item_text: str, texts: DataFrame, key: str, text: str, within: list[str], keep: int = 4, least: float = 0.18, n: int = 3) -> DataFrame:
    """item, key, share, rank: the texts that an item belongs to, of the same ``within`` columns, at most ``keep``.

    A text that holds the item's first PROBE characters (blanks removed; share 1) comes before those that share at
    least that part of the smaller text's pieces of n characters; ties to the lesser key. A piece is joined within its columns only.
    """
    bare = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", "")
    a = items.select(*within, F.col(item).alias("_i"), bare(item_text).alias("_a")).filter("_a <> ''")
    b = texts.select(*within, F.col(key).alias("_k"), bare(text).alias("_b")).filter("_b <> ''")
    grams = lambda rows, i, c: rows.select(*within, i, F.explode(ngrams(F.col(c), n)).alias("_g"))
    size = lambda rows, i, c, out: rows.select(*within, i, F.size(ngrams(F.col(c), n)).alias(out))
    hits = grams(a, "_i", "_a").join(grams(b, "_k", "_b"), [*within, "_g"]).groupBy(*within, "_i", "_k").agg(F.count("*").alias("_n"))
    hits = hits.join(size(a, "_i", "_a", "_na"), [*within, "_i"]).join(size(b, "_k", "_b", "_nb"), [*within, "_k"])
    hits = materialize(hits.withColumn("share", F.col("_n") / F.least("_na", "_nb")).filter(F.col("share") >= least).select(*within, "_i", "_k", "share"), "gram-shares")
    # whoever holds the probe shares all its pieces, so it is among the pairs whenever the probe says anything
    both = hits.join(a, [*within, "_i"]).join(b, [*within, "_k"])
    probed = F.contains("_b", F.substring("_a", 1, PROBE))
    w = W.partitionBy(*within, "_i").orderBy(F.desc("probed"), F.desc("share"), "_k")
    out = both.select(*within, "_i", "_k", probed.alias("probed"), F.when(probed, 1.0).otherwise(F.col("share")).alias("share")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)
    return out.select(*within, F.col("_i").alias(item), F.col("_k").alias(key), "share", "rank")

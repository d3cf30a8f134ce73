"""Benchmark decontamination by template canonicalisation (operator 6). DataFrame functions only.

Texts become template tokens: lower-case words, with numbers, units after a number and capitalised
words replaced by typed placeholders. Names are read in two ways, and either suffices: capitalised
words inside a sentence only, and all capitalised words (names may begin a sentence or line). Of
every text the windows of ``WINDOW`` tokens of both readings are hashed and hash-joined with those
of the benchmark items. Windows with fewer than ``LEAST_LITERAL`` literal words say little as
templates: they are hashed with their values, so that only verbatim copies meet. Items shorter than
a window are one window of their own length, and texts send windows of these few lengths as well.

A document that holds ``SHARE`` or more of an item's template windows, or of all its windows, is a
candidate. If its windows have placeholders, the slot values are compared along each alignment of
document and item: a value of the item means itself, where it stands unchanged somewhere, else what two thirds of its
places say, else nothing; windows that say otherwise do not count. So re-parameterised questions count, chance
patterns do not, and one edited number costs the windows around it alone. Alignments at most a window apart are
chained, as a word put in or left out moves them; in a chain the larger ones say what a value means.

The benchmark's windows are broadcast only if counted to be at most ``BROADCAST_ROWS``; beyond that
the join shuffles. Documents send each distinct window once, so no group of copies multiplies.

Defined results: null and empty texts, and texts without a word, hold nothing; null doc_ids or
item_ids are left out; a doc_id or item_id that occurs twice is read as one document or item with
the windows of both; very long texts are read whole, each distinct window once; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialize

WINDOW, SHARE, LEAST_LITERAL = 8, 0.5, 4
CLEAR = 2 / 3  # of the places of an item's value: so many must say the same, or it means nothing
BROADCAST_ROWS = 1_000_000
NAME, NUMBER, UNIT, FIRST = "\ue000", "\ue001", "\ue002", "\ue003"  # FIRST: capitalised, but not inside a sentence
#: Units of measure that may follow a number.
UNITS = "km|m|cm|mm|mi|miles|ft|feet|kg|g|mg|lb|lbs|l|ml|h|hours|min|minutes|s|seconds|days|years|eur|usd|euros|dollars|percent"


def _tokens(text: Column) -> Column:
    """Lower-case words; those that may be in a slot begin with its placeholder character."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{NAME}-{FIRST}]", " ")
    # looking ahead before looking back: a capital is rarer than what may stand before it
    t = F.regexp_replace(t, r"(?=\p{Lu})(?<=[\p{Ll},;] )\p{Lu}\p{Ll}+", f"{NAME}$0")
    t = F.regexp_replace(t, rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{M}}\p{{N}}{NAME}])\p{{Lu}}\p{{Ll}}+", f"{FIRST}$0")
    t = F.regexp_replace(t, r"\d++(?:[.,]\d++)*+", f" {NUMBER}$0 ")
    t = F.regexp_replace(t, rf"({NUMBER}\S++  ?)(?i:({UNITS}))(?![\p{{L}}\p{{N}}])", f"$1{UNIT}$2")
    t = F.regexp_replace(t, r"(?=[.,])(?<=\d)[.,](?=\d)", "_")
    return F.filter(F.split(F.lower(t), rf"[^\p{{L}}\p{{M}}\p{{N}}_{NAME}-{FIRST}]++"), lambda w: w != "")


PAST = "\ue004"  # the character after the placeholders: a token in a slot lies between them


def _in_slot(x: Column, wide: bool) -> Column:
    return (x >= NAME) & (x < (PAST if wide else FIRST))


COUNT, MARK = 15, 16  # the low bits of a hash: how many slots it holds, and whether its word is capitalised but not inside a sentence


def _hashes(tokens: Column) -> Column:
    """For each token a hash, of its placeholder where it is in a slot; the low bits count slots, and mark what the two readings of names read differently."""
    word = lambda x: F.xxhash64(x).bitwiseAND(F.lit(-32))
    marked = lambda x: word(F.substring(x, 2, 1 << 30)).bitwiseOR(F.lit(MARK))
    return F.transform(tokens, lambda x: F.when((x < NAME) | (x >= PAST), word(x)).when(x < NUMBER, _slot(NAME)).when(x < UNIT, _slot(NUMBER)).when(x < FIRST, _slot(UNIT)).otherwise(marked(x)))


def _slot(kind: str) -> Column:
    return F.lit(32 * (ord(kind) - ord(NAME) + 1) + 1)


def _read(hashes: str, wide: bool) -> Column:
    """The hashes in one reading of names: a marked word is a name in the wide one, a word in the other."""
    if wide:
        return F.transform(hashes, lambda x: F.when(x.bitwiseAND(F.lit(MARK)) == 0, x).otherwise(_slot(NAME)))
    return F.transform(hashes, lambda x: x.bitwiseAND(F.lit(~MARK)))


def _doubled(a: str, k: int) -> Column:
    """Of column a, hashes of k tokens, those of 2k; a column by name, so that it is made once."""
    one = lambda x, y: F.xxhash64(x, y).bitwiseAND(F.lit(-32)).bitwiseOR(x.bitwiseAND(F.lit(COUNT)) + y.bitwiseAND(F.lit(COUNT)))
    return F.zip_with(a, F.slice(a, k + 1, 1 << 30), lambda x, y: one(x, y))


def _with_windows(rows: DataFrame, key: str, slots: bool, lengths: list[int], exact: bool = False) -> DataFrame:
    """key, windows: array of hashes, or of (wide, hash, at, telling, slots). lengths: short ones to send besides, if exact only of texts as short."""
    df = rows.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), _tokens(F.col("text")).alias("tokens"))
    df = df.select(key, "tokens", F.size("tokens").alias("n"), _hashes(F.col("tokens")).alias("h"))
    df = df.select(key, "tokens", "n", *[_read("h", r == "1").alias(f"h{r}") for r in "01"])
    df = df.withColumns({f"t{r}": _doubled(f"h{r}", 1) for r in "01"})
    for k in (2, 4):
        df = df.withColumns({f"t{r}": _doubled(f"t{r}", k) for r in "01"})

    def of(r: str, length: int) -> Column:
        def one(i: Column, whole: Column | None = None) -> Column:
            over = lambda tag, make: F.xxhash64(F.lit(tag), *[make(i + j) for j in range(length)])
            filled = whole.bitwiseAND(F.lit(COUNT)) if whole is not None else sum((F.get(f"h{r}", i + j).bitwiseAND(F.lit(COUNT)) for j in range(length)), F.lit(0))
            telling = filled <= length - min(length, LEAST_LITERAL)
            template = whole if whole is not None else over(length, lambda at: F.get(f"h{r}", at))
            hash_ = F.when(telling, template).otherwise(over(-length, lambda at: F.translate(F.get("tokens", at), NAME + NUMBER + UNIT + FIRST, "")))
            if not slots:
                return hash_
            values = F.transform(F.filter(F.slice("tokens", i + 1, length), lambda x: _in_slot(x, r == "1")), lambda x: F.substring(x, 2, 1 << 30))
            values = F.when(telling, values).otherwise(F.expr("cast(array() as array<string>)"))
            return F.struct(F.lit(r == "1").alias("wide"), hash_.alias("hash"), i.alias("at"), telling.alias("telling"), values.alias("slots"))

        if length == WINDOW:
            return F.transform(F.slice(f"t{r}", 1, F.greatest(F.col("n") - WINDOW + 1, F.lit(0))), lambda x, i: one(i, x))
        return F.when(F.col("n") == length if exact else F.col("n") >= length, F.transform(F.sequence(F.lit(0), F.greatest(F.col("n") - length, F.lit(0))), lambda i: one(i)))

    made = F.array_compact(F.array(*[of(r, n) for r in "01" for n in [WINDOW, *lengths]]))
    # read with explode_outer: explode would push a copy of this whole expression below as a filter on its size
    # (distinct structs are found by comparing all of them, distinct hashes by a set; readers of slots tell repeats apart themselves)
    return df.select(key, (F.flatten(made) if slots else F.array_distinct(F.flatten(made))).alias("windows"))


def _item_windows(benchmark: DataFrame, short: list[int]) -> DataFrame:
    """item_id, wide, hash, at, telling, slots, length, n_telling, n_windows."""
    w = _with_windows(benchmark, "item_id", slots=True, lengths=short, exact=True).select("item_id", F.explode_outer("windows").alias("x")).filter("x is not null").select("item_id", "x.*")
    n = w.groupBy("item_id", "wide").agg(F.count_distinct(F.when(F.col("telling"), F.col("hash"))).alias("n_telling"), F.count_distinct("hash").alias("n_windows"))
    return w.join(n, ["item_id", "wide"])


def _enough(share: float):
    """Of rows grouped by document and item: enough of the item's template windows, or of all its windows."""
    told = F.count_distinct(F.when(F.col("telling"), F.col("hash")))
    return ((F.max("n_telling") > 0) & (told >= share * F.max("n_telling"))) | (F.count_distinct("hash") >= share * F.max("n_windows"))


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, item_id, n_windows, n_matched, n_slots for every document that holds an item."""
    sizes = benchmark.filter("item_id is not null").select(F.size(_tokens(F.col("text"))).alias("n")).filter(F.col("n").between(1, WINDOW - 1)).distinct()
    short = sorted(r.n for r in sizes.collect())  # seven rows at most
    items = materialize(_item_windows(benchmark, short), "item-windows")
    key = ["doc_id", "item_id", "wide"]
    distinct = items.groupBy("item_id", "wide", "hash").agg(*[F.max(c).alias(c) for c in ("telling", "n_telling", "n_windows")], F.max(F.size("slots")).alias("n_slots"))
    side = F.broadcast(distinct) if items.count() <= BROADCAST_ROWS else distinct
    sent = _with_windows(docs, "doc_id", slots=False, lengths=short).select("doc_id", F.explode_outer("windows").alias("hash")).join(side, "hash")
    pairs = sent.groupBy(*key).agg(F.max("n_windows").alias("n_windows"), F.count_distinct("hash").alias("n_matched"), F.max("n_slots").alias("n_slots"), _enough(share).alias("enough"))
    pairs = materialize(pairs.filter("enough").drop("enough"), "candidates")
    plain = pairs.filter("n_slots = 0")
    slotted = pairs.filter("n_slots > 0")
    if slotted.isEmpty():
        return _once(plain)
    texts = docs.join(slotted.select("doc_id").distinct(), "doc_id", "left_semi")
    found = _with_windows(texts, "doc_id", slots=True, lengths=short).select("doc_id", F.explode_outer("windows").alias("x"))
    found = found.select("doc_id", F.col("x.hash").alias("hash"), F.col("x.at").alias("doc_at"), F.col("x.slots").alias("doc_slots"))
    both = slotted.select(*key).join(items, ["item_id", "wide"]).join(found, ["doc_id", "hash"])
    lines = materialize(both.withColumn("shift", F.col("doc_at") - F.col("at")), "aligned")
    line, place = [*key, "shift"], [*key, "shift", "at"]
    said = lines.select(*place, F.explode(F.arrays_zip(F.col("slots").alias("a"), F.col("doc_slots").alias("b"))).alias("v")).select(*place, "v.a", "v.b")
    # what an item's value means in each line; windows that say otherwise do not count
    most = said.groupBy(*line, "a", "b").agg(F.count("*").alias("n")).groupBy(*line, "a")
    most = most.agg(F.max(F.col("a") == F.col("b")).alias("same"), F.max_by("b", F.struct("n", "b")).alias("most"), (F.max("n") >= CLEAR * F.sum("n")).alias("clear"))
    most = most.select(*line, "a", F.when(F.col("same"), F.col("a")).when(F.col("clear"), F.col("most")).otherwise("").alias("meant"))
    odd = said.join(most, [*line, "a"]).filter("b <> meant").select(*place).distinct()
    sizes = lines.join(odd, place, "left_anti").groupBy(*line).agg(F.count_distinct("hash").alias("n"))
    # a word put in or left out moves the shift: shifts no farther apart than a window belong together
    w = W.partitionBy(*key).orderBy("shift")
    sizes = sizes.withColumn("chain", F.sum(F.when(F.col("shift") - F.lag("shift").over(w) > WINDOW, 1).otherwise(0)).over(w))
    first = most.join(sizes, line).groupBy(*key, "chain", "a").agg(F.min_by("meant", F.struct(F.col("meant") == "", -F.col("n"), "shift")).alias("meant"))
    sizes = sizes.drop("n")
    against = said.join(sizes, line).join(first, [*key, "chain", "a"]).filter("b <> meant").select(*place).distinct()
    held = lines.join(sizes, line).join(against, place, "left_anti").groupBy(*key, "chain")
    held = held.agg(_enough(share).alias("enough")).filter("enough")
    return _once(plain.unionByName(slotted.join(held, key, "left_semi")))


def _once(pairs: DataFrame) -> DataFrame:
    """Of the two readings the first that holds."""
    rest = ["n_windows", "n_matched", "n_slots"]
    return pairs.groupBy("doc_id", "item_id").agg(F.min_by(F.struct(*rest), "wide").alias("x")).select("doc_id", "item_id", *[f"x.{c}" for c in rest])

"""Personal data and information-theoretic sanitisation (operator 4). DataFrame functions only.

Base spans are what four patterns find (e-mail, IP address, card, phone), checked by their rules.
The method adds spans of terms that give a protected value away. Over all documents, copies of a
text counted once: n(t, e) texts have term t within ``NEAR`` words of value e (values are no words
and are not counted over), n(t) texts have t at all, n(e) texts have e, N texts differ (counted exactly). A term that n(t, e) >= ``LEAST_TEXTS`` texts show beside one value, whose
pointwise information log2(n(t,e) N / n(t) n(e)) is at least ``LEAST_BITS``, is removed everywhere
if the share n(t, e) / n(t) reaches ``REMOVE``, and generalised if it reaches ``GENERALISE``.

Only terms that reach a share of the texts where they stand near some value are looked up in all
texts. Counts are pre-aggregated before each shuffle; terms are joined by broadcast only if counted to be
``BROADCAST_ROWS`` at most. Positions are code points, end exclusive.

Defined results: null and empty texts have no spans; rows with a null doc_id get base spans only;
rows that share a doc_id are each read by themselves; an empty table gives none; other columns stay
untouched in ``sanitise`` and are ignored in ``private_spans``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

NEAR, LEAST_TEXTS, LEAST_BITS, GENERALISE, REMOVE = 5, 3, 4.0, 0.5, 0.8
BROADCAST_ROWS = 1_000_000
KINDS = ("email", "ip", "card", "phone")
#: The patterns of the kinds; possessive, and anchored to where a match can start, so that long texts take linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
WORD = r"\p{L}{3,}+"
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"
LABEL = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "term": "<TERM>", "removed": ""}


def _passes(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.substring(part(p), 1, 3).cast("int") <= 255))
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(9, 15)
    doubled = lambda i: F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * (1 + i % 2)
    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda acc, i: acc + doubled(i) - F.when(doubled(i) > 9, 9).otherwise(0))
    return F.when(F.length(digits).between(12, 19), total % 10 == 0).otherwise(False)


def _placed(text: Column, found: Column, pattern: str, rank: int, kind: str) -> Column:
    """The found matches with their places, from the lengths of what lies between them."""
    between = F.split(text, pattern, -1)
    start = lambda acc, x: acc["at"] + F.length(x["gap"])
    span = lambda acc, x: F.struct(start(acc, x).alias("start"), F.lit(rank).alias("rank"), (start(acc, x) + F.length(x["m"])).alias("end"), F.lit(kind).alias("kind"), x["m"].alias("value"))
    zero = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {SPAN})").alias("spans"))
    step = lambda acc, x: F.struct((start(acc, x) + F.length(x["m"])).alias("at"), F.when(_passes(kind, x["m"]), F.concat(acc["spans"], F.array(span(acc, x)))).otherwise(acc["spans"]).alias("spans"))
    pairs = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("gap"), found.alias("m"))
    return F.when(F.size(found) > 0, F.aggregate(pairs, zero, step, lambda acc: acc["spans"])).otherwise(F.expr(f"cast(array() as {SPAN})"))


def with_base(texts: DataFrame) -> DataFrame:
    """Adds ``base``, the base spans of column ``text`` (not null), ordered by start, then kind."""
    df = texts.withColumns({f"m_{k}": F.regexp_extract_all("text", F.lit(p), F.lit(0)) for k, p in PATTERNS.items()})
    df = df.withColumns({f"s_{k}": _placed(F.col("text"), F.col(f"m_{k}"), p, i, k) for i, (k, p) in enumerate(PATTERNS.items())})
    df = df.withColumn("base", F.array_sort(F.concat(*[F.col(f"s_{k}") for k in KINDS])))
    return df.drop(*[f"{x}_{k}" for x in "ms" for k in KINDS])


def _words(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower)


def _contexts(marked: DataFrame) -> DataFrame:
    """entity, term, body: a term stands near a value in a text (body: the text's hash); distinct.

    The words of a text are those outside its base spans; of them the ``NEAR`` last ones before a
    value and the ``NEAR`` first ones after it are its context, however far away they are.
    """
    n = F.size("base")
    done = lambda i: F.when(i > 0, F.array_max(F.transform(F.slice("base", 1, i), lambda s: s["end"]))).otherwise(0)  # noqa: E731  where the spans before i end
    piece = lambda i: F.substring(F.col("text"), done(i) + 1, F.when(i < n, F.greatest(F.get("base", i)["start"] - done(i), F.lit(0))).otherwise(F.length("text")))
    rows = marked.filter("size(base) > 0").withColumn("pieces", F.transform(F.sequence(F.lit(0), n), lambda i: _words(piece(i))))
    rows = rows.select("base", F.xxhash64("text").alias("body"), F.flatten("pieces").alias("words"), F.transform("pieces", lambda p: F.size(p)).alias("sizes"))
    before = lambda i: F.aggregate(F.slice("sizes", 1, i + 1), F.lit(0), lambda acc, x: acc + x)  # noqa: E731  words before value i
    near = lambda i: F.slice("words", F.greatest(before(i) - NEAR + 1, F.lit(1)), F.least(before(i), F.lit(NEAR)) + NEAR)
    entity = lambda s: F.concat_ws(":", s["kind"], F.lower(s["value"]))
    made = F.transform("base", lambda s, i: F.struct(entity(s).alias("entity"), F.array_distinct(near(i)).alias("terms")))
    # copies of a text give the same rows: dropped in the tasks, before the shuffle
    rows = rows.select("body", F.explode_outer(made).alias("x")).select("body", "x.entity", "x.terms").distinct()
    return rows.select("body", "entity", F.explode_outer("terms").alias("term"))


def disclosing_terms(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """texts (doc_id, text) -> (term, action) of the terms that give a value away, and (doc_id, term) where candidates occur."""
    near = materialize(_contexts(with_base(texts.select("text"))), "contexts")
    n_e = near.groupBy("entity").agg(F.count_distinct("body").alias("n_e"))
    n_te = near.filter("term is not null").distinct().groupBy("entity", "term").agg(F.count("*").alias("n_te")).filter(F.col("n_te") >= LEAST_TEXTS)
    # texts that have t near any value: n(t) is no less, so a pair whose share of these is too small is none, and common words end here
    n_near = near.filter("term is not null").select("term", "body").distinct().groupBy("term").agg(F.count("*").alias("n_near"))
    n_te = n_te.join(n_near, "term").filter(F.col("n_te") >= GENERALISE * F.col("n_near")).drop("n_near")
    pairs = materialize(n_te.join(n_e, "entity"), "term-values")
    terms = materialize(pairs.select("term").distinct(), "terms")
    side = F.broadcast(terms) if terms.count() <= BROADCAST_ROWS else terms
    words = texts.select("doc_id", F.xxhash64("text").alias("body"), F.explode_outer(F.array_distinct(_words(F.col("text")))).alias("term"))
    where = materialize(words.join(side, "term"), "term-places")
    n_t = where.select("term", "body").distinct().groupBy("term").agg(F.count("*").alias("n_t"))
    total = texts.select(F.xxhash64("text").alias("body")).distinct().count()
    bits = F.log2(F.col("n_te") * float(max(total, 1)) / (F.col("n_t") * F.col("n_e")))
    share = F.col("n_te") / F.col("n_t")
    strong = pairs.join(n_t, "term").filter((bits >= LEAST_BITS) & (share >= GENERALISE))
    actions = strong.groupBy("term").agg(F.when(F.max(share) >= REMOVE, "removed").otherwise("term").alias("action"))
    return materialize(actions, "disclosing"), where.select("doc_id", "term")


def with_spans(docs: DataFrame) -> DataFrame:
    """``row`` (all columns of docs), doc_id, text (null: empty), base and ``spans`` (base spans, and those of disclosing terms that touch none)."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    actions, where = disclosing_terms(packed.select("doc_id", "text"))
    listed = where.filter("doc_id is not null").distinct().join(actions, "term").groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "action")))).alias("terms"))
    listed = materialize(listed, "document-terms")
    df = with_base(packed).join(listed, "doc_id", "left")
    pieces = F.arrays_zip(F.slice(F.split("text", WORD, -1), 1, F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).alias("gap"), F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("m"))
    zero = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {SPAN})").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["m"])
        action = F.element_at("terms", F.lower(x["m"]))
        span = F.struct(start.alias("start"), F.lit(len(KINDS)).alias("rank"), end.alias("end"), action.alias("kind"), x["m"].alias("value"))
        free = action.isNotNull() & ~F.exists("base", lambda b: (b["start"] < end) & (b["end"] > start))
        return F.struct(end.alias("at"), F.when(free, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    extra = F.when(F.col("terms").isNotNull(), F.aggregate(pieces, zero, step, lambda acc: acc["spans"])).otherwise(F.expr(f"cast(array() as {SPAN})"))
    return df.withColumn("spans", F.array_sort(F.concat("base", extra))).drop("terms")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def private_spans(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans."""
    df = with_spans(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return df.select("doc_id", *map(count, KINDS), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with every span of ``text`` replaced by its label, or removed; same columns, whatever their names."""
    df = with_spans(docs)
    label = lambda kind: F.element_at(F.create_map(*[F.lit(x) for kv in LABEL.items() for x in kv]), kind)
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        out = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), label(s["kind"]))
        joined = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), out.alias("out"))).otherwise(joined)

    end = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text")))
    clean = F.when(F.size("spans") > 0, F.aggregate("spans", zero, step, end)).otherwise(F.col("row.text"))
    return df.withColumn("clean", clean).select(*[(F.col("clean") if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])

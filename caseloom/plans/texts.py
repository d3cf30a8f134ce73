"""Queries over documents, pages and benchmark texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import classified, redacted, token_estimate
from ..operators import build, extraction, joins, postings, ranking, retrieval, terms
from ..operators import aggregates as A
from ..operators.order import placed
from ..sources import tables as S
from ..sources.shared import new_path
from .registry import query

PARAS = """WITH raw AS (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '\\n+')) AS p, generate_subscripts(string_split_regex(coalesce(text, ''), '\\n+'), 1) AS i FROM documents),
paras AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS chunk_no, trim(p, ' ') AS content FROM raw WHERE trim(p, ' ') <> ''),
spans AS (SELECT *, CAST(coalesce(sum(length(content) + 1) OVER (PARTITION BY doc_id ORDER BY chunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "start" FROM paras)
"""


def paras(spark, sf_dir):
    return build.paragraphs(S.table(spark, sf_dir, "documents"), "doc_id", "text", r"\n+")


@query(PARAS + "SELECT doc_id, chunk_no, CAST(length(content) AS BIGINT) AS n_chars, md5(content) AS digest FROM paras")
def paragraph_split(spark, sf_dir):
    return paras(spark, sf_dir).select("doc_id", "chunk_no", F.length("content").cast("long").alias("n_chars"), F.md5("content").alias("digest"))


@query("SELECT page_id, CAST(i AS BIGINT) AS part, md5(substr(html, i * 500 + 1, 500)) AS digest FROM pages, range(0, CAST(ceil(length(html) / 500.0) AS BIGINT)) r(i) WHERE length(html) > 0")
def fixed_split(spark, sf_dir):
    rows = build.split_fixed(S.table(spark, sf_dir, "pages").select("page_id", "html"), "html", 500)
    return rows.filter("html <> ''").select("page_id", F.col("part").cast("long").alias("part"), F.md5("html").alias("digest"))


@query(PARAS + ", cases AS (SELECT doc_id, i AS case_no, i * 700 AS s, i * 700 + 500 AS e FROM (SELECT doc_id, max(\"start\" + length(content)) AS total FROM spans GROUP BY 1), range(0, CAST(ceil(total / 700.0) AS BIGINT)) r(i)) SELECT doc_id, case_no, chunk_no FROM spans JOIN cases USING (doc_id) WHERE \"start\" < e AND \"start\" + length(content) > s")
def span_overlap(spark, sf_dir):
    spans = ranking.offsets(paras(spark, sf_dir), "doc_id", "chunk_no", "content").select("doc_id", "chunk_no", "start", "end")
    cases = spans.groupBy("doc_id").agg(F.max("end").alias("total")).select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("total") / 700) - 1)).alias("case_no"))
    cases = cases.select("doc_id", "case_no", (F.col("case_no") * 700).alias("start_r"), (F.col("case_no") * 700 + 500).alias("end_r"))
    return joins.span_overlap(spans, cases, "doc_id", 2048).select("doc_id", "case_no", "chunk_no")


@query(PARAS + ", h AS (SELECT doc_id, chunk_no, \"start\", max(\"start\" + length(content)) OVER (PARTITION BY doc_id) AS total FROM spans QUALIFY chunk_no % 3 = 1) SELECT doc_id, chunk_no, \"start\", CAST(coalesce(lead(\"start\") OVER (PARTITION BY doc_id ORDER BY \"start\"), total) AS BIGINT) AS \"end\" FROM h")
def heading_segments(spark, sf_dir):
    spans = ranking.offsets(paras(spark, sf_dir), "doc_id", "chunk_no", "content")
    last = spans.groupBy("doc_id").agg(F.max("end").alias("total"))
    heads = spans.filter("chunk_no % 3 = 1").join(last, "doc_id").select("doc_id", "chunk_no", "start", F.col("total").alias("end"))
    return ranking.segments(heads, "doc_id", "start", "end")


@query("SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos) rn FROM (SELECT doc_id, source, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS pos FROM documents)) ORDER BY rn > 2, pos LIMIT 15")
def per_source_cap(spark, sf_dir):
    rows = S.table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    ranked = placed(rows, [F.desc("n_chars"), F.asc("doc_id")], name="pos").withColumn("pos", F.col("pos") + 1)
    return ranking.capped(ranked, "source", "pos", 2, 15).select("doc_id", "pos")


@query("SELECT doc_id, source, CAST(turn AS BIGINT) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS turn FROM documents) ORDER BY turn, source LIMIT 30")
def round_robin(spark, sf_dir):
    rows = S.table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return ranking.round_robin(rows, "source", [F.desc("n_chars"), F.asc("doc_id")], 30).select("doc_id", "source", "turn")


@query(PARAS + """, s AS (SELECT doc_id, chunk_no, (length(content) - length(replace(content, 'the', ''))) // 3 AS hits FROM paras),
r AS (SELECT *, CASE WHEN hits > 0 THEN row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, chunk_no) END AS r FROM s),
c AS (SELECT *, least(r, lag(r) OVER w, lead(r) OVER w) AS cover, max(r) OVER (PARTITION BY doc_id) AS any_hit FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_no)),
t AS (SELECT a.doc_id, a.chunk_no FROM c a WHERE a.any_hit IS NULL OR (a.cover IS NOT NULL AND (SELECT count(*) FROM c b WHERE b.doc_id = a.doc_id AND b.cover < a.cover) < 6))
SELECT doc_id, chunk_no FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_no) rn FROM t) WHERE rn <= 6""")
def neighbour_expand(spark, sf_dir):
    hits = F.floor((F.length("content") - F.length(F.replace("content", F.lit("the"), F.lit("")))) / 3)
    return ranking.neighbours(paras(spark, sf_dir), "doc_id", "chunk_no", hits, 6).select("doc_id", "chunk_no")


TERMS = ["thing", "station", "heating", "report", "und", "que"]


@query("WITH t AS (SELECT doc_id, replace(lower(text), ' ', '') AS b FROM documents), s AS (SELECT doc_id, CAST(" + " + ".join(f"CASE WHEN contains(b, '{t}') THEN {len(t)} ELSE 0 END" for t in TERMS) + " AS BIGINT) AS score FROM t) SELECT doc_id, score FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20")
def lexical_topk(spark, sf_dir):
    return retrieval.lexical(S.table(spark, sf_dir, "documents"), " ".join(TERMS), 20, "doc_id", "text")


BM25 = """t AS (SELECT doc_id, list_filter(string_split(lower(text), ' '), lambda x: x <> '') AS w FROM documents), d AS (SELECT doc_id, len(w) AS n FROM t), st AS (SELECT count(*) AS n_docs, avg(n) AS mean FROM d),
q AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(string_split(lower(text), ' '), lambda x: x <> '')) AS term FROM benchmark WHERE item_id % 100 = 0),
tf AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
bm AS (SELECT query_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term) JOIN d USING (doc_id), st GROUP BY 1, 2)"""


def _words(c):
    return F.filter(F.split(F.lower(c), " "), lambda x: x != "")


def questions(spark, sf_dir):
    return S.table(spark, sf_dir, "benchmark").filter("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), _words(F.col("text")).alias("query_tokens"))


@query(f"WITH {BM25}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS BIGINT) AS rank FROM bm) SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    return retrieval.bm25(S.table(spark, sf_dir, "documents"), questions(spark, sf_dir), 10, "doc_id", _words(F.col("text")))


@query(f"WITH {BM25}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS BIGINT) AS rank FROM bm) SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 10")
def bm25_index_topk(spark, sf_dir):
    """The same ranking from the persisted index: most documents written first, the others appended, blocks skipped by their maxima."""
    docs, path = S.table(spark, sf_dir, "documents"), new_path(spark, "postings")
    late = F.coalesce(F.col("doc_id") % 5 == 4, F.lit(False))
    postings.append(docs.filter(~late), "doc_id", _words(F.col("text")), path)
    postings.append(docs.filter(late), "doc_id", _words(F.col("text")), path, generation=1)
    return postings.search(spark, path, questions(spark, sf_dir), 10, "doc_id")[0]


HYBRID = f"""WITH {BM25}, v AS (SELECT doc_id, embedding, label FROM documents JOIN embeddings ON doc_id = vec_id), qv AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qe FROM embeddings WHERE vec_id % 100 = 0 AND vec_id IN (SELECT item_id FROM benchmark)),
dn AS (SELECT query_id, doc_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), qe), 6) AS score FROM v, qv),
dr AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM dn QUALIFY rank <= 30),
br AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm QUALIFY rank <= 30),
rr AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 8) AS score FROM (SELECT * FROM dr UNION ALL SELECT * FROM br) GROUP BY 1, 2)
SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS BIGINT) AS rank FROM rr QUALIFY rank <= 10"""


@query(HYBRID.replace("FROM documents)", "FROM documents JOIN embeddings ON doc_id = vec_id)", 1))
def hybrid_rrf(spark, sf_dir):
    v = S.table(spark, sf_dir, "embeddings")
    rows = S.table(spark, sf_dir, "documents").join(v, F.col("doc_id") == F.col("vec_id")).drop("vec_id")
    qs = questions(spark, sf_dir).join(F.broadcast(v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))), "query_id")
    return retrieval.hybrid(rows, qs, 10, "doc_id", "embedding", _words(F.col("text")))


@query("SELECT page_id, CAST(i - 1 AS BIGINT) AS n, CAST(v AS DOUBLE) AS value FROM (SELECT page_id, unnest(l) AS v, generate_subscripts(l, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '([0-9]+(?:\\.[0-9]+)?)', 1) AS l FROM pages))")
def fact_extract_numbers(spark, sf_dir):
    return extraction.numbers(S.table(spark, sf_dir, "pages"), "page_id", "html", r"([0-9]+(?:\.[0-9]+)?)")


@query("""WITH b AS (SELECT item_id, unnest(list_distinct(list_transform(range(1, length(text) - 6, 4), lambda i: substr(text, i, 8)))) AS g FROM benchmark WHERE length(text) >= 8),
n AS (SELECT item_id, count(*) AS n FROM b GROUP BY 1), h AS (SELECT item_id, doc_id, count(*) AS k FROM b JOIN documents d ON contains(d.text, b.g) GROUP BY 1, 2) SELECT item_id, doc_id, round(CAST(k AS DOUBLE) / n, 6) AS share FROM h JOIN n USING (item_id) WHERE CAST(k AS DOUBLE) / n >= 0.5""")
def ngram_overlap(spark, sf_dir):
    """Benchmark items of which whole documents hold half of the pieces of eight characters."""
    items = S.table(spark, sf_dir, "benchmark").filter("length(text) >= 8")
    found = terms.gram_containment(items, "item_id", "text", S.table(spark, sf_dir, "documents"), "doc_id", "text", 8, 4, 0.5)
    return found.withColumn("share", F.round("share", 6))


@query("""WITH t AS (SELECT DISTINCT w AS term FROM (SELECT unnest(string_split_regex(text, '\\s+')) AS w FROM benchmark UNION ALL SELECT p_name FROM part) WHERE length(w) >= 4),
d AS (SELECT doc_id, unnest(string_split_regex(text, '\\s+')) AS w FROM documents) SELECT term, count(*) AS n, count(DISTINCT doc_id) AS texts FROM d JOIN t ON w = term GROUP BY 1""")
def dictionary_terms(spark, sf_dir):
    """How often the benchmark's words and the parts' names stand in documents, all in one pass."""
    words = S.table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", r"\s+")).alias("term"))
    known = words.unionAll(S.table(spark, sf_dir, "part").select("p_name")).filter("length(term) >= 4")
    return terms.frequencies(terms.occurrences(S.table(spark, sf_dir, "documents"), "doc_id", "text", known, words=True), "doc_id")


@query("SELECT doc_id, CAST(greatest(1, floor(length(text) / 4)) AS BIGINT) AS tokens FROM documents")
def token_estimates(spark, sf_dir):
    return S.table(spark, sf_dir, "documents").select("doc_id", token_estimate(F.col("text")).cast("long").alias("tokens"))


VOCABULARY = ["the", "der", "que", "les", "with"]


@query("SELECT term, CAST(ord AS BIGINT) AS ord, CAST(sum(n) AS BIGINT) AS n FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS term, {i} AS ord, len(regexp_extract_all(text, '{t}')) AS n FROM documents" for i, t in enumerate(VOCABULARY)) + ") GROUP BY 1, 2 HAVING sum(n) > 0")
def vocabulary_frequency(spark, sf_dir):
    return A.vocabulary_frequency(S.table(spark, sf_dir, "documents"), "text", VOCABULARY).select("term", F.col("ord").cast("long").alias("ord"), "n")


@query("SELECT kind, count(*) AS n FROM (SELECT CASE WHEN contains(text, '###') OR contains(text, '$$$') THEN 'junk' WHEN contains(text, '@') THEN 'contact' WHEN contains(text, 'License') THEN 'licence' ELSE 'prose' END AS kind FROM documents) GROUP BY 1")
def document_kinds(spark, sf_dir):
    kind = classified(F.col("text"), [("junk", ["###", "$$$"]), ("contact", ["@"]), ("licence", ["License"])], "prose")
    return S.table(spark, sf_dir, "documents").select(kind.alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT doc_id, md5(regexp_replace(text, '((?i:api[_-]?key|token|secret|password)\\s*[=:]\\s*)[^\\s]+', '\\1***', 'g')) AS digest FROM documents WHERE regexp_matches(text, '(?i)(api[_-]?key|token|secret|password)\\s*[=:]')")
def secrets_redacted(spark, sf_dir):
    rows = S.table(spark, sf_dir, "documents").filter(F.col("text").rlike(r"(?i)(api[_-]?key|token|secret|password)\s*[=:]"))
    return rows.select("doc_id", F.md5(redacted(F.col("text"))).alias("digest"))


@query("SELECT d.doc_id, d.source FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) OR d.source IN ('src1', 'src2')")
def or_semijoin(spark, sf_dir):
    docs = S.table(spark, sf_dir, "documents").select("doc_id", "source")
    sources = spark.createDataFrame([("src1",), ("src2",)], "source string")
    return joins.either(docs, S.table(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id", sources, "source", "doc_id")


@query("SELECT text, min(doc_id) AS first_doc, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1".replace("SELECT text,", "SELECT md5(text) AS digest,").replace("GROUP BY 1", "GROUP BY md5(text)"))
def repeated_texts(spark, sf_dir):
    return S.table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")).filter("n > 1")


FOLD = PARAS.replace("WITH raw", "WITH RECURSIVE raw", 1)


@query(FOLD + """, w AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS chunk_no, CAST(0 AS BIGINT) AS used, 0 AS taken, false AS fits FROM paras
UNION ALL SELECT doc_id, chunk_no, CASE WHEN f THEN used + n ELSE used END, CASE WHEN f THEN taken + 1 ELSE taken END, f FROM (SELECT p.doc_id, p.chunk_no, w.used, w.taken, length(p.content) AS n, w.taken = 0 OR w.used + length(p.content) <= 1500 AS f FROM w JOIN paras p ON p.doc_id = w.doc_id AND p.chunk_no = w.chunk_no + 1 WHERE w.taken < 8 AND w.used < 1500))
SELECT doc_id, chunk_no FROM w WHERE fits""")
def budget_pick(spark, sf_dir):
    rows = paras(spark, sf_dir).withColumn("rank", F.col("chunk_no"))
    return ranking.within_budget(rows, "doc_id", "rank", "content", "chunk_no", 8, 1500).select("doc_id", "chunk_no")


SECTIONS = {"a": "ing", "b": "tion", "c": "heit", "d": "ment", "focus": "the"}
PACK = PARAS + f""", h AS (SELECT doc_id, chunk_no, count(*) OVER (PARTITION BY doc_id) AS n, {", ".join(f"(length(lower(content)) - length(replace(lower(content), '{t}', ''))) // {len(t)} AS k_{k}" for k, t in SECTIONS.items())} FROM paras),
s AS ({" UNION ALL ".join(f"SELECT doc_id, '{k}' AS sec, chunk_no, k_{k} AS k FROM h" for k in SECTIONS)}),
seed AS (SELECT doc_id, chunk_no FROM h WHERE chunk_no = 1 OR chunk_no = n UNION SELECT doc_id, chunk_no FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, sec ORDER BY k DESC, chunk_no) AS r FROM s) WHERE r <= 2 AND k > 0),
size AS (SELECT doc_id, count(*) AS m FROM seed GROUP BY 1), nx AS (SELECT doc_id, chunk_no FROM (SELECT h.doc_id, h.chunk_no, m, row_number() OVER (PARTITION BY h.doc_id ORDER BY h.chunk_no) AS r FROM seed JOIN h ON h.doc_id = seed.doc_id AND h.chunk_no = seed.chunk_no + 1 JOIN size ON size.doc_id = h.doc_id WHERE NOT EXISTS (SELECT 1 FROM seed x WHERE x.doc_id = h.doc_id AND x.chunk_no = h.chunk_no)) WHERE r <= 12 - m),
two AS (SELECT * FROM seed UNION SELECT * FROM nx), size2 AS (SELECT doc_id, count(*) AS m FROM two GROUP BY 1),
more AS (SELECT doc_id, chunk_no FROM (SELECT h.doc_id, h.chunk_no, m, row_number() OVER (PARTITION BY h.doc_id ORDER BY {" + ".join(f"k_{k}" for k in SECTIONS)} DESC, h.chunk_no) AS r FROM h JOIN size2 ON size2.doc_id = h.doc_id WHERE NOT EXISTS (SELECT 1 FROM two x WHERE x.doc_id = h.doc_id AND x.chunk_no = h.chunk_no)) WHERE r <= 12 - m)
SELECT doc_id, chunk_no FROM h WHERE n <= 12 UNION SELECT doc_id, chunk_no FROM (SELECT * FROM two UNION SELECT * FROM more) p WHERE (SELECT max(n) FROM h WHERE h.doc_id = p.doc_id) > 12"""


@query(PACK)
def context_pack(spark, sf_dir):
    return ranking.context_pack(paras(spark, sf_dir), "doc_id", "chunk_no", "content", {"a": ["ing"], "b": ["tion"], "c": ["heit"], "d": ["ment"]}, ["the"]).select("doc_id", "chunk_no")


@query(FOLD + """, l AS (SELECT doc_id, chunk_no, chunk_no // 40 AS page, content AS c, length(content) AS n, regexp_matches(content, '^(?:第?[一二三四五六七八九十0-9]+[、.章节]|#+ )') AS title FROM paras),
w AS (SELECT doc_id, chunk_no, page, n AS held, right(c, 1) AS tail, title, CAST(1 AS BIGINT) AS id FROM l WHERE chunk_no = 1
UNION ALL SELECT doc_id, chunk_no, page, CASE WHEN new THEN n ELSE held + n + CASE WHEN joined THEN 1 ELSE 0 END END, right(c, 1), title, CASE WHEN new THEN id + 1 ELSE id END FROM (SELECT l.*, w.held, w.id, regexp_matches(w.tail, '^[A-Za-z0-9]$') AND regexp_matches(l.c, '^[A-Za-z0-9]') AS joined,
w.title OR l.title OR l.page <> w.page OR w.held >= 420 OR l.n > 500 OR (w.tail IN ('。', '！', '？', '.', '!', '?') AND w.held >= 180 AND l.n > 90) AS new FROM w JOIN l ON l.doc_id = w.doc_id AND l.chunk_no = w.chunk_no + 1))
SELECT doc_id, id AS chunk_no, CAST(max(held) AS INTEGER) AS n_chars FROM w GROUP BY 1, 2""")
def paragraph_merge(spark, sf_dir):
    rows = paras(spark, sf_dir).withColumn("page", F.floor(F.col("chunk_no") / 40))
    return build.merge_lines(rows, "doc_id", "chunk_no", "page", "content").select(F.col("doc").alias("doc_id"), "chunk_no", F.length("content").alias("n_chars"))

"""Queries over conversations: as-of pairing, memory, versions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import joins, state
from ..sources import tables as S
from .registry import query


@query("SELECT conv_id, turn, coalesce(md5(q), '') AS question FROM (SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q FROM conversations) WHERE role = 'assistant'")
def asof_previous_user(spark, sf_dir):
    rows = joins.previous(S.table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "user", "text", "question")
    return rows.filter("role = 'assistant'").select("conv_id", "turn", F.coalesce(F.md5("question"), F.lit("")).alias("question"))


@query("SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'user') AS users, max(turn) + 1 AS next_turn FROM conversations GROUP BY 1")
def version_next(spark, sf_dir):
    return S.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "user").alias("users"), (F.max("turn") + 1).alias("next_turn"))


MSG = "m AS (SELECT conv_id * 1000 + turn AS id, CASE WHEN turn % 3 = 0 THEN NULL ELSE conv_id * 1000 + turn - 1 END AS parent, CASE WHEN turn % 6 = 0 THEN conv_id * 10 + turn // 6 END AS grp, turn FROM conversations)"


@query(f"WITH RECURSIVE {MSG}, up AS (SELECT id, id AS top_id, parent, grp FROM m UNION ALL SELECT up.id, m.id, m.parent, m.grp FROM up JOIN m ON m.id = up.parent WHERE up.grp IS NULL), roots AS (SELECT id, top_id AS root FROM up WHERE grp IS NOT NULL OR parent IS NULL OR parent NOT IN (SELECT id FROM m)) SELECT root, count(*) AS total, min(m.turn) AS place, max(m.id) AS latest FROM roots JOIN m USING (id) GROUP BY 1")
def version_collapse(spark, sf_dir):
    c = S.table(spark, sf_dir, "conversations")
    key = F.col("conv_id") * 1000 + F.col("turn")
    m = c.select(key.alias("id"), F.when(F.col("turn") % 3 != 0, key - 1).alias("parent"), F.when(F.col("turn") % 6 == 0, F.col("conv_id") * 10 + F.floor(F.col("turn") / 6)).alias("grp"), F.col("turn").alias("turn"))
    roots = state.version_roots(m, "id", "parent", "grp")
    return state.collapse_versions(roots.join(m.select("id", "turn"), "id").withColumnRenamed("root", "r"), "r", "id", "turn").select(F.col("r").alias("root"), "total", "place", F.col("id").alias("latest"))


@query("SELECT conv_id, count(*) AS n_new FROM conversations WHERE turn > conv_id % 3 GROUP BY 1")
def after_mark(spark, sf_dir):
    c = S.table(spark, sf_dir, "conversations")
    mark = c.select("conv_id").distinct().withColumn("covered", F.col("conv_id") % 3)
    return state.after(c, mark, "conv_id", "turn").groupBy("conv_id").agg(F.count("*").alias("n_new"))


@query("""WITH c AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS t FROM conversations WHERE role = 'user') SELECT conv_id, turn,
CASE WHEN regexp_matches(t, 'blest|schung|ouvi|ciones') THEN 'preference' WHEN regexp_matches(t, 'with[^，。；,.;]*(this|that)') THEN 'region' WHEN regexp_matches(t, 'eaha|ment') THEN 'habit' ELSE 'preference' END AS kind,
CAST(CASE WHEN regexp_matches(t, 'blest|schung|ouvi|ciones') THEN 0.85 WHEN regexp_matches(t, 'with[^，。；,.;]*(this|that)') THEN 0.8 WHEN regexp_matches(t, 'eaha|ment') THEN 0.6 ELSE 0.5 END AS DOUBLE) AS confidence FROM c WHERE regexp_matches(t, 'the |que|der ')""")
def memory_candidates(spark, sf_dir):
    """The rule of memory candidates with a vocabulary of the given texts: markers, hazards, followed regions, habits."""
    found = state.memory_candidate(F.col("text"), ("the ", "que", "der "), ("blest", "schung", "ouvi", "ciones"), ("with",), ("this", "that"), ("eaha", "ment"))
    rows = S.table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", found.alias("x")).filter("x is not null")
    return rows.select("conv_id", "turn", F.col("x.type").alias("kind"), "x.confidence")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 5 AS active FROM conversations")
def newest_active(spark, sf_dir):
    n = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    return S.table(spark, sf_dir, "conversations").select("conv_id", "turn", (n <= 5).alias("active"))


@query("""WITH n AS (SELECT conv_id, coalesce(length(text), 0) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations),
g AS (SELECT conv_id, count(*) AS n_turns, CAST(count(*) FILTER (rn <= 6) AS INTEGER) AS n_recent, sum(n) FILTER (rn <= 6) + count(*) FILTER (rn <= 6) - 1 AS r, CAST(least(2200, coalesce(sum(n) FILTER (rn > 6), 0) + greatest(count(*) FILTER (rn > 6) - 1, 0)) AS INTEGER) AS summary_chars FROM n GROUP BY 1)
SELECT conv_id, n_turns, n_recent, summary_chars, CAST((r + summary_chars) // 4 AS BIGINT) AS tokens, (r + summary_chars) // 4 > 4200 AS over_budget FROM g""")
def session_memory_fold(spark, sf_dir):
    rows = state.memory_fold(S.table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return rows.select("conv_id", "n_turns", F.size("recent").alias("n_recent"), F.length("summary").alias("summary_chars"), "tokens", "over_budget")

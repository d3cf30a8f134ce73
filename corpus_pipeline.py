"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the
last return the columns of ``documents``. Between stages the rows are written as Parquet and read
again, so that a lost executor costs no earlier stage, and executors give back the heap that a stage needed before the next begins. SQL cannot express it (a conditional random
field, graph components): the tests hold each stage against a plain version instead.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm.common import give_heap_back, materialize, remove
from caseloom.llm.decontamination import contaminated
from caseloom.llm.packing import pack
from caseloom.llm.pii import sanitise
from caseloom.llm.simhash import near_duplicate_groups
from caseloom.llm.toxicity import held_out, score_toxicity
from caseloom.operators.order import placed

BROADCAST_ROWS = 1_000_000  # ids that may be broadcast; more are shuffled


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """(docs with one more column that tells rows apart, its name): doc_id, where no doc_id is null or there twice.

    Otherwise the rows are numbered in the order of doc_id (nulls last) and text: two texts of one doc_id are
    two documents, and so are all those without one.
    """
    name = "_row"
    while name in docs.columns:
        name += "_"
    unclear = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null")
    if unclear.isEmpty():
        return docs.withColumn(name, F.col("doc_id").cast("long")), name
    return materialize(placed(docs, [F.col("doc_id").asc_nulls_last(), F.md5(F.coalesce("text", F.lit("")))], name=name), "numbered"), name


def _documents(rows: DataFrame, name: str) -> DataFrame:
    """What the operators read, under the rows' own numbers."""
    return rows.select(F.col(name).alias("doc_id"), "text")


def _without(rows: DataFrame, name: str, found: DataFrame, columns: list[str], tag: str) -> DataFrame:
    """The rows whose number is not among those found, in the documents' columns."""
    gone = materialize(found.select(F.col("doc_id").alias(name)).distinct(), tag)
    return rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, name, "left_anti").select(*columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.7 or more go; every row is judged by its own text, with or without a doc_id.

    Null, empty and wordless texts stay; very long ones are scored whole; an empty table gives none; other columns stay as they are.
    """
    give_heap_back(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out(3, 1))
    rows, name = _numbered(docs)
    return _without(rows, name, score_toxicity(docs, labels, _documents(rows, name)).filter("score >= 0.7"), docs.columns, "toxic")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8) one row stays: that of the least doc_id.

    Rows without a doc_id come after all others of their group; of several rows of one doc_id that are near
    copies the one of least MD5 of its text stays, of equal rows one; unlike texts of one doc_id all stay.
    Texts without a word are copies of each other. Very long texts are compared by all shingles; an empty table gives none.
    """
    give_heap_back(spark)
    rows, name = _numbered(docs)
    groups = near_duplicate_groups(_documents(rows, name), k=5, similarity=0.8)
    return _without(rows, name, groups.filter("doc_id <> component_id"), docs.columns, "copies")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; every row is judged by its own text, with or without a doc_id.

    Null and empty texts stay; very long ones are read whole; an empty table, or benchmark, takes none; other columns stay as they are.
    """
    give_heap_back(spark)
    rows, name = _numbered(docs)
    return _without(rows, name, contaminated(_documents(rows, name), spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs.columns, "leaks")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by labels; every row stays, null and empty texts as they are, equal rows alike."""
    give_heap_back(spark)
    clean = sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1,024 token ids, a row for each piece of a document; null and empty texts are one id, the end."""
    give_heap_back(spark)
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), window=1024, end_id=0)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        read, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if i:  # the input stays
            remove(spark, read)
    return STAGES[-1][1](spark, docs, sf_dir)

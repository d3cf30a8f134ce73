"""The registered queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .block_search import top_products
from .common import documents, materialize, new_path
from .conversations import audits, damaged, digests, repaired, turns_of
from .decontamination import contaminated
from .merkle import FIELDS, leaf, manifest
from .packing import pack
from .pii import private_spans
from .quality_knn import score_quality
from .quality_rules import judge_quality
from .simhash import near_duplicates
from .suffix_dedup import removed
from .token_counts import count_tokens
from .token_files import read_token_files, write_token_files
from .tokens import encoder
from .toxicity import held_out, score_toxicity

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir), k=3, radius=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = documents(spark, sf_dir, "labels").filter(~held_out(3, 1))
    found = score_toxicity(documents(spark, sf_dir), learn)
    return found.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_toxic_tokens", F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("spans"))


def op3_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = documents(spark, sf_dir, "labels").filter(~held_out(5, 0))
    found = score_quality(documents(spark, sf_dir), learn)
    return found.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_spans(documents(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), BPE).withColumn("over_limit", F.col("n_tokens") > 1024)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), BPE, window=1024, end_id=0)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(documents(spark, sf_dir), length=50)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(documents(spark, sf_dir))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "token-files")
    shards = write_token_files(documents(spark, sf_dir), folder, BPE, end_id=2)
    return read_token_files(spark, folder, shards, 2 if encoder(BPE).typecode == "H" else 4)


def op11_block_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(documents(spark, sf_dir, "embeddings"), k=5, every=50).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    lower = F.translate("text", UPPER, UPPER.lower())
    altered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf([lower if c == "text" else F.col(c) for c in FIELDS]))
    found = manifest(docs, "doc_id", "source", FIELDS, altered).withColumns({"doc_id": F.col("key"), "proof_sha256": F.sha2("proof", 256), "folded_root": F.col("folded")})
    return materialize(found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded") == F.col("root")).alias("verified")), "manifest")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir, "conversations")
    turns = damaged(turns_of(rows))
    solved = materialize(audits(turns), "audits")
    hashed = digests(repaired(turns, solved))
    conv_id = F.when(F.col("conv") != "-", F.substring("conv", 2, 1 << 30)).cast(rows.schema["conv_id"].dataType).alias("conv_id")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    return solved.join(hashed, "conv", "left").select(conv_id, *counts, F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def queries() -> dict:
    return {n: f for n, f in globals().items() if n.startswith("op") and callable(f)}

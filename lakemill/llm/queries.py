"""The queries of this subpackage: each applies one operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.llm import bpe, decontam, kdshard, langid, linededup, lmscore, pq, rans, simhash, toxicity
from lakemill.llm.workspace import documents, fold


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lmscore.score_texts(documents(spark, sf_dir), fold("doc_id", 5) != 1)
    return found.withColumn("held_out", fold("doc_id", 5) == 1).withColumn("bits_per_byte", -F.col("score") / F.lit(0.30102999566398120) / F.greatest("n_bytes", F.lit(1)))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.train(docs, fold("doc_id", 4) != 2)
    found = langid.identify(docs, model)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op3_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = kdshard.kd_shards(documents(spark, sf_dir), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(documents(spark, sf_dir), shingle=3, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold("doc_id", 5) != 0)
    found = toxicity.toxicity(docs, model)
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = rans.new_folder(spark)
    rans.write_tokens(documents(spark, sf_dir), rans.default_vocabulary(), folder, end_id=2)
    found = rans.read_tokens(spark, folder)
    return found.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), cosine=0.93)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup(documents(spark, sf_dir))


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(bpe.encode_decode(documents(spark, sf_dir), bpe.default_vocabulary()))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_scores": op1_lm_scores,
        "op2_language_id": op2_language_id,
        "op3_kd_shards": op3_kd_shards,
        "op4_simhash_components": op4_simhash_components,
        "op5_toxicity": op5_toxicity,
        "op6_token_file": op6_token_file,
        "op7_near_vectors": op7_near_vectors,
        "op8_line_dedup": op8_line_dedup,
        "op9_bpe_codec": op9_bpe_codec,
        "op10_decontamination": op10_decontamination,
    }


def oracle_sql() -> dict[str, str]:
    """What SQL can express; the other queries are tested against brute force in tests/llm."""
    return {"op7_near_vectors": pq.duckdb_sql(), "op8_line_dedup": linededup.duckdb_sql()}

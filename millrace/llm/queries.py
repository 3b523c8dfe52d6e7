"""The registered queries of the corpus operators; each runs over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, mixing, packed_ids, quality_model, quality_rules, quality_sql, secrets, sharding, simhash, token_counts, topk
from millrace.llm.common import read, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


@query("op8_bpe_round_trip")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(spread(read(spark, sf_dir, "documents")))


@query("op9_token_counts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.write_and_count(spread(read(spark, sf_dir, "documents"))).select("doc_id", "n_tokens", "file", "start")


@query("op10_packed_ids")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_ids.write_and_read(read(spark, sf_dir, "documents"))


@query("op5_quality_rules", quality_sql.ORACLE)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rules(spread(read(spark, sf_dir, "documents")))


@query("op1_simhash_classes")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(spread(read(spark, sf_dir, "documents")))


@query("op2_secret_spans")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(spread(read(spark, sf_dir, "documents")))


@query("op3_histogram_shards")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(read(spark, sf_dir, "documents").select("doc_id", "text"))
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op4_curriculum_mix", mixing.ORACLE)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spread(read(spark, sf_dir, "documents")))


@query("op6_quality_scores")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.scores(spread(read(spark, sf_dir, "documents")), read(spark, sf_dir, "labels"))


@query("op7_bit_sliced_topk", topk.ORACLE)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_ten(read(spark, sf_dir, "embeddings"))

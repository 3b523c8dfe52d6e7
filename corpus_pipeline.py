"""The corpus pipeline: STAGES in order, each over all rows its predecessor kept.

1. quality rules: rejected documents go, failing lines are taken out of the others;
2. near-duplicates: the document of least doc_id of each SimHash class stays;
3. secrets: every span found is replaced by ``[SECRET]``;
4. mixing: documents come as often as their source's target needs, in training order;
5. BPE: each text is encoded and decoded again; ids and text are returned as digests.

All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, mixing, quality_rules, secrets, simhash
from millrace.llm.common import spread, stored


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    packed = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))
    kept = quality_rules.judged(packed, also=("_row",)).where("kept")
    new = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    return kept.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.training_order(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs)


STAGES = [("quality_rules", clean), ("near_duplicates", distinct), ("secret_scan", redact), ("source_mix", mix), ("bpe", encode)]
#: SQL has neither the fingerprints nor the tokenizer; tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

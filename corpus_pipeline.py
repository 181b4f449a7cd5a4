"""Cleaning of a corpus: the operators one after the other, each on what its predecessor kept.

toxicity      documents that the classifier calls toxic go
near_dedup    of each group of documents whose SimHash fingerprints (3-word shingles) are linked by 3
              differing bits or fewer the one with the smallest doc_id stays
benchmark     documents that hold a passage of the benchmark go
pii           personal data gives way to typed marks; n_chars follows the text
bpe           ids and decoded text of what is left

Null and empty texts pass every stage: they hold nothing to reject, but empty texts are equal, so
near_dedup leaves one of them. Rows with a null or repeated doc_id are judged one by one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runsift.llm import bpe, decontaminate, pii, simhash, toxicity
from runsift.llm.common import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, threshold=0.3).where("predicted = 0").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs).select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.find_pii(docs).withColumn("text", F.col("redacted"))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        clean = clean.withColumn("n_chars", F.when(F.size("pii") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return clean.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", near_dedup),
    ("benchmark", drop_benchmark),
    ("pii", redact_pii),
    ("bpe", encode),
]

#: The classifier, the fingerprints and the merges are beyond SQL; tests/llm compares run() with
#: a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

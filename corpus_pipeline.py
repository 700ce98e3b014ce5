"""A corpus through five stages: each reads what its predecessor kept, as Parquet.

Stages take (spark, docs, sf_dir). All but the last return documents' own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import decontam, mixing, near_dup, token_store, toxicity
from tracewell.llm._common import held_out, read, store


def toxic_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learnt from the labelled rows outside the held-out fold; a score of 0.7 or more rejects."""
    model = toxicity.fit(docs.where(~held_out("doc_id", 3, 1)), read(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_store.token_digests(docs)


STAGES = [
    ("toxicity", toxic_documents_go),
    ("near_dedup", one_of_each_group),
    ("decontamination", without_benchmark),
    ("source_mix", mixed_sources),
    ("token_files", token_files),
]

#: Fitting, fingerprints and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over the whole of ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), spark)
    return docs

"""A corpus through five stages: toxic documents, exact copies, near copies and benchmark leaks go, and what
stays is mixed to the sources' target weights. Each stage gets all that the one before it kept.

Near copies are texts whose sets of five words are similar by 0.8 or more. Texts that are null count as empty, so
of those without words one row stays; of equal rows one stays, and rows with a null id give way to others; empty
tables give empty results; extra columns stay as they are, whatever their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from metaudit.llm import decontaminate, exact_dedup, mixing, near_dedup, toxicity
from metaudit.llm.common import drop_stored, materialise, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_copies(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
]

#: Learned weights and streaming state are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), stored(spark)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop_stored(spark, before, [docs])  # what the stage wrote besides, and the stage before
    return STAGES[-1][1](spark, docs, sf_dir)

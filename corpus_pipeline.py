"""The corpus pipeline: five stages over ``documents``, each written as Parquet and reread as the next one's input.

Every stage is a function of (spark, docs, sf_dir) and works on all rows that its predecessor kept. ``run`` applies
them in order. Between stages ``run`` cuts lineage with a table in the folder that spark.checkpoint.dir names, so a
lost executor costs one stage's tasks and no more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attestra.llm import decontaminate, langid, mixing, neardup, quality
from attestra.llm.common import discard, stored, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language that was learnt: without a letter, or coded about equally by two."""
    return langid.in_known_language(docs)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of low quality; learns from the rows of ``labels`` whose documents are still there."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each near-duplicate group (shingles of five words, similarity 0.8)."""
    return neardup.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain windows of ``benchmark`` in at least a twentieth of their words."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents until each source meets its target; ``repeats`` says how often each is to be seen."""
    return mixing.mixed_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("quality_classifier", classify_quality),
    ("minhash_neardup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
]

#: Language identification and the classifier are no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's table goes once the next is written; the last one's goes when the driver ends."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        written = stored(stage(spark, docs, sf_dir))
        discard(before)
        docs = before = written
    return docs

"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

A document goes when it is toxic, when line dedup leaves nothing of it, when an earlier document of its
SimHash group stays, or when benchmark passages fill a twentieth of it; the last stage says how many words of each
document a mix of the sources takes. The stages judge whole texts and all documents that reach them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import decontaminate, line_dedup, mixing, simhash, toxicity
from tickloom.llm.common import discard, staged, table, tidy

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores below one half."""
    tidy(spark)
    return toxicity.harmless(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier line equals or nearly equals; n_chars is that of the new text."""
    tidy(spark)
    return line_dedup.strip_documents(docs)


def dedup_simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id."""
    tidy(spark)
    return simhash.one_of_each(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages do not fill by a twentieth."""
    tidy(spark)
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    tidy(spark)
    return mixing.mix(docs).drop("n_copies")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", remove_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_simhash),
    ("decontamination", decontaminate_benchmark),
    ("mixing", mix_sources),
]

#: Learned scores and seeded rounding are beyond SQL; the tests hold all stages against brute force, one after another, and the whole run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*(F.col(c) for c in COLUMNS))
    for name, stage in STAGES:
        before, docs = docs, staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return docs


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)

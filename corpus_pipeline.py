"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolegrid.llm import decontaminate, language, line_dedup, mixing, simhash
from rolegrid.llm.common import free_name, staged


#: A document whose shortest code is no better than eight bits a byte is in no learned language.
MOST_BITS = 8.0


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those that no learned language can code, go; ``lang`` becomes the prediction."""
    model = language.fit(docs.where(~F.coalesce(language.fold_of("doc_id", 4) == 2, F.lit(False))))
    name = free_name(docs, "found")
    found = language.with_language(docs, model, name)
    known = found.where((F.col(f"{name}.lang") != language.UNKNOWN) & (F.col(f"{name}.bits") < MOST_BITS))
    return known.withColumn("lang", F.col(f"{name}.lang")).drop(name)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents at least go, but for their first occurrence."""
    return line_dedup.dedup_lines(docs, keep="first", min_docs=10)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays; a class is tied by shared shingles of five words, 0.8 of them or more."""
    return simhash.drop_near_copies(docs, radius=18, similarity=0.8)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose expected tokens have the target shares of sources, languages and topics."""
    return mixing.sample(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("languages", keep_known_languages),
    ("lines", drop_repeated_lines),
    ("near_copies", drop_near_copies),
    ("benchmark", drop_benchmark_copies),
    ("mix", mix_sources),
]

#: SQL cannot express the language model of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs

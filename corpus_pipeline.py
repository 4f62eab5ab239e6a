"""From raw documents to token files: language, near duplicates, benchmark passages, mixture, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.llm import decontaminate, language, mixing, near_dedup, token_files
from trackspark.sources.ship import ship
from trackspark.sources.tables import stored


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts without letters and texts unlike every language go."""
    ship(spark)
    return language.accepted(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id. Rows of one id are one document."""
    ship(spark)
    gone = near_dedup.near_groups(docs).where("not kept").select("doc_id").distinct()
    # what is dropped grows with the documents, so it is never broadcast
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def in_target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample in the target mixture of sources, languages and topics."""
    ship(spark)
    return mixing.sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def as_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left; one row per document as read back from them."""
    ship(spark)
    return token_files.tokens_by_files(docs)


STAGES = [
    ("language_id", known_language),
    ("near_dedup", one_of_each_group),
    ("decontaminate", without_benchmark),
    ("mixing", in_target_mix),
    ("token_files", as_token_files),
]
#: Sketches, tiles and range coding are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs

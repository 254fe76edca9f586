"""The corpus pipeline: toxicity, quality, near duplicates, decontamination, mixing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which the caller writes as Parquet
and hands to the next stage. All stages but the last return the columns of their input, whatever further ones
it has and however they are named; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import decontaminate, mixing, neardup, quality, toxicity
from corpusloom.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with P(grade >= 1) of 1/2 or more. Null and empty texts and, without labels, all documents stay;
    repeated rows share their fate."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.drop_toxic(docs, model)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what importance resampling draws; the draw is as large as the good part of the documents is estimated to be.
    Null and empty texts weigh 0; rows with equal id and text share their fate; without good labels all stay."""
    return quality.resample(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))[1]


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates, null ids last. Texts without words stay;
    repeated rows of the one that stays are one."""
    return neardup.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item. Null and empty texts, and with an empty benchmark all
    documents, stay; repeated rows share their fate."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark", "item_id", "text"), mode="documents")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document and at which training positions, range-sorted by the first of them. Null texts
    have no words and are not taken; of repeated rows each is a document."""
    return mixing.by_position(mixing.mix(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]
#: Trained models stand in the first stages, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

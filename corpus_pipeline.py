"""A corpus pipeline: language id, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwave.llm import decontam, langid, mixing, sharding, simhash
from duskwave.llm.common import put_back, set_aside, stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those with null text or without a letter go."""
    model = langid.fit(docs, langid.part_of(F.col("doc_id")) != 2)
    rows, names = set_aside(docs, ("text",))
    found = langid.identify(rows, model, names)
    return put_back(found.where(F.col("lang_pred") != langid.UND), names, docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class, that with the smallest doc_id."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    rows, names = set_aside(docs, ("text",))
    found = decontam.contamination(rows, table(spark, sf_dir, "benchmark"), names)
    return put_back(found.where(F.size("hits") == 0), names, docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each draw of the mix; texts stay whole."""
    return mixing.mix(docs, whole=True)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row."""
    return sharding.assign_shards(docs, carry=("lang", "source", "n_chars"))


STAGES = [("language id", language), ("near-dedup", near_dedup), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]

#: Language id, fingerprints and the permutations of mixing and sharding are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{k}")
    return docs

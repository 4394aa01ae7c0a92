"""The training-data pipeline: five stages, each one of the operators of ``faultline.llm``.

A stage takes the session, the rows its predecessor kept, and the folder of the shared tables.
``run`` writes each stage's rows as Parquet in the folder all executors share and reads them
again, so a lost executor costs at most one stage's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import contamination, mixing, quality, sharding, simhash
from faultline.llm.common import fresh, set_aside, table
from faultline.llm.queries import QUALITY_CUT, SHARDS, quality_model


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble does not reject; empty texts are scored like others."""
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    plain, back = set_aside(docs, "__score", "__stats")
    scored = quality.with_score(plain, model, "__score")
    return back(scored.where(F.col("__score") >= QUALITY_CUT))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one with the smallest id."""
    return simhash.one_per_component(docs, 3, 3)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which benchmark windows hit less than one word in twenty."""
    plain, back = set_aside(docs, "n_words", "spans", "items", "clean_text")
    found = contamination.find_contamination(plain, table(spark, sf_dir, "benchmark"))
    return back(found.where(~contamination.is_contaminated()))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their source takes them."""
    return mixing.mixed(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as it is, with its shard and slot; copies of a text share a shard."""
    return sharding.with_shards(docs, SHARDS)


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("sharding", sharding_stage),
]

#: The learned rules of the first stage are not SQL; the tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = fresh(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs

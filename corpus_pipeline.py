"""The corpus pipeline: toxic documents go, one document of each near-duplicate group stays, contaminated documents
go, the sources are mixed to their target weights, and what is left is put into shards of equal bytes.

Every stage reads all rows of the one before and works on whole texts. A stage written as Parquet and read again is
a restart point; a lost executor costs the running stage's tasks only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattframe.llm.decontaminate import drop_contaminated
from wattframe.llm.minhash import drop_near_duplicates
from wattframe.llm.mixing import curriculum_mix
from wattframe.llm.registry import table
from wattframe.llm.sharding import histogram_shards
from wattframe.llm.toxicity import score_documents, train
from wattframe.session import materialize

SHARDS = 8
#: Documents of this similarity (percent) are near duplicates here; op6 has a contract of its own.
NEAR_PERCENT = 80
#: The trained model, the hashed signatures and the hash orders of the stages have no SQL; tests use brute force.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trains on the labelled documents of this stage's input and keeps what is not predicted toxic."""
    model = train(docs, table(spark, sf_dir, "labels"))
    whole = docs.select(F.struct("*").alias("_row"), F.col("text").alias("_text"))
    scored = score_documents(whole, model, text="_text")
    return scored.where(F.col("predicted") == 0).select("_row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8 or more stays, the one with the smallest id."""
    return drop_near_duplicates(docs, percent=NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more lies in windows of the benchmark go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once per reading, in training order; documents beyond their source's target go."""
    return curriculum_mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with `size`, `shard` and `slot`."""
    return histogram_shards(docs, shards=SHARDS)


STAGES = [
    ("toxicity", toxicity),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", mixing),
    ("histogram_sort_sharding", sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

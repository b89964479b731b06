"""From raw documents to packed training batches: toxicity, near duplicates, repeated passages, mixing, packing."""

import uuid

from pyspark.sql import DataFrame, SparkSession

from wiretally.llm import mixing, packing, simhash, suffixes, toxicity
from wiretally.llm.common import table
from wiretally.session import checkpoint_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7 (operator 8); the model learns from the labels of the folder's documents."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (operator 10)."""
    return simhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 bytes or more that a document of smaller doc_id holds (operator 2)."""
    return suffixes.trimmed(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (operator 4)."""
    return mixing.repeated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batch of each document (operator 5)."""
    return packing.packed(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("repeated_passages", cut_repeats),
          ("source_mixing", mix_sources), ("packing", pack)]

#: No SQL: the first three stages rest on compressed lengths, fingerprints and bytes; tests/llm checks each by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{checkpoint_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return docs

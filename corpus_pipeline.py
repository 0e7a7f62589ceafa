"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

Language ID drops rejected documents, near-dedup keeps one document of each group (5-word shingles,
similarity of 0.8 or more), substring dedup cuts passages that an earlier document has, mixing draws the sources' blocks to their target
weights, byte-level BPE encodes what is left and checks the round trip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Trained centroids, connected components and BPE can't be said in SQL; tests hold the stages
#: against brute-force versions.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go: without a letter, or far from every centroid."""
    from pyspark.sql import functions as F

    from stratapool.llm import langid

    return langid.drop_rejected(docs, langid.train(docs, F.lit(True)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one of the smallest doc_id."""
    from stratapool.llm import simhash

    return simhash.near_dedup(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 50-word windows that a document of smaller doc_id has too go."""
    from stratapool.llm import substrings

    return substrings.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each document and epoch, of the blocks that the mix takes."""
    from stratapool.llm import mixing

    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of an exact round trip, one row for each row of the mix."""
    from stratapool.llm import bpe

    return bpe.digests(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; every stage reads what the one before has written."""
    from stratapool.llm.common import Workspace

    with Workspace(spark) as ws:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        for k, (_, stage) in enumerate(STAGES):
            after = stage(spark, docs, sf_dir)
            if k == len(STAGES) - 1:
                return ws.result(after)
            before, docs = docs, ws.save(after)
            if k:
                ws.drop(before)

"""The corpus pipeline: stages over documents, each written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pointloom.llm import langid, mixing, near_copies, packing, suffix_dedup
from pointloom.llm.common import checkpoint_folder, delete, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is told; what it learns from are these documents."""
    path = langid.public_vocabulary()
    return langid.keep_known(docs, langid.train(docs, path), path)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked at a similarity of 0.8 or more on five-word shingles.

    Candidates are operator 7's links of fingerprints, at six bits, and texts that share bands of minimum hashes.
    """
    return near_copies.keep_one(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that stand in an earlier place already."""
    return suffix_dedup.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw documents so that sources come near their target weights."""
    return mixing.drawn(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the tokens of all documents into sequences."""
    return packing.pack(docs, packing.public_tokenizer())


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeated_passages),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]
#: Fingerprints, suffix order and tokens have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; what each keeps is written to the shared folder for the next.

    A stage's table is deleted once the next one is written; the last one stays, as the result reads it.
    """
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        here = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(here)
        if last:
            delete(spark, last)
        docs, last = spark.read.parquet(here), here
    return docs

"""A pipeline from raw documents to packed training sequences.

Each stage reads what the one before wrote. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import table
from tidemark.llm.jaccard import keep_one
from tidemark.llm.mixing import take_mix
from tidemark.llm.packing import pack_documents
from tidemark.llm.queries import TOKENIZER
from tidemark.llm.recipes import drop_copies
from tidemark.llm.toxicity import drop_toxic
from tidemark.session import ensure_checkpoint_dir, ship_package


def drop_toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score counts as toxic go."""
    return drop_toxic(docs, table(ship_package(spark), sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    ship_package(spark)
    return drop_copies(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that links of 0.8 or more connect, the one with the smallest id stays."""
    ship_package(spark)
    return keep_one(docs)


def mix_by_weight(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its source's target takes it."""
    ship_package(spark)
    return take_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their token ids, placed in sequences."""
    ship_package(spark)
    return pack_documents(docs, TOKENIZER, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic_documents),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_duplicates),
    ("source_mix", mix_by_weight),
    ("packing", pack_sequences),
]

#: SQL has no compression distance, subset sum or tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each but the last returns is written to the shared folder and read again."""
    ship_package(spark)
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            path = f"{folder}/{number}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs

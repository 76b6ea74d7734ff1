"""A training-data pipeline of the corpus operators over ``documents``.

Stages in order: documents whose toxicity score is 0.3 or more go; of each
group of near duplicates the smallest doc_id stays; documents that hold a test
item go; personal data is replaced by its kind; what is left is packed.  Each
stage is fitted or counted on what the stage before kept, and its decisions
take effect: all but the last return rows of ``documents`` with all columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bytespan.llm import decontaminate, minhash, packing, pii, toxicity
from bytespan.llm.common import kept, table


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.without_copies(docs)


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", remove_leaks),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]

#: A fitted score, a random field and a packing search have no SQL form; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = kept(docs)   # written as Parquet and read again
    return docs

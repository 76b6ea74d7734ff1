"""Deterministic annotations on the driver's ``documents`` table.

The driver tables carry no entity annotations, so a rule that both Spark
and DuckDB evaluate identically provides gold and predicted spans:

Gold: words of the text with newlines read as spaces, split on one space;
``i`` is the word index from 0, ``len`` its byte length, ``start`` the byte
offset (running sum of len + 1); empty words are dropped; type is
``contact`` when the word has '@', else ``number`` when it has a digit,
else ``name`` when it starts with A-Z, else no span.

Prediction: gold without word indexes divisible by 7; words whose length
is a multiple of 5 (and > 1) lose their first byte; every 11th word index
is typed ``name``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bytes import utf8_bytes
from ..operators.words import typed_words, words  # noqa: F401


#: Session option: partitions that text tables are dealt to after the scan.
SPREAD = "spark.bytespan.spread"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read a driver table as its files are split.

    A table in one parquet row group is one task; a session that reads such
    files can set ``SPREAD`` to deal rows of text tables out by their key.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    key = {"documents": "doc_id", "conversations": "conv_id", "benchmark": "item_id",
           "pages": "page_id"}.get(name)
    parts = spark.conf.get(SPREAD, None)
    if key is not None and parts:
        df = df.repartition(int(parts), key)
    return df


def docs_from_documents(documents: DataFrame) -> DataFrame:
    """documents(doc_id, text, ...) -> docs(doc_id, body binary)."""
    return documents.select("doc_id", utf8_bytes("text").alias("body"))


def gold_spans(documents: DataFrame) -> DataFrame:
    """Gold spans (doc_id, ord, start, len, type); ord = word index."""
    return typed_words(documents, ("contact", "number", "name"))


def pred_spans(gold: DataFrame) -> DataFrame:
    """Perturbed prediction derived from gold spans."""
    shrink = (F.col("len") % 5 == 0) & (F.col("len") > 1)
    return (gold.filter(F.col("ord") % 7 != 0)
            .select("doc_id", "ord",
                    F.when(shrink, F.col("start") + 1).otherwise(F.col("start")).cast("int").alias("start"),
                    F.when(shrink, F.col("len") - 1).otherwise(F.col("len")).cast("int").alias("len"),
                    F.when(F.col("ord") % 11 == 0, F.lit("name")).otherwise(F.col("type")).alias("type")))


# DuckDB equivalents (the oracle side of the same rule).
SQL_WORDS = """
  SELECT doc_id, i, CAST(coalesce(sum(strlen(word) + 1) OVER (PARTITION BY doc_id ORDER BY i
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start,
         CAST(strlen(word) AS INTEGER) AS len, word
  FROM (SELECT doc_id, unnest(ws) AS word, CAST(generate_subscripts(ws, 1) - 1 AS INTEGER) AS i
        FROM (SELECT doc_id, string_split(replace(text, chr(10), ' '), ' ') AS ws FROM documents))
"""

SQL_GOLD = f"""
  SELECT doc_id, i AS ord, start, len,
         CASE WHEN contains(word, '@') THEN 'contact'
              WHEN regexp_matches(word, '[0-9]') THEN 'number'
              WHEN regexp_matches(word, '^[A-Z]') THEN 'name' END AS type
  FROM ({SQL_WORDS}) w
  WHERE len > 0 AND (contains(word, '@') OR regexp_matches(word, '[0-9]') OR regexp_matches(word, '^[A-Z]'))
"""

SQL_PRED = f"""
  SELECT doc_id, ord,
         CAST(CASE WHEN len % 5 = 0 AND len > 1 THEN start + 1 ELSE start END AS INTEGER) AS start,
         CAST(CASE WHEN len % 5 = 0 AND len > 1 THEN len - 1 ELSE len END AS INTEGER) AS len,
         CASE WHEN ord % 11 = 0 THEN 'name' ELSE type END AS type
  FROM ({SQL_GOLD}) g WHERE ord % 7 <> 0
"""

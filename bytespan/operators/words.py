"""Whitespace words with byte offsets (WIN12) and words that occur once (AGG15)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bytes import text_view

DOCS = 256   # documents whose words are made together


def split_words(views: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Byte views -> row, number in the row, start, length and view of each word (empty ones too)."""
    w = pc.split_pattern(views, " ")
    n = w.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, first = w.flatten(), np.cumsum(n) - n
    size = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)   # characters of the view are bytes
    start = np.cumsum(size + 1) - size - 1
    begin = np.zeros(len(n), np.int64)
    begin[n > 0] = start[first[n > 0]]
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - first[row], start - begin[row], size, flat


def _int(a: np.ndarray) -> pa.Array:
    return pa.array(a.astype(np.int32))


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, DOCS):
            b = batch.slice(at, DOCS)
            row, i, start, size, flat = split_words(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), _int(i), _int(start), _int(size), flat],
                                             names=["doc_id", "i", "start", "len", "word"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, DOCS):
            b = batch.slice(at, DOCS)
            row, _, _, size, flat = split_words(b.column(1))
            known = flat.dictionary_encode()
            code = known.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            many = len(known.dictionary) + 1
            key, n = np.unique((row * many + code)[size > 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(key // many)), known.dictionary.take(pa.array(key % many)), pa.array(n.astype(np.int64))],
                                             names=["doc_id", "word", "n"])


def _typed(names: tuple[str, str, str]):
    """Words with '@', else with a digit, else with a capital in front."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.array(names)
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                b = batch.slice(at, DOCS)
                row, i, start, size, flat = split_words(b.column(1))
                flags = [f.to_numpy(zero_copy_only=False) for f in (
                    pc.match_substring(flat, "@"), pc.match_substring_regex(flat, "[0-9]"), pc.match_substring_regex(flat, "^[A-Z]"))]
                kind = np.select(flags, [0, 1, 2], -1)
                own = np.flatnonzero(kind >= 0)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[own])), _int(i[own]), _int(start[own]), _int(size[own]), kinds.take(pa.array(kind[own]))],
                                                 names=["doc_id", "ord", "start", "len", "type"])
    return run


def words(documents: DataFrame, text: str = "text") -> DataFrame:
    """WIN12: whitespace words with byte offsets, one row per word.

    The byte views of a batch are split together; offsets are running sums of
    the lengths (linear, no per-document window sort).  A null text has no words.
    """
    d = _views(documents, text)
    return d.mapInArrow(_split, T.StructType([d.schema["doc_id"], _whole("i"), _whole("start"), _whole("len"), T.StructField("word", T.StringType())]))


def _views(documents: DataFrame, text: str) -> DataFrame:
    return documents.select("doc_id", F.translate(text_view(text), "\n", " ").alias("_v"))


def _whole(name: str) -> T.StructField:
    return T.StructField(name, T.IntegerType())


def word_counts(documents: DataFrame, text: str = "text") -> DataFrame:
    """The distinct non-empty words of every row of ``documents`` and how often
    each occurs there: doc_id, word, n."""
    d = _views(documents, text)
    return d.mapInArrow(_count, T.StructType([d.schema["doc_id"], T.StructField("word", T.StringType()), T.StructField("n", T.LongType())]))


def typed_words(documents: DataFrame, names: tuple[str, str, str], text: str = "text") -> DataFrame:
    """Words with '@' (first name), else with a digit (second), else with A-Z in
    front (third): doc_id, ord, start, len, type; only they leave the batch."""
    d = _views(documents, text)
    return d.mapInArrow(_typed(names), T.StructType([d.schema["doc_id"], _whole("ord"), _whole("start"), _whole("len"), T.StructField("type", T.StringType())]))


def singletons(rows: DataFrame, word: str = "word") -> DataFrame:
    """AGG15: words that occur once in all of ``rows``; empty ones do not count."""
    n = rows.filter(F.length(word) > 0).groupBy(word).agg(F.count(F.lit(1)).alias("n"))
    return n.filter(F.col("n") == 1).select(word)

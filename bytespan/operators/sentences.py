"""Sentence split (FN1) and span re-basing into sentences (JN3).

The cut rule works on bytes: after trailing whitespace is stripped, every
non-overlapping, left-to-right match of ``[^A-Z]\\. [^a-z]`` ends a sentence
after its period; the space is dropped and the next sentence starts at the
byte after it.  In the Latin-1 view a regex replace injects a separator at
the cut (the replace is non-overlapping and left to right, as the byte loop
is), then ``split`` yields the sentences.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bytes import latin1

# The cut pattern and the whitespace stripped from line ends.
CUT_PATTERN = r"([^A-Z]\.) ([^a-z])"
TRAILING_WS = " \t\n\r\x0b\x0c"
_SEP = "\u0001"


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _starts(lengths: pa.Array) -> pa.Array:
    """Where each sentence of a row begins: the sum of the lengths before it."""
    size = lengths.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lengths.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    before = np.cumsum(flat) - flat
    first = np.cumsum(size) - size
    base = np.repeat(before[np.minimum(first, max(0, len(before) - 1))], size) if len(flat) else flat
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), pa.array(before - base, pa.int32()))


def split_sentences(docs: DataFrame, body: str = "body") -> DataFrame:
    """FN1: one row per sentence: ``doc_id, idx, start, len, text`` (byte
    offsets into the document, ``text`` in the Latin-1 view)."""
    v = F.rtrim(latin1(body), F.lit(TRAILING_WS))
    d = docs.select("doc_id", F.split(F.regexp_replace(v, CUT_PATTERN, "$1" + _SEP + "$2"), _SEP).alias("_s"))
    d = d.select("doc_id", "_s", F.transform("_s", lambda x: F.length(x) + 1).alias("_l"))
    d = d.select("doc_id", "_s", _starts(F.col("_l")).alias("_st"))
    z = F.transform("_s", lambda x, i: F.struct(i.alias("idx"), F.col("_st")[i].alias("start"),
                                                F.length(x).alias("len"), x.alias("text")))
    return d.select("doc_id", F.inline_outer(z)).filter(F.col("idx").isNotNull())


def clip_to_sentences(sents: DataFrame, spans: DataFrame) -> DataFrame:
    """JN3: spans fully inside a sentence, start rebased to it.

    Each span belongs to the last sentence starting at or before it: sentence
    starts and spans are merged into one ordered stream per document and the
    sentence is carried forward with ``last(..., ignorenulls)`` -- no
    sentence x span pairs are formed.
    """
    s = sents.select("doc_id", F.col("start").alias("pos"), F.lit(0).alias("_k"), "idx",
                     F.col("start").alias("_ss"), F.col("len").alias("_sl"),
                     F.lit(None).cast("int").alias("ord"), F.lit(None).cast("int").alias("len"),
                     F.lit(None).cast("string").alias("type"))
    p = spans.select("doc_id", F.col("start").alias("pos"), F.lit(1).alias("_k"),
                     F.lit(None).cast("int").alias("idx"), F.lit(None).cast("int").alias("_ss"),
                     F.lit(None).cast("int").alias("_sl"), "ord", "len", "type")
    w = Window.partitionBy("doc_id").orderBy("pos", "_k").rowsBetween(Window.unboundedPreceding, 0)
    u = s.unionByName(p).select(
        "*", *[F.last(c, ignorenulls=True).over(w).alias("_" + c) for c in ("idx", "_ss", "_sl")])
    j = u.filter((F.col("_k") == 1) & F.col("__ss").isNotNull() &
                 (F.col("pos") < F.col("__ss") + F.col("__sl")) &
                 (F.col("pos") + F.col("len") <= F.col("__ss") + F.col("__sl")))
    return j.select("doc_id", F.col("_idx").alias("idx"), "ord",
                    (F.col("pos") - F.col("__ss")).cast("int").alias("start"), "len", "type")

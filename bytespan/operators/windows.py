"""Overlapping byte windows and span clipping (FN2, JN2, JN10, PRJ8-PRJ10, PRJ12, WIN10).

A document of n bytes is cut into windows starting at 0, S, 2S, ...; the
last window is the first one that reaches the end, so a document has
``max(0, ceil((n - W) / S)) + 1`` windows (an empty document has one,
all padding).  One row per window; the window's bytes are a binary slice
of the document (O(W) per window, no character walk).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bytes import latin1

SPAN_TYPE = "array<struct<start:int,len:int,type:string>>"

# Padding id, <SPACE> id and <DROP> id of the byte vocabulary.
PAD_ID = 0
SPACE_ID = 32
DROP_ID = 256


def n_windows(n, W: int, S: int) -> Column:
    """Number of windows of a document of ``n`` bytes."""
    n = F.col(n) if isinstance(n, str) else n
    return F.greatest(F.lit(0), F.ceil((n - F.lit(W)) / F.lit(S)).cast("int")) + 1


def make_windows(docs: DataFrame, W: int = 150, S: int = 75,
                 body: str = "body", keep: list[str] | None = None) -> DataFrame:
    """FN2: one row per window.

    Output: ``doc_id, win, start, n, n_doc, text`` (+ ``keep`` columns), where
    ``text`` is the Latin-1 view of the window with newlines turned into
    spaces (PRJ7) and ``n`` its byte length (<= W).
    """
    if W <= 0 or S <= 0:
        raise ValueError("W and S must be positive")
    keep = keep or []
    d = docs.select("doc_id", *keep, F.col(body).alias("_body"),
                    F.octet_length(body).cast("int").alias("n_doc"))
    w = d.select("doc_id", *keep, "_body", "n_doc",
                 F.explode(F.sequence(F.lit(0), n_windows("n_doc", W, S) - 1)).alias("win"))
    start = F.col("win") * S
    return w.select(
        "doc_id", *keep, "win", start.alias("start"),
        F.least(F.lit(W), F.col("n_doc") - start).cast("int").alias("n"),
        "n_doc",
        F.translate(latin1(F.substring("_body", start + 1, F.lit(W))), "\n", " ").alias("text"),
    )


def pad_to(arr, W: int, pad=PAD_ID) -> Column:
    """PRJ9: right-pad with ``pad`` and cut to W."""
    a = F.col(arr) if isinstance(arr, str) else arr
    return F.slice(F.concat(a, F.array_repeat(F.lit(pad), W)), 1, W)


def _ids(W: int | None):
    """Arrow UDF: Latin-1 views -> the code of every character, padded or cut to W."""
    @F.arrow_udf("array<int>")
    def ids(view: pa.Array) -> pa.Array:
        v = view.fill_null("").cast(pa.large_string())
        n = pc.utf8_length(v).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.frombuffer(v.buffers()[1], np.int64)[v.offset:v.offset + len(v) + 1] if len(v) else np.zeros(1, np.int64)
        raw = v.buffers()[2][int(at[0]):int(at[-1])].to_pybytes() if at[-1] > at[0] else b""
        values = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), "<i4")
        if W:
            own = np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)
            out = np.full((len(n), W), PAD_ID, np.int32)
            out[np.arange(W) < n[:, None]] = values[own < W]
            values, n = out.ravel(), np.full(len(n), W)
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(values, pa.int32()), mask=view.is_null() if view.null_count else None)

    return ids


def byte_ids(text, W: int | None = None) -> Column:
    """PRJ8: byte -> id (identity for 1..255, space id 32), padded to W with 0."""
    return _ids(W)(F.col(text) if isinstance(text, str) else text)


def drop_padding(df: DataFrame, pos: str = "pos", n: str = "n") -> DataFrame:
    """PRJ10: remove padding positions (pos >= n)."""
    return df.filter(F.col(pos) < F.col(n))


def _candidates(spans: DataFrame, W: int, S: int) -> DataFrame:
    """Each span with the ids of the windows that can contain it.

    A window k contains a span iff ``k*S <= start`` and
    ``start + len <= k*S + W``, so k runs over
    ``ceil((start+len-W)/S) .. floor(start/S)`` -- computed arithmetically,
    no theta join.  Windows past the document's end are removed by the
    equi-join with the windows.
    """
    lo = F.greatest(F.lit(0), F.ceil((F.col("start") + F.col("len") - W) / F.lit(S)).cast("int"))
    hi = F.floor(F.col("start") / F.lit(S)).cast("int")
    return (spans.select("*", lo.alias("_lo"), hi.alias("_hi"))
            .filter(F.col("_lo") <= F.col("_hi"))
            .select("*", F.explode(F.sequence("_lo", "_hi")).alias("win"))
            .drop("_lo", "_hi"))


def clip_long(windows: DataFrame, spans: DataFrame, W: int = 150, S: int = 75) -> DataFrame:
    """JN2 in long form: one row per (window, contained span), start rebased.

    Output: ``doc_id, win, ord, start, len, type``.
    """
    cand = _candidates(spans.select("doc_id", "ord", "start", "len", "type"), W, S)
    keys = windows.select("doc_id", "win", F.col("start").alias("_ws"))
    return (cand.join(keys, ["doc_id", "win"])
            .select("doc_id", "win", "ord", (F.col("start") - F.col("_ws")).alias("start"),
                    "len", "type"))


def clip_to_windows(windows: DataFrame, spans: DataFrame, W: int = 150, S: int = 75) -> DataFrame:
    """JN2: attach to every window the spans it fully contains.

    Adds ``spans array<struct<start,len,type>>`` (rebased, ordered by start
    then listing order).  Candidates are grouped by (doc_id, win) and
    left-joined to the windows: both sides are hash-partitioned on
    (doc_id, win), a key that spreads even one huge document evenly.
    """
    cand = _candidates(spans.select("doc_id", "ord", "start", "len", "type"), W, S)
    grouped = (cand.groupBy("doc_id", "win")
               .agg(F.sort_array(F.collect_list(F.struct("start", "ord", "len", "type"))).alias("_c")))
    out = windows.join(grouped, ["doc_id", "win"], "left")
    rebased = F.transform(
        F.coalesce(F.col("_c"), F.array().cast("array<struct<start:int,ord:int,len:int,type:string>>")),
        lambda s: F.struct((s["start"] - F.col("start")).cast("int").alias("start"),
                           s["len"].cast("int").alias("len"), s["type"].alias("type")))
    return out.withColumn("spans", rebased).drop("_c")


def lost_spans(windows: DataFrame, spans: DataFrame, W: int = 150, S: int = 75) -> DataFrame:
    """JN10: spans that fit in no window (too long, or crossing every edge)."""
    hit = clip_long(windows, spans, W, S).select("doc_id", "ord").distinct()
    return spans.join(hit, ["doc_id", "ord"], "left_anti")


def too_long(spans: DataFrame, W: int) -> DataFrame:
    """PRJ12: spans longer than the window length."""
    return spans.filter(F.col("len") > W)


def byte_dropout(windows: DataFrame, fraction: float = 0.3, seed: int = 123,
                 W: int = 150, ids: str = "ids") -> DataFrame:
    """WIN10: per window exactly int(fraction*W) positions are drawn; those
    that are not padding become <DROP> (256).

    The draw is the int(f*W) smallest ``md5(seed:doc:win:pos)``
    positions of the row -- deterministic, seeded, no shuffle.
    """
    k = int(fraction * W)
    if k <= 0:
        return windows
    # each array is built once per row, as a lambda's variable: the hashed
    # positions, and the greatest one drawn
    let = lambda value, f: F.transform(F.array(value), f)[0]
    hashed = lambda seed_: F.transform(F.sequence(F.lit(0), F.lit(W - 1)), lambda p: F.struct(
        F.md5(F.concat(seed_, p.cast("string"))).alias("h"), p.alias("p")))
    drawn = lambda hs: let(F.get(F.sort_array(hs), min(k, W) - 1), lambda last: F.zip_with(ids, hs, lambda x, h: F.when(
        (h <= last) & (x != PAD_ID), F.lit(DROP_ID)).otherwise(x)))
    prefix = F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("win").cast("string"), F.lit(""))
    return windows.withColumn(ids, let(prefix, lambda s: let(hashed(s), drawn)))

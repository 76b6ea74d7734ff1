"""Span algebra on nested span arrays (SRT1-SRT3, TAG1 helpers).

Spans are ``struct<start:int,len:int,type:string>`` (optionally with an
``ord`` listing index).  Conflict rules are greedy and order dependent; they
are one walk over the row's sorted span array (no shuffle).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN_STRUCT = "struct<start:int,len:int,type:string>"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _with_ord(spans) -> Column:
    return F.transform(_c(spans), lambda s, i: F.struct(
        s["start"].alias("start"), i.alias("ord"), s["len"].alias("len"), s["type"].alias("type")))


def _strip(arr) -> Column:
    return F.transform(arr, lambda s: F.struct(
        s["start"].alias("start"), s["len"].alias("len"), s["type"].alias("type")))


def order_spans(spans, descending: bool = True) -> Column:
    """SRT1: canonical order, greatest start first (stable on listing order)."""
    keyed = F.sort_array(_with_ord(spans))          # (start, ord) ascending
    return _strip(F.reverse(keyed) if descending else keyed)


def sorted_spans(spans) -> Column:
    """Spans sorted by (start, listing order), zero-length ones removed."""
    return F.filter(F.sort_array(_with_ord(spans)), lambda s: s["len"] >= 1)


def _kept(rule: str):
    """Arrow UDF: spans sorted by (start, ord), none empty -> the kept ones, in
    order.  One walk over a row's spans, whatever their number.

    SRT2 ``rightmost``: from the greatest start down (of equal starts the later
    listed first) a span is kept if it ends at or before the smallest start kept
    so far.  SRT3 ``leftmost``: of equal starts the last listed one counts; from
    the left a span is kept if it starts at or after the end of the last kept one.
    """
    def rightmost(start: list[int], end: list[int]) -> list[int]:
        least, kept = 1 << 62, []
        for i in range(len(start) - 1, -1, -1):
            if end[i] <= least:
                least = start[i]
                kept.append(i)
        return kept[::-1]

    def leftmost(start: list[int], end: list[int]) -> list[int]:
        last, kept = -1, []
        for i in range(len(start)):
            if start[i] >= last and (i + 1 == len(start) or start[i + 1] != start[i]):
                last = end[i]
                kept.append(i)
        return kept

    walk = {"rightmost": rightmost, "leftmost": leftmost}[rule]

    @F.arrow_udf(f"array<{SPAN_STRUCT}>")
    def kept(spans: pa.Array) -> pa.Array:
        size = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = spans.flatten()
        start = flat.field("start").to_numpy(zero_copy_only=False)
        end = start + flat.field("len").to_numpy(zero_copy_only=False)
        at, rows, offsets = 0, [], [0]
        for n in size.tolist():
            rows += [at + i for i in walk(start[at:at + n].tolist(), end[at:at + n].tolist())] if n else []
            at += n
            offsets.append(len(rows))
        taken = flat.take(pa.array(rows, pa.int64()))
        made = pa.StructArray.from_arrays([taken.field(c) for c in ("start", "len", "type")], names=["start", "len", "type"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), made)

    return kept


def tags_from_spans(sp, n) -> Column:
    """Sorted, non-overlapping spans (a materialised column) -> IOB tags of length n.

    Linear: spans are expanded into runs of ``O`` / ``B-`` / ``I-`` and flattened.
    """
    sp, n = _c(sp), _c(n)
    pieces = F.transform(sp, lambda s, i: F.concat(
        F.array_repeat(F.lit("O"), s["start"] - F.when(i == 0, F.lit(0))
                       .otherwise(sp[i - 1]["start"] + sp[i - 1]["len"])),
        F.array(F.concat(F.lit("B-"), s["type"])),
        F.array_repeat(F.concat(F.lit("I-"), s["type"]), s["len"] - 1)))
    last_end = F.when(F.size(sp) == 0, F.lit(0)).otherwise(
        F.element_at(sp, -1)["start"] + F.element_at(sp, -1)["len"])
    tags = F.concat(F.flatten(pieces), F.array_repeat(F.lit("O"), n - last_end))
    return F.slice(tags, 1, n)


def _disjoint(srt) -> Column:
    """True when sorted spans neither overlap nor share a start."""
    s = _c(srt)
    return F.forall(F.sequence(F.lit(1), F.greatest(F.size(s), F.lit(1))),
                    lambda i: (i >= F.size(s)) | (s[i - 1]["start"] + s[i - 1]["len"] <= s[i]["start"]))


def resolve(df: DataFrame, spans: str = "spans", out: str = "resolved",
            conflict: str = "rightmost") -> DataFrame:
    """Apply a conflict rule to a span-array column (SRT2 ``rightmost``, SRT3
    ``leftmost``); spans of length 0 are dropped.

    Disjoint lists (the common case) are returned sorted; only rows with a
    conflict, and only their spans, go through the walk.
    """
    if conflict not in ("rightmost", "leftmost", "none"):
        raise ValueError(conflict)
    srt = df.withColumn("_srt", sorted_spans(spans))
    if conflict == "none":
        return srt.withColumn(out, _strip(F.col("_srt"))).drop("_srt")
    srt = srt.withColumn("_ok", F.coalesce(_disjoint("_srt"), F.lit(True)))
    walked = _kept(conflict)(F.when(~F.col("_ok"), F.col("_srt")))
    return srt.withColumn(out, F.when(F.col("_ok"), _strip(F.col("_srt"))).otherwise(walked)).drop("_srt", "_ok")


def with_tags(df: DataFrame, spans: str = "spans", n: str = "n", out: str = "tags",
              conflict: str = "rightmost") -> DataFrame:
    """TAG1: spans -> per-byte IOB tags (first byte ``B-``, rest ``I-``,
    others ``O``) after the conflict rule ``rightmost`` (SRT2) or
    ``leftmost`` (SRT3)."""
    r = resolve(df, spans, "_res", conflict)
    return r.withColumn(out, tags_from_spans("_res", n)).drop("_res")


def nest_spans(spans: DataFrame, keys=("doc_id",)) -> DataFrame:
    """Long spans -> one row per key with ``spans`` ordered by (start, ord)."""
    return (spans.groupBy(*keys)
            .agg(F.sort_array(F.collect_list(F.struct("start", "ord", "len", "type"))).alias("_s"))
            .select(*keys, _strip(F.col("_s")).alias("spans")))


def explode_spans(df: DataFrame, col: str = "spans", keys=("doc_id",)) -> DataFrame:
    """Nested spans -> long rows (doc_id, ord, start, len, type)."""
    # *_outer generators: the optimizer infers no size() filter that would
    # inline (and re-evaluate) the array's whole expression chain
    return df.select(*keys, F.posexplode_outer(col).alias("ord", "_s")).filter(
        F.col("_s").isNotNull()).select(
        *keys, "ord", F.col("_s.start").alias("start"), F.col("_s.len").alias("len"),
        F.col("_s.type").alias("type"))

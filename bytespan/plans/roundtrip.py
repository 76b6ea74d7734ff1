"""The minimum end-to-end slice (entry query).

documents -> spans -> overlapping windows -> clipped spans -> per-window
IOB tags -> IOBES -> IOB -> stitched document tags -> spans / chunks ->
chunk scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators import runs as rn
from ..operators import spans as sp
from ..operators import stitch as st
from ..operators import tags as tg
from ..operators import windows as wn


def window_tags(docs: DataFrame, spans: DataFrame, W: int = 150, S: int = 75,
                conflict: str = "rightmost") -> DataFrame:
    """Windows with their clipped spans as IOB tags (length n), passed
    through IOBES and back as the tagger's decoder does."""
    win = wn.make_windows(docs, W, S)
    clipped = sp.with_tags(wn.clip_to_windows(win, spans, W, S), "spans", "n", "iob", conflict)
    iobes = clipped.select("doc_id", "win", "start", "n", "n_doc", tg.to_iobes("iob").alias("iobes"))
    return iobes.select("doc_id", "win", "start", "n", "n_doc", tg.to_iob("iobes").alias("tags"))


def doc_tags(docs: DataFrame, spans: DataFrame, conflict: str = "rightmost") -> DataFrame:
    """Document-level IOB tags straight from the spans (one row per doc)."""
    nested = sp.nest_spans(spans)
    d = docs.select("doc_id", F.octet_length("body").cast("int").alias("n_doc"))
    j = d.join(nested, "doc_id", "left")
    j = j.withColumn("spans", F.coalesce(F.col("spans"), F.array().cast(wn.SPAN_TYPE)))
    return sp.with_tags(j, "spans", "n_doc", "tags", conflict).select("doc_id", "n_doc", "tags")


def stitched_tags(wtags: DataFrame, W: int = 150) -> DataFrame:
    """WIN5 + assembly: one row per document with its stitched tags."""
    return st.assemble(st.stitch(wtags, W, by="tags"), ["tags"])


def stitched_runs(docs: DataFrame, spans: DataFrame, W: int = 150, S: int = 75) -> DataFrame:
    """Spans through windows, IOBES and back, and stitching: doc_id, n_doc, runs."""
    w = rn.window_runs(docs, spans, W, S)
    w = w.withColumn("runs", rn.to_iob(rn.to_iobes("runs", "n")))
    return rn.assemble(rn.stitch(w, W))


def recovered_spans(docs: DataFrame, spans: DataFrame, W: int = 150, S: int = 75,
                    stray: str = "begin") -> DataFrame:
    """Spans after the full window round trip (long rows)."""
    return rn.span_rows(stitched_runs(docs, spans, W, S), stray=stray)


def score_roundtrip(docs: DataFrame, gold: DataFrame, pred: DataFrame,
                    W: int = 150, S: int = 75, digits: int = 4) -> DataFrame:
    """Flagship: predictions go through windows and stitching, gold stays at
    document level; chunk scores per type plus the overall row."""
    counts = ev.match_chunks(rn.chunk_rows(rn.doc_runs(docs, gold)), rn.chunk_rows(stitched_runs(docs, pred, W, S)))
    return ev.chunk_scores(counts, digits)

"""Validation of annotations: a table of violations.

One row for each fault, so nothing is cut or dropped silently: ``TAG1`` cuts a
span at the end of its text and drops empty ones, and this table says which.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bytes import latin1

#: Kinds, in the order in which a span is checked.
KINDS = ["no_document", "negative_start", "empty", "past_end", "unknown_type", "overlap", "nul_byte", "stray_tag", "unpaired_line"]


def span_violations(docs: DataFrame, spans: DataFrame, types: list[str] | None = None) -> DataFrame:
    """-> doc_id, ord, kind, at, detail.  Spans are checked against the length of
    their document in one join; overlaps (with the span before, by start and
    listing order) in the span list of the document, which is nested by the same
    key; NUL bytes while the documents are scanned."""
    v = latin1("body")
    d = docs.select("doc_id", F.octet_length("body").alias("_n"), F.instr(v, "\0").alias("_nul"))
    nested = spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "ord", "len", "type"))).alias("_s"))
    j = d.join(nested, "doc_id", "full_outer")
    fault = lambda ord_, kind, at, detail: F.struct(ord_.cast("long").alias("ord"), F.lit(kind).alias("kind"), at.cast("long").alias("at"), detail.cast("string").alias("detail"))
    end = lambda s: s["start"] + s["len"]
    last_end = F.transform("_s", lambda s, i: F.struct(s.alias("s"), F.when(i > 0, end(F.get(F.col("_s"), i - 1))).alias("before")))

    def faults(x):
        s = x["s"]
        checks = [(F.col("_n").isNull(), "no_document", s["start"], F.lit("")), (s["start"] < 0, "negative_start", s["start"], s["start"]),
                  (s["len"] < 1, "empty", s["start"], s["len"]), (end(s) > F.col("_n"), "past_end", s["start"], end(s) - F.col("_n")),
                  (~s["type"].isin(*types) if types else F.lit(False), "unknown_type", s["start"], s["type"]),
                  ((s["len"] > 0) & (x["before"] > s["start"]), "overlap", s["start"], x["before"] - s["start"])]
        return F.array_compact(F.array(*[F.when(c, fault(s["ord"], k, at, detail)) for c, k, at, detail in checks]))

    of_spans = F.coalesce(F.flatten(F.transform(last_end, faults)), F.array().cast("array<struct<ord:bigint,kind:string,at:bigint,detail:string>>"))
    nul = F.when(F.col("_nul") > 0, F.array(fault(F.lit(None), "nul_byte", F.col("_nul") - 1, F.lit("")))).otherwise(F.array().cast("array<struct<ord:bigint,kind:string,at:bigint,detail:string>>"))
    return j.select("doc_id", F.explode_outer(F.concat(of_spans, nul)).alias("_f")).filter(F.col("_f").isNotNull()).select("doc_id", "_f.*")


def tag_violations(seqs: DataFrame, runs: str = "runs") -> DataFrame:
    """Runs of tags -> doc_id, ord (null), kind ``stray_tag``, at, detail (the tag):
    an ``I-`` run at the start or after ``O``."""
    r = F.col(runs)
    stray = F.transform(r, lambda x, i: F.when(x["tag"].startswith("I-") & ((i == 0) | (F.get(r, i - 1)["tag"] == "O")), x))
    return (seqs.select("doc_id", F.explode_outer(F.array_compact(stray)).alias("_x")).filter(F.col("_x").isNotNull())
            .select("doc_id", F.lit(None).cast("long").alias("ord"), F.lit("stray_tag").alias("kind"), F.col("_x.at").cast("long").alias("at"), F.col("_x.tag").alias("detail")))


def line_violations(a: DataFrame, b: DataFrame) -> DataFrame:
    """Lines of two files that should pair (JN1) -> doc_id (the line's number), ord
    (null), kind ``unpaired_line``, at (null), detail: the side that has it."""
    j = a.select("line_no", F.lit("a").alias("_a")).join(b.select("line_no", F.lit("b").alias("_b")), "line_no", "full_outer")
    return (j.filter(F.col("_a").isNull() | F.col("_b").isNull())
            .select(F.col("line_no").alias("doc_id"), F.lit(None).cast("long").alias("ord"), F.lit("unpaired_line").alias("kind"),
                    F.lit(None).cast("long").alias("at"), F.coalesce("_a", "_b").alias("detail")))

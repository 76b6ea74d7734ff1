"""Writers (SNK1-SNK10).

Text outputs keep document order: rows are range-partitioned on the
document id and sorted inside partitions, so part files concatenate in
order; no single-task sort.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.annotations import format_triples
from ..functions.bytes import chars, from_latin1, latin1
from ..operators import spans as sp


def _ordered_text(df: DataFrame, key: str, col: str, out: str, parts: int | None = None):
    """Without ``parts`` their number follows the data (adaptive execution)."""
    dealt = df.repartitionByRange(parts, key) if parts else df.repartitionByRange(key)
    (dealt.sortWithinPartitions(key).select(col)
     .write.mode("overwrite").option("lineSep", "\n").text(out))


def _raw(view):
    """Latin-1 view -> string column with the same bytes, valid UTF-8 or not."""
    return from_latin1(view).cast("string")


def write_src_tgt(docs: DataFrame, spans: DataFrame, out: str):
    """SNK1: ``<out>/src`` one document per line; ``<out>/tgt`` its triples,
    greatest offset first."""
    nested = sp.nest_spans(spans)
    j = docs.join(nested, "doc_id", "left")
    j = j.select("doc_id", F.col("body").cast("string").alias("v"),
                 F.coalesce(format_triples("spans"), F.lit("")).alias("_t"))
    _ordered_text(j, "doc_id", "v",
                  os.path.join(out, "src"))
    _ordered_text(j, "doc_id", "_t", os.path.join(out, "tgt"))


def byte_iob_lines(docs: DataFrame, tags: str = "tags", space_token: str = "<SPACE>") -> DataFrame:
    """SNK2 body: per document ``<byte> <tag>`` lines plus a blank line."""
    v = F.translate(latin1("body"), "\n", " ")
    d = docs.select("doc_id", chars(v).alias("_c"), tags)
    lines = F.transform(F.arrays_zip(F.col("_c").alias("b"), F.col(tags).alias("t")), lambda z: F.concat(
        F.when(z["b"] == " ", F.lit(space_token)).otherwise(z["b"]), F.lit(" "), z["t"]))
    return d.select("doc_id", F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("text"))


def write_byte_iob(docs_with_tags: DataFrame, out: str, space_token: str = "<SPACE>"):
    """SNK2: byte-IOB file (``docs_with_tags`` has body and tags)."""
    lines = byte_iob_lines(docs_with_tags, "tags", space_token)
    lines = lines.select("doc_id", _raw("text").alias("text"))
    _ordered_text(lines, "doc_id", "text", out)


def ordinal_lines(pred: DataFrame, ids: str = "ids", tags: str = "tags") -> DataFrame:
    """SNK3: ordinal predictions: ``<byte id> <tag>`` per non-padding position,
    blank line per sample."""
    z = F.filter(F.arrays_zip(F.col(ids).alias("b"), F.col(tags).alias("t")), lambda x: x["b"] != 0)
    return pred.select("doc_id", *[c for c in ("win",) if c in pred.columns],
                       F.concat(F.array_join(F.transform(z, lambda x: F.concat(x["b"].cast("string"), F.lit(" "), x["t"])),
                                             "\n"), F.lit("\n")).alias("text"))


def write_ordinal_iob(pred: DataFrame, out: str):
    _ordered_text(ordinal_lines(pred), "doc_id", "text", out)


def ordinal_to_byte_iob(df: DataFrame, b: str = "b", tag: str = "tag", space_token: str = "<SPACE>") -> DataFrame:
    """SNK4: decimal byte -> the byte itself (space -> ``<SPACE>``)."""
    ch = F.decode(F.unhex(F.lpad(F.hex(F.col(b)), 2, "0")), "ISO-8859-1")
    return df.withColumn("line", F.concat(F.when(F.col(b) == 32, F.lit(space_token)).otherwise(ch), F.lit(" "), F.col(tag)))


def write_byte_iob_rows(df: DataFrame, out: str, order: str = "pos"):
    """SNK4 writer: the ``line`` column (Latin-1 view), in order, as bytes."""
    _ordered_text(df.select(order, _raw("line").alias("line")), order, "line", out)


def probs_vectors_lines(pred: DataFrame, text: str = "text", prob: str = "prob", vec: str = "vec") -> DataFrame:
    """SNK5: ``text<TAB>prob<TAB>vector`` (tabs in text become spaces)."""
    return pred.select("doc_id", F.concat_ws("\t", F.translate(text, "\t", " "), F.col(prob).cast("string"),
                                             F.array_join(F.transform(vec, lambda x: x.cast("string")), " ")).alias("line"))


def write_probs_vectors(pred: DataFrame, out: str, **cols):
    """SNK5 writer."""
    _ordered_text(probs_vectors_lines(pred, **cols), "doc_id", "line", out)


def conll_lines(pairs: DataFrame, byte: str = "byte") -> DataFrame:
    """SNK6: ``byte gold pred`` lines (scorer input)."""
    return pairs.select("doc_id", "pos", F.concat_ws(" ", F.col(byte).cast("string"), "gold", "pred").alias("line"))


def write_conll(pairs: DataFrame, out: str, byte: str = "byte"):
    """SNK6 writer: a blank line ends every document."""
    lines = conll_lines(pairs, byte)
    ends = lines.groupBy("doc_id").agg((F.max("pos") + 1).alias("pos")).withColumn("line", F.lit(""))
    every = lines.unionByName(ends)
    (every.repartitionByRange("doc_id", "pos").sortWithinPartitions("doc_id", "pos").select("line")
     .write.mode("overwrite").option("lineSep", "\n").text(out))


def write_scores(scores: DataFrame, out: str, run_id: str):
    """SNK7: the score table of a run; writing a run again replaces it."""
    scores.write.mode("overwrite").parquet(f"{out}/run_id={run_id}")


def write_triples(docs: DataFrame, spans: DataFrame, out: str):
    """SNK8: nested span triples per document, descending offsets."""
    nested = sp.nest_spans(spans).select("doc_id", sp.order_spans("spans").alias("spans"))
    docs.join(nested, "doc_id", "left").write.mode("overwrite").parquet(out)


def render_text(byte_rows: DataFrame, b: str = "b", pos: str = "pos") -> DataFrame:
    """SNK10: ordinal byte rows -> readable text per sample."""
    g = byte_rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(pos, b))).alias("_r"))
    hexs = F.array_join(F.transform("_r", lambda x: F.lpad(F.hex(x[b]), 2, "0")), "")
    return g.select("doc_id", F.make_valid_utf8(F.unhex(hexs).cast("string")).alias("text"))

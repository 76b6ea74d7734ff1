"""Annotated-text readers (SRC1-SRC5, SRC8-SRC11)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.annotations import parse_triples
from ..functions.bytes import chars, from_latin1, latin1
from ..operators import tags as tg
from .text import dense_ranks, previous, read_lines, read_segments


def read_src(spark: SparkSession, path: str, with_file: bool = False) -> DataFrame:
    """SRC2: one document per line (bytes kept; only the ``\\n`` is cut).  ids
    count from 0 in each file; ``with_file`` adds its path, by which
    ``union_corpora`` makes them unique over a folder."""
    lines = read_lines(spark, path, binary=True)
    return lines.select(*(["file"] if with_file else []), F.col("line_no").alias("doc_id"), F.col("line").alias("body"))


def zip_lines(a: DataFrame, b: DataFrame, strict: bool = False) -> DataFrame:
    """JN1: lines of two files by position -> line_no, a, b.  The shorter file
    wins; ``strict`` raises on a difference in length (in both columns)."""
    x, y = a.select("line_no", F.col("line").alias("a")), b.select("line_no", F.col("line").alias("b"))
    if not strict:
        return x.join(y, "line_no")
    j = x.join(y, "line_no", "full_outer")
    ok, fail = F.col("a").isNotNull() & F.col("b").isNotNull(), F.raise_error(F.lit("files differ in length"))
    return j.select("line_no", *[F.when(ok, F.col(c)).otherwise(fail.cast(j.schema[c].dataType)).alias(c) for c in ("a", "b")])


def read_src_tgt(spark: SparkSession, src: str, tgt: str, strict: bool = False):
    """SRC1 + JN1: line i of ``src`` pairs with line i of ``tgt``; the
    shorter file wins (``strict`` raises on a length mismatch)."""
    docs = read_src(spark, src)
    t = read_lines(spark, tgt).select(F.col("line_no").alias("doc_id"), "line")
    how = "full_outer" if strict else "inner"
    j = docs.join(t, "doc_id", how)
    if strict:   # the check is part of both columns, so no projection drops it
        ok, fail = F.col("body").isNotNull() & F.col("line").isNotNull(), F.raise_error(F.lit("src and tgt differ in length"))
        j = j.select("doc_id", F.when(ok, F.col("body")).otherwise(fail.cast("binary")).alias("body"),
                     F.when(ok, F.col("line")).otherwise(fail.cast("string")).alias("line"))
    spans = (j.select("doc_id", F.posexplode_outer(parse_triples("line")).alias("ord", "s"))
             .filter(F.col("s").isNotNull())
             .select("doc_id", "ord", "s.start", "s.len", "s.type"))
    return j.select("doc_id", "body"), spans


def _blank(line):
    return F.length(F.trim(line)) == 0


def _sentences(spark: SparkSession, path: str) -> DataFrame:
    """Lines in the Latin-1 view, one character per byte; sentence id = blank
    lines of the file before the line, which are dropped themselves."""
    return read_segments(spark, path, lambda line: _blank(latin1(line)), binary=True).withColumn("line", latin1("line"))


def read_byte_iob(spark: SparkSession, path: str, space_token: str = "<SPACE>", stray: str = "error"):
    """SRC3: ``<byte> <tag>`` per line, blank line between samples.  The tag
    is the last field; the byte is the rest of the line (so whitespace bytes
    other than space survive), ``space_token`` is a space."""
    s = _sentences(spark, path)
    pattern = r"(?s)^(.*) (\S+)$"
    line = F.when(F.col("line").rlike(pattern), F.col("line")).otherwise(
        F.raise_error(F.concat(F.lit("not a byte and a tag: line "), F.col("line_no"))).cast("string"))
    s = s.select("file", "sent", "line_no", line.alias("line"))
    s = s.select("file", "sent", "line_no", F.regexp_extract("line", pattern, 1).alias("b"),
                 F.regexp_extract("line", pattern, 2).alias("tag"))
    s = s.withColumn("b", F.when(F.col("b") == space_token, F.lit(" ")).otherwise(F.col("b")))
    g = (s.groupBy("file", "sent").agg(F.array_sort(F.collect_list(F.struct("line_no", "b", "tag"))).alias("_r"))
         .select("file", "sent", F.array_join(F.transform("_r", lambda x: x["b"]), "").alias("text"),
                 F.transform("_r", lambda x: x["tag"]).alias("tags")))
    g = tg.with_spans(g, "tags", "spans", stray)
    return g.select("file", F.col("sent").alias("doc_id"), from_latin1("text").alias("body"), "tags", "spans")


def read_word_iob(spark: SparkSession, path: str, stray: str = "error"):
    """SRC4: word-IOB (first field = word, last field = tag); words are
    joined by one space and spans are byte offsets of the joined text."""
    s = _sentences(spark, path)
    s = s.select("file", "sent", "line_no", F.split(F.trim("line"), r"\s+").alias("f"))
    s = s.select("file", "sent", "line_no", F.col("f")[0].alias("word"), F.element_at("f", -1).alias("tag"))
    g = s.groupBy("file", "sent").agg(F.array_sort(F.collect_list(F.struct("line_no", "word", "tag"))).alias("_r"))
    g = g.select("file", "sent", F.array_join(F.transform("_r", lambda x: x["word"]), " ").alias("text"),
                 F.transform("_r", lambda x: x["tag"]).alias("wtags"),
                 F.transform("_r", lambda x: F.length(x["word"])).alias("wlen"))
    # word-level spans, then word -> byte offsets (start = sum of len + 1 before)
    g = g.withColumn("tags", F.col("wtags"))
    g = tg.with_spans(g, "tags", "wspans", stray)
    # word starts are the places after the spaces of the joined text: one pass
    at = F.slice(F.sequence(F.lit(0), F.greatest(F.length("text"), F.lit(1)) - 1), F.lit(1), F.length("text"))
    spaces = F.filter(F.transform(F.arrays_zip(at.alias("p"), chars("text").alias("c")),
                                  lambda z: F.when(z["c"] == " ", z["p"] + 1)), lambda x: x.isNotNull())
    g = g.withColumn("_st", F.concat(F.array(F.lit(0)), spaces))
    spans = F.transform("wspans", lambda s: F.struct(
        F.col("_st")[s["start"]].alias("start"),
        (F.col("_st")[s["start"] + s["len"] - 1] + F.col("wlen")[s["start"] + s["len"] - 1]
         - F.col("_st")[s["start"]]).alias("len"), s["type"].alias("type")))
    return g.select("file", F.col("sent").alias("doc_id"), from_latin1("text").alias("body"),
                    spans.alias("spans"))


def read_ordinal_iob(spark: SparkSession, path: str, ordinal: bool = True, stray: str = "begin"):
    """SRC5: ``97 O`` / ``97,12,3 B-x``: the byte is the first comma-separated
    id; the non-ordinal variant reads a one-field line as a space."""
    s = _sentences(spark, path)
    f = F.split(F.trim("line"), " ")
    s = s.select("file", "sent", "line_no", f.alias("f"))
    if ordinal:
        b = F.split(F.col("f")[0], ",")[0].cast("int")
        tag = F.element_at("f", -1)
    else:
        b = F.when(F.size("f") == 1, F.lit(32)).otherwise(F.ascii(F.col("f")[0]))
        tag = F.element_at("f", -1)
    s = s.select("file", "sent", "line_no", b.alias("b"), tag.alias("tag"))
    g = s.groupBy("file", "sent").agg(F.array_sort(F.collect_list(F.struct("line_no", "b", "tag"))).alias("_r"))
    g = g.select("file", F.col("sent").alias("doc_id"), F.transform("_r", lambda x: x["b"]).alias("bytes"),
                 F.transform("_r", lambda x: x["tag"]).alias("tags"))
    return tg.with_spans(g, "tags", "spans", stray)


def read_conll(spark: SparkSession, path: str, delimiter: str = " ", o_tag: str = "O", raw: bool = False):
    """SRC10: scorer input ``feat... gold pred``; blank or ``-X-`` lines are
    boundaries.  Returns one row per sequence with gold / pred arrays."""
    from ..operators.evaluate import BOUNDARY, normalize_tag
    fields = lambda line: F.split(line, re.escape(delimiter))  # noqa: E731  the delimiter is text, not a pattern
    s = read_segments(spark, path, lambda line: (F.length(line) == 0) | (fields(line)[0] == BOUNDARY))
    s = s.withColumn("f", fields("line"))
    s = s.select("file", "sent", "line_no", normalize_tag(F.element_at("f", -2), o_tag, raw).alias("gold"),
                 normalize_tag(F.element_at("f", -1), o_tag, raw).alias("pred"), F.size("f").alias("nf"))
    g = s.groupBy("file", "sent").agg(F.array_sort(F.collect_list(F.struct("line_no", "gold", "pred"))).alias("_r"),
                                      F.min("nf").alias("_a"), F.max("nf").alias("_z"))
    fail = F.raise_error(F.lit("unexpected number of features"))
    g = g.withColumn("_r", F.when(F.col("_a") == F.col("_z"), F.col("_r")).otherwise(fail.cast(g.schema["_r"].dataType)))
    return g.select("file", F.col("sent").alias("doc_id"), F.transform("_r", lambda x: x["gold"]).alias("gold"),
                    F.transform("_r", lambda x: x["pred"]).alias("pred"))


def read_embeddings(spark: SparkSession, path: str, dim: int):
    """SRC8: word2vec text format; header skipped, id = line index, the first
    occurrence of a token wins, ids dense afterwards."""
    lines = read_lines(spark, path).filter(F.col("line_no") >= 1)
    f = F.split(F.trim("line"), " ")
    # tokens are numbered without their vectors, which come back by line
    first = lines.select("line_no", f[0].alias("token")).groupBy("token").agg(F.min("line_no").alias("line_no"))
    numbered = dense_ranks(first, "line_no", "id").select("line_no", "token", F.col("id").cast("int").alias("id"))
    vectors = lines.select("line_no", F.transform(F.slice(f, 2, dim), lambda x: x.cast("float")).alias("vec"))
    return numbered.join(vectors, "line_no").select("token", "id", "vec")


def read_token_offsets(spark: SparkSession, path: str):
    """SRC9 + WIN8: ``start\\tend\\ttoken`` lines, blank line per sentence;
    offsets rebased to the sentence (minus the previous sentence's last end
    + 1), emitted as ``TOK`` spans."""
    s = read_segments(spark, path, _blank)
    f = F.split("line", "\t")
    s = s.select("file", "sent", "line_no", f[0].cast("int").alias("start"), f[1].cast("int").alias("end"))
    last = s.groupBy("file", "sent").agg(F.max("end").alias("_e"))
    base = previous(last, ["file"], "sent", "_e", "_before").select("file", "sent", F.coalesce(F.col("_before") + 1, F.lit(0)).alias("_base"))
    j = s.join(base, ["file", "sent"])
    return j.select("file", F.col("sent").alias("doc_id"), (F.col("start") - F.col("_base")).alias("start"),
                    (F.col("end") - F.col("start")).alias("len"), F.lit("TOK").alias("type"))


def read_triples(spark: SparkSession, path: str):
    """SRC11: span-triple sets written by ``write_triples`` -> docs + spans
    (newlines in text become spaces)."""
    t = spark.read.parquet(path)
    docs = t.select("doc_id", F.encode(F.translate(latin1("body"), "\n", " "), "ISO-8859-1").alias("body"))
    spans = (t.select("doc_id", F.posexplode_outer("spans").alias("ord", "s")).filter(F.col("s").isNotNull())
             .select("doc_id", "ord", "s.start", "s.len", "s.type"))
    return docs, spans


def read_bioc(spark: SparkSession, path: str):
    """SRC6: BioC XML folder (``.xml`` files only) -> passages with spans.

    Uses the built-in XML source with ``rowTag=document``; passages and
    annotations are exploded; the type is the ``infon`` with key ``type``.
    """
    x = (spark.read.format("xml").option("rowTag", "document").option("pathGlobFilter", "*.xml")
         .schema(BIOC_SCHEMA).load(path))
    p = x.select(F.col("id").cast("string").alias("doc_key"), F.posexplode_outer("passage").alias("passage_idx", "p"))
    p = p.filter(F.col("p").isNotNull())
    a = p.select("doc_key", "passage_idx", F.col("p.text").alias("text"),
                 F.posexplode_outer("p.annotation").alias("ord", "a"))
    typ = F.filter("a.infon", lambda i: i["_key"] == "type")[0]["_VALUE"]
    return a.select("doc_key", "passage_idx", "text", "ord", typ.alias("raw_type"),
                    F.col("a.location._offset").alias("start"), F.col("a.location._length").alias("len"),
                    F.col("a.text").alias("ann_text"))


# Explicit schema: with inference a document holding one passage (or a
# passage holding one annotation) would read as a struct, not an array.
BIOC_SCHEMA = (
    "id string, passage array<struct<offset:int, text:string, annotation:array<struct<"
    "_id:string, infon:array<struct<_VALUE:string,_key:string>>, "
    "location:struct<_offset:int,_length:int>, text:string>>>>")

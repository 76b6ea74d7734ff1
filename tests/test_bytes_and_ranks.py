"""Byte-exact formats, line numbers, ranks, and CRF decoding of computed emissions."""

import glob
import os

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from bytespan.functions.bytes import repair_utf8
from bytespan.operators import bpe, corpus, crf
from bytespan.plans.synthetic import words
from bytespan.sinks import writers
from bytespan.sources import formats
from bytespan.sources.text import read_lines

ODD = ["wild‐type x".encode(), b"a\xe2b", b"c\rd", b"", "é Ü".encode()]


def read_back(path):
    return b"".join(open(p, "rb").read() for p in sorted(glob.glob(os.path.join(path, "part-*"))))


def test_ranks_with_a_payload(spark):
    n = 400_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("body"))
    r = corpus.rank_by_hash(docs, "doc_id")
    got = r.agg(F.count(F.lit(1)), F.count_distinct("rank"), F.min("rank"), F.max("rank"), F.count_distinct("body")).first()
    assert tuple(got) == (n, n, 0, n - 1, n)
    parts = {x["split"]: x["count"] for x in corpus.split_corpus(docs).groupBy("split").count().collect()}
    assert parts == {"train": 320_000, "dev": 40_000, "test": 40_000}
    assert corpus.split_corpus(docs.limit(7)).filter("split = 'train'").count() == 5


def test_line_numbers_of_many_small_files(spark, tmp_path):
    for k in range(40):
        (tmp_path / f"f{k:02}").write_text(f"{k}-0\n{k}-1\n{k}-2\n")
    rows = read_lines(spark, str(tmp_path)).collect()
    assert len(rows) == 120 and all(int(r.line.split("-")[1]) == r.line_no for r in rows)


def test_line_numbers_of_a_file_in_blocks(spark, tmp_path):
    (tmp_path / "big").write_text("".join(f"{k} {'x' * (k % 50)}\n" for k in range(30_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        lines = read_lines(spark, str(tmp_path / "big"))
        assert lines.filter(F.split("line", " ")[0].cast("long") != F.col("line_no")).count() == 0 and lines.count() == 30_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_source_and_target_keep_bytes_and_unannotated_lines(spark, tmp_path):
    (tmp_path / "src").write_bytes(b"\n".join(ODD) + b"\n")
    (tmp_path / "tgt").write_bytes(b"S0 L4 a\n\n\n\nS1 L1 b S0 L1 a\n")
    docs, spans = formats.read_src_tgt(spark, str(tmp_path / "src"), str(tmp_path / "tgt"), strict=True)
    assert [bytes(r.body) for r in docs.orderBy("doc_id").collect()] == ODD
    assert sorted((r.doc_id, r.start, r.len, r.type) for r in spans.collect()) == [(0, 0, 4, "a"), (4, 0, 1, "a"), (4, 1, 1, "b")]
    writers.write_src_tgt(docs, spans, str(tmp_path / "out"))
    assert read_back(tmp_path / "out" / "src") == b"\n".join(ODD) + b"\n"
    assert read_back(tmp_path / "out" / "tgt") == b"S0 L4 a\n\n\n\nS1 L1 b S0 L1 a\n"


def test_strict_pairs_raise(spark, tmp_path):
    (tmp_path / "src").write_text("a\nb\nc\n")
    (tmp_path / "tgt").write_text("\n\n")
    for part in formats.read_src_tgt(spark, str(tmp_path / "src"), str(tmp_path / "tgt"), strict=True):
        with pytest.raises(PySparkException, match="differ in length"):
            part.collect()
    assert formats.read_src_tgt(spark, str(tmp_path / "src"), str(tmp_path / "tgt"))[0].count() == 2


def test_byte_iob_round_trip(spark, tmp_path):
    bodies = [b for b in ODD if b]
    docs = spark.createDataFrame([(i, b, ["O"] * len(b)) for i, b in enumerate(bodies)], "doc_id long, body binary, tags array<string>")
    writers.write_byte_iob(docs, str(tmp_path / "iob"))
    back = formats.read_byte_iob(spark, str(tmp_path / "iob")).collect()
    assert sorted(bytes(r.body) for r in back) == sorted(bodies)
    (tmp_path / "hyphen").write_bytes(b"".join(bytes([b]) + b" O\n" for b in "‐x".encode()) + b"y B-t\n")
    row = formats.read_byte_iob(spark, str(tmp_path / "hyphen")).first()
    assert bytes(row.body) == "‐xy".encode() and [(s.start, s.len) for s in row.spans] == [(4, 1)]
    (tmp_path / "bad").write_bytes(b"x O\nnotag\n")
    with pytest.raises(PySparkException, match="not a byte and a tag"):
        formats.read_byte_iob(spark, str(tmp_path / "bad")).collect()


def test_word_iob_counts_bytes(spark, tmp_path):
    (tmp_path / "w").write_bytes("‐é x O\nBob y B-n\nAnn z I-n\n\nq B-m\n".encode())
    rows = sorted(formats.read_word_iob(spark, str(tmp_path / "w")).collect(), key=lambda r: r.doc_id)
    assert [bytes(r.body) for r in rows] == ["‐é Bob Ann".encode(), b"q"]
    assert [[(s.start, s.len, s.type) for s in r.spans] for r in rows] == [[(6, 7, "n")], [(0, 1, "m")]]


def test_scorer_input_checks_its_fields(spark, tmp_path):
    (tmp_path / "ok").write_text("a B-x B-x\nb O O\n\nc O B-y\n")
    (tmp_path / "bar").write_text("a|B-x|O\n")
    (tmp_path / "bad").write_text("a B-x O\nb c d O O\n")
    assert formats.read_conll(spark, str(tmp_path / "ok")).count() == 2
    assert formats.read_conll(spark, str(tmp_path / "bar"), delimiter="|").first().gold == ["B-x"]
    with pytest.raises(PySparkException, match="number of features"):
        formats.read_conll(spark, str(tmp_path / "bad")).collect()


def test_invalid_bytes_are_repaired(spark):
    df = spark.createDataFrame([("a\xe2b",), ("\xc3\xa9",)], "v string")
    assert [r[0] for r in df.select(repair_utf8("v")).collect()] == ["a�b", "é"]
    assert df.select(repair_utf8("v", "*")).first()[0] == "a*b"


def test_words_of_an_empty_text(spark):
    d = spark.createDataFrame([(1, ""), (2, "a b")], "doc_id long, text string")
    assert sorted((r.doc_id, r.start, r.word) for r in words(d).collect() if r.len) == [(2, 0, "a"), (2, 2, "b")]


def test_pieces_count_bytes(spark):
    df = spark.createDataFrame([(1, 0, ["é", "ü"])], "doc_id long, i int, pieces array<string>")
    rows = bpe.pieces_rows(df).orderBy("idx").collect()
    assert [(r.off, r.len, r.printed) for r in rows] == [(0, 2, "é@@"), (2, 2, "ü")]
    vocab = spark.createDataFrame([("é", 300)], "token string, id int")
    ids = bpe.bpe_ids(bpe.pieces_rows(df).withColumn("is_final", F.col("idx") == 1), vocab).orderBy("idx").collect()
    assert [(r.piece_id, r.ids, r.unknown) for r in ids] == [(300, [300], 0), (None, [195, 188], 2)]
    emb = spark.createDataFrame([("é", 4), ("<UNKNOWN>", 9)], "token string, id int")
    got = bpe.embedding_ids(bpe.pieces_rows(df), emb).orderBy("idx").collect()
    assert [(r.emb_id, r.unknown) for r in got] == [(4, 0), (9, 2)]


def test_learned_merges_against_counting(spark):
    w = spark.createDataFrame([(x,) for x in ["low"] * 5 + ["lower"] * 2 + ["newest"] * 6 + ["widest"] * 3], "word string")
    syms = {x: [*x[:-1], x[-1] + bpe.EOW] for x in ("low", "lower", "newest", "widest")}
    freq, want = {"low": 5, "lower": 2, "newest": 6, "widest": 3}, []
    for _ in range(6):
        count = {}
        for x, s in syms.items():
            for p in zip(s, s[1:]):
                count[p] = count.get(p, 0) + freq[x]
        best = max(count, key=lambda p: (count[p], p))
        want.append(best)
        for x, s in syms.items():
            out, i = [], 0
            while i < len(s):
                if tuple(s[i:i + 2]) == best:
                    out.append(s[i] + s[i + 1])
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            syms[x] = out
    assert bpe.learn_bpe(w, 6) == want
    assert bpe.learn_bpe(w, 6, min_frequency=100) == []


def test_decoding_of_computed_emissions(spark):
    """Emissions that a projection computes, used once, masked and unmasked."""
    rng = np.random.default_rng(3)
    U, bs, be = rng.normal(size=(3, 3)), rng.normal(size=3), rng.normal(size=3)
    df = spark.createDataFrame([(i, rng.integers(0, 9, k).tolist(), min(k, 2)) for i, k in enumerate([0, 1, 4, 7, 4])], "i int, b array<int>, n int")
    e = df.select("i", "b", "n", F.transform("b", lambda x: F.transform(F.sequence(F.lit(1), F.lit(3)), lambda j: ((x * j) % 5) / 5.0)).alias("s"))
    got = crf.log_partition(crf.viterbi(crf.viterbi(e, "s", U, bs, be), "s", U, bs, be, "m", mask="n"), "s", U, bs, be, "z", mask="n")
    for r in got.drop("s").collect():
        x = np.array([[((v * j) % 5) / 5.0 for j in (1, 2, 3)] for v in r.b]).reshape(len(r.b), 3)
        assert r.path == crf.viterbi_path(x, U, bs, be).tolist()
        assert r.m == crf.viterbi_path(x, U, bs, be, r.n).tolist()
        assert abs(r.z - crf.log_partition_np(x, U, bs, be, r.n)) < 1e-9

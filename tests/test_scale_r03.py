"""Steps that many queries share: right rows, and no array built again for each element."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bytespan.functions import annotations as an
from bytespan.operators import crf, emissions, evaluate as ev, features as fe, spans as sp, windows as wn
from bytespan.operators.words import words


def _plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_parse_triples_splits_a_line_once(spark):
    df = spark.createDataFrame([(1, "S12 L3 name S0 L1 number"), (2, ""), (3, None), (4, " S5 L2 ")], "id int, line string")
    got = df.select("id", an.parse_triples("line").alias("t"))
    assert _plan(got).count("split(") == 1
    assert {r.id: r.t and [tuple(x) for x in r.t] for r in got.collect()} == {1: [(12, 3, "name"), (0, 1, "number")], 2: [], 3: None, 4: []}


def test_words_are_split_by_batch(spark):
    texts = ["a bb\nc", "", None, " é  x", "zz "] + [f"w{i} é{i}" for i in range(700)]
    got = words(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert "MapInArrow" in _plan(got) and "sequence(" not in _plan(got)
    want = set()
    for d, t in enumerate(texts):
        at = 0
        for i, w in enumerate([] if t is None else t.replace("\n", " ").split(" ")):
            raw = w.encode()
            want.add((d, i, at, len(raw), raw.decode("latin-1")))
            at += len(raw) + 1
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_byte_ids_of_null_empty_and_padded_views(spark):
    df = spark.createDataFrame([(0, "abÿ"), (1, ""), (2, None)], "k int, v string").coalesce(1)
    assert [r.x for r in df.select("k", wn.byte_ids("v").alias("x")).sort("k").collect()] == [[97, 98, 255], [], None]
    assert [r.x for r in df.select("k", wn.byte_ids("v", 2).alias("x")).sort("k").collect()] == [[97, 98], [0, 0], None]


def test_byte_dropout_sorts_the_hashes_once(spark):
    df = spark.createDataFrame([(7, 2, [5, 0, 6, 7, 8, 9, 10, 11]), (None, 0, [1] * 8)], "doc_id long, win int, ids array<int>")
    got = wn.byte_dropout(df, 0.5, 123, 8)
    assert _plan(got).count("md5(") == 1 and _plan(got).count("sort") == 1
    for r, src in zip(got.collect(), [[5, 0, 6, 7, 8, 9, 10, 11], [1] * 8]):
        key = "".join(f"{x}:" for x in (123, r.doc_id, r.win) if x is not None)
        drawn = sorted(range(8), key=lambda p: hashlib.md5(f"{key}{p}".encode()).hexdigest())[:4]
        assert r.ids == [256 if p in drawn and x else x for p, x in enumerate(src)]


def test_spans_are_sorted_without_a_comparator(spark):
    df = spark.createDataFrame([(1, 1, 5, 2, "x"), (1, 0, 5, 3, "y"), (1, 2, 0, 1, "z")], "doc_id int, ord int, start int, len int, type string")
    got = sp.nest_spans(df)
    assert "array_sort" not in _plan(got)
    assert [tuple(s) for s in got.first().spans] == [(0, 1, "z"), (5, 3, "y"), (5, 2, "x")]


def test_score_sums_are_those_of_the_scores(spark):
    model = emissions.Scorer(np.random.default_rng(1).normal(size=(7, emissions.IDS, 3)), np.arange(3.0))
    df = spark.createDataFrame([(0, [1, 2, 3, 4]), (1, []), (2, [9])], "k int, ids array<int>")
    whole = {r.k: r.scores for r in emissions.score(df, model, normalize=False).collect()}
    for r in emissions.score(df, model, normalize=False, sums={"best": "max", "total": "sum"}).collect():
        assert r.best == pytest.approx(sum(map(max, whole[r.k]))) and r.total == pytest.approx(sum(map(sum, whole[r.k])))


def test_masked_figures_beside_unmasked_ones(spark):
    U, b, e = np.arange(9.0).reshape(3, 3) / 7, np.arange(3.0), np.arange(3.0)[::-1]
    x = np.random.default_rng(2).normal(size=(4, 5, 3))
    n = [5, 2, 0, 5]
    df = spark.createDataFrame([(i, n[i], x[i].tolist()) for i in range(4)], "k int, n int, s array<array<double>>")
    want = {"m": crf.Want("logz", masked=True), "z": crf.Want("logz"), "p": crf.Want("path", masked=True)}
    for r in crf.lattice(df, want, U, b, e, scores="s", mask="n").collect():
        assert r.z == pytest.approx(float(crf.logz_batch(x[r.k][None], U, b, e)[0]))
        assert r.m == pytest.approx(float(crf.logz_batch(x[r.k][None, :r.n], U, b, e)[0]) if r.n else 0.0)
        assert r.p == crf.viterbi_path(x[r.k], U, b, e, r.n).tolist()


def test_chunk_diff_counts_each_side_once(spark):
    schema = "doc_id int, start int, len int, type string"
    g = spark.createDataFrame([(1, 0, 1, "a"), (1, 0, 1, "a"), (1, 5, 1, "b"), (2, 0, 1, None), (2, 0, 1, None)], schema)
    p = spark.createDataFrame([(1, 0, 1, "a"), (1, 6, 1, "b"), (1, 6, 1, "b"), (2, 0, 1, None)], schema)
    got = ev.chunk_diff(g, p)
    assert all(_plan(d).count("Union") == 1 for d in got)
    assert [sorted(map(str, d.collect())) for d in got] == [sorted(map(str, d.collect())) for d in (g.intersect(p), g.exceptAll(p), p.exceptAll(g))]


def test_tags_joined_by_document_are_those_joined_by_position(spark):
    schema = "doc_id int, tags array<string>"
    g = spark.createDataFrame([(1, ["O", None, "B-x"]), (1, ["O"]), (2, None), (3, [])], schema)
    p = spark.createDataFrame([(1, ["B-x"]), (1, ["O", "O", None]), (2, None)], schema)
    rows = lambda d: d.select("doc_id", F.posexplode_outer("tags").alias("pos", "tag")).filter("pos is not null")
    assert sorted(map(str, ev.join_gold_pred_docs(g, p).collect())) == sorted(map(str, ev.join_gold_pred(rows(g), rows(p)).collect()))
    with pytest.raises(Exception, match="differ"):
        ev.join_gold_pred_docs(g, p.withColumn("tags", F.slice("tags", 1, 2))).collect()


def test_byte_channel_is_cut_from_the_windows(spark):
    docs = spark.createDataFrame([(1, bytearray("añb\nc" * 40, "utf-8")), (2, bytearray())], "doc_id int, body binary")
    a, b = (sorted(map(tuple, fe.channel_windows(docs, ["byte"], 24, 12, s).select("doc_id", "win", "n", "byte").collect())) for s in ("document", "window"))
    assert a == b
    assert "_view" not in _plan(fe.channel_windows(docs, ["byte"], 24, 12))

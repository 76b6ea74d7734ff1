"""Emission scorer, tagger, selection, joins by position, span tokens."""

import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from bytespan.operators import emissions as em
from bytespan.operators import evaluate as ev
from bytespan.operators import features as fe
from bytespan.operators import tags as tg
from bytespan.plans import tagger
from bytespan.sources.formats import zip_lines


def corpus(spark, n=60):
    rnd, docs, spans = random.Random(1), [], []
    for i in range(n):
        text, k = "", 0
        while len(text) < 150:
            w = rnd.choice(["12", "345", "Ann", "Bob", "of", "the", "in"])
            if w[0].isdigit() or w[0].isupper():
                spans.append((i, k, len(text), len(w), "number" if w[0].isdigit() else "name"))
                k += 1
            text += w + " "
        docs.append((i, text.encode()))
    return (spark.createDataFrame(docs, "doc_id long, body binary"),
            spark.createDataFrame(spans, "doc_id long, ord int, start int, len int, type string"))


def test_tagger_learns_and_selects(spark):
    docs, spans = corpus(spark)
    docs, spans = docs.cache(), spans.cache()
    model, scores, f1 = tagger.train_and_select(docs, spans, ["name", "number"], [{"reg": 1.0, "sample": 2000}, {"reg": 1e-4, "sample": 6000}], W=40)
    assert f1 > 95 and scores.count() == 2
    out = tagger.tag_corpus(docs, model).join(docs, "doc_id").collect()
    assert all(len(r.tags) == len(r.body) for r in out) and len(out) == 60
    v = {r.doc_id: r.vector for r in em.sample_vectors(tagger.scored_windows(docs, model), 40).collect()}
    assert len(v) == 60 and len(v[0]) == 5


def test_scores_are_sums_of_look_ups(spark):
    rng = np.random.default_rng(2)
    model = em.Scorer(rng.normal(size=(3, em.IDS, 4)), rng.normal(size=4))
    df = spark.createDataFrame([(0, [5, 6, 7]), (1, []), (2, [9]), (3, None)], "i int, ids array<int>")
    for r in em.score(df, model, normalize=False).collect():
        x = [0, *(r.ids or []), 0]
        want = [model.bias + sum(model.tables[k, x[p + k]] for k in range(3)) for p in range(len(x) - 2)]
        assert np.allclose(np.array(r.scores).reshape(-1, 4), np.array(want).reshape(-1, 4))
    for r in em.score(df, model).collect():
        assert np.allclose(np.exp(np.array(r.scores).reshape(-1, 4)).sum(axis=1), 1)


def test_lookup_raises_on_unknown_symbols(spark):
    vocab = spark.createDataFrame([("a", 1), ("b", 2)], "tag string, id int")
    assert sorted(r.id for r in tg.lookup(spark.createDataFrame([("a",), ("b",), ("a",)], "x string"), vocab, "x").collect()) == [1, 1, 2]
    with pytest.raises(PySparkException, match="not in the vocabulary"):
        tg.lookup(spark.createDataFrame([("c",)], "x string"), vocab, "x").select("id").collect()


def test_gold_and_predicted_positions(spark):
    g = spark.createDataFrame([(0, 0, "B-x"), (0, 1, None), (0, 2, "O")], "doc_id long, pos int, tag string")
    p = g.withColumn("tag", F.when(F.col("tag").isNotNull(), F.lit("O")))
    assert sorted((r.pos, r.gold, r.pred) for r in ev.join_gold_pred(g, p).collect()) == [(0, "B-x", "O"), (1, "-X-", "-X-"), (2, "O", "O")]
    with pytest.raises(PySparkException, match="positions differ"):
        ev.join_gold_pred(g, p.filter("pos < 2")).select("pos", "gold").collect()


def test_lines_zip(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "line_no long, line string")
    assert [(r.a, r.b) for r in zip_lines(a, a.filter("line_no = 0")).collect()] == [("x", "x")]
    with pytest.raises(PySparkException, match="differ in length"):
        zip_lines(a, a.filter("line_no = 0"), strict=True).select("a").collect()


def test_span_tokens_to_tags(spark):
    df = spark.createDataFrame([(["S4", "L2", "x", "S0", "L9", "x", "S1", "L2", "y", "junk", "<STOP>", "S0", "L1", "x"], 6)], "t array<string>, n int")
    assert fe.sle_to_iob(df, "t", "n", ["x", "y"]).first().tags == ["O", "B-y", "I-y", "O", "B-x", "I-x"]


def test_segments_equal_positions(spark):
    df = spark.createDataFrame([(0, ["O", "O", "B"], ["O", "B", "B"]), (1, [], []), (2, ["B"], ["O"])], "doc_id long, gold array<string>, pred array<string>")
    rows = lambda f: sorted((r.gold, r.pred, r.n) for r in ev.confusion(f).collect())
    assert rows(ev.pair_segments(df)) == rows(ev.position_pairs(df)) == [("B", "B", 1), ("B", "O", 1), ("O", "B", 1), ("O", "O", 1)]
    assert ev.token_accuracy(ev.pair_segments(df)).first()["accuracy"] == 50.0


def test_long_spans_keep_their_tags(spark, tmp_path):
    """FN6 query: words over 4096 bytes are tagged whole; a document with such a word alone stays."""
    from bytespan.plans.queries import q_sle_to_iob
    spark.createDataFrame([(1, "see 12 " + "7" * 5000 + " Bob"), (2, "x" * 9000 + "@a.b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_b, r.n_i, r.sum_start) for r in q_sle_to_iob(spark, str(tmp_path)).collect()}
    assert got == {1: (3, 1 + 4999 + 2, 4 + 7 + 5008), 2: (1, 9003, 0)}


def test_vocabulary_is_numbered_in_ranges(spark):
    """Ids follow byte order, and no task holds all words."""
    words = sorted({f"{p}{i}" for p in ("", "http://x/", "é") for i in range(3000)}, key=lambda w: w.encode())
    vocab = fe.word_vocab(spark.createDataFrame([(w,) for w in words + words[::3] + [""]], "word string").repartition(5))
    rows = vocab.withColumn("p", F.spark_partition_id()).collect()
    assert {r.word: r.id for r in rows} == {w: i for i, w in enumerate(words)} and len(rows) == len(words)
    assert max(sum(r.p == p for r in rows) for p in {r.p for r in rows}) < len(words) / 2

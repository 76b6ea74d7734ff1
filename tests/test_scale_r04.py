"""Round 4: F8 and F9 (all positions train the scorer), F2 (no scores are shuffled), F4, F5, F7."""

import numpy as np
import pytest
from pyspark.errors import PySparkException

from bytespan.operators import emissions as em
from bytespan.operators import runs as rn
from bytespan.plans import tagger


def test_all_positions_train_the_scorer(spark):
    """Labels that a single window shows are learned: none is left out by a draw."""
    rows = [([9] * 50, [0] * 50) for _ in range(2000)] + [([20 + i] * 50, [1 + i % 2] * 50) for i in range(12)]
    df = spark.createDataFrame(rows, "w array<int>, y array<int>").repartition(3)
    model = em.fit_channels(df, 3, [em.Channel("w", 0)])
    got = model.scores({"w": np.arange(20, 32)}, np.array([12])).argmax(axis=1)
    assert got.tolist() == [1 + i % 2 for i in range(12)]


def test_positions_are_counted_by_their_surroundings(spark):
    rng = np.random.default_rng(3)
    rows = [(rng.integers(0, 70_000, 6).tolist() if i % 3 else [1, 2, 1, 2, 0, 0], rng.integers(0, 3, 6).tolist(), [0, 1, None, 0]) for i in range(60)]
    df = spark.createDataFrame([*rows, (None, [1, 1, 1, 1, 1, 1], [2, 2]), ([], [], [])], "a array<int>, b array<int>, y array<int>")
    channels = [em.Channel("a", 2), em.Channel("b", 1)]
    blocks = [(c, k) for c in channels for k in range(-c.context, c.context + 1)]
    got = {tuple(r)[:-1]: r.n for r in em._surroundings(df, channels, blocks, "y").collect()}
    want: dict = {}
    for r in df.collect():
        for i, y in enumerate(r.y):
            if y is not None:
                own = {"a": r.a or [], "b": r.b or []}
                key = (y, *[own[c.column][i + k] if 0 <= i + k < len(own[c.column]) else 0 for c, k in blocks])
                want[key] = want.get(key, 0) + 1
    assert got == want


def test_tag_ids_of_runs(spark):
    df = spark.createDataFrame([([(0, "O"), (2, "B-x"), (3, "I-x")], 6), ([], 4), ([(0, "B-x")], 1), (None, None)], f"runs {rn.RUNS}, n int")
    vocab = {"O": 0, "B-x": 1, "I-x": 2}
    assert [r.y for r in df.select(rn.tag_ids("runs", "n", vocab).alias("y")).collect()] == [[0, 0, 1, 2, 2, 2], [], [1], []]
    with pytest.raises(PySparkException, match="unknown tag I-x"):
        df.select(rn.tag_ids("runs", "n", {"O": 0, "B-x": 1}).alias("y")).collect()


def test_vectors_without_a_shuffle_of_scores(spark):
    rng = np.random.default_rng(5)
    tags = tagger.iob_tags(["a", "b"])
    model = tagger.Tagger(tags, em.ChannelScorer({"byte": rng.normal(size=(7, 257, 5))}, rng.normal(size=5)),
                          rng.normal(size=(5, 5)), rng.normal(size=5), rng.normal(size=5), W=20)
    bodies = [bytes(rng.integers(1, 256, n).tolist()) for n in (0, 1, 9, 10, 11, 19, 20, 21, 30, 31, 200, 555)]
    docs = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(bodies)] + [(3, bytearray(b"twice " * 9)), (77, None), (None, bytearray(b"no key"))], "doc_id long, body binary")
    old = {r.doc_id: r.vector for r in em.sample_vectors(tagger.scored_windows(docs, model), 20).collect()}
    df = tagger.document_vectors(docs, model)
    new = {r.doc_id: r.vector for r in df.collect()}
    docs_once = [i for i in old if i != 3]     # of two rows with one id and other texts, either window may come first
    assert old.keys() == new.keys() and all(np.allclose(old[i], new[i]) for i in docs_once)
    assert df.schema == em.sample_vectors(tagger.scored_windows(docs, model), 20).schema
    below = [line for line in df._jdf.queryExecution().optimizedPlan().toString().split("Window", 1)[1].split("\n") if "scores" in line]
    assert not below


def test_documents_are_joined_by_their_runs(spark):
    """the rows and what raises are those of whole tag lists; the join sees runs."""
    from pyspark.sql import functions as F

    from bytespan.operators import evaluate as ev
    schema = f"doc_id long, n_doc int, runs {rn.RUNS}"
    g = spark.createDataFrame([(1, 5, [(0, "O"), (2, "B-x"), (3, "I-x")]), (2, 2, [(0, "B-y")]), (3, None, []), (4, 0, []), (5, 2, [(0, "O")]), (5, 2, [(0, "B-x")])], schema)
    p = spark.createDataFrame([(1, 5, [(0, "B-x"), (4, "O")]), (2, 2, [(0, "O")]), (4, 0, []), (5, 2, [(0, "B-y"), (1, "O")])], schema)
    whole = lambda d: d.select("doc_id", rn.to_tags("runs", "n_doc").alias("tags"))
    new = ev.join_gold_pred_docs(g, p, runs="runs")
    assert sorted(map(str, new.collect())) == sorted(map(str, ev.join_gold_pred_docs(whole(g), whole(p)).collect())) != []
    short = p.withColumn("n_doc", F.when(F.col("doc_id") == 2, 1).otherwise(F.col("n_doc")))
    with pytest.raises(PySparkException, match="positions differ"):
        ev.join_gold_pred_docs(g, short, runs="runs").collect()
    below = new._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[1]
    assert "array_repeat" not in below


def test_chain_fit_by_table_equals_the_general_one(spark):
    """emissions by id are looked up, sequences of all lengths go together."""
    from bytespan.operators import crf
    rng = np.random.default_rng(8)
    table = rng.normal(size=(300, 3))
    size = [0, 1, 2, 12, 12, 12, *rng.integers(1, 12, 40).tolist()]
    rows = [(rng.integers(0, 300 if i % 2 else 200, 12).tolist(), rng.integers(0, 3, 12).tolist(), n) for i, n in enumerate(size)]
    df = spark.createDataFrame([*rows, (None, [], 5)], "ids array<int>, y array<int>, n int").repartition(3)

    class General:
        scores = crf.TableScorer(table).scores

    fast, slow = (crf.fit_crf(df, "y", 3, ids="ids", scorer=s, mask="n", iters=4) for s in (crf.TableScorer(table), General()))
    assert np.allclose(fast.history, slow.history) and np.allclose(fast.U, slow.U, atol=1e-6) and len(fast.history) > 2
    assert np.allclose(fast.b_start, slow.b_start, atol=1e-6) and np.allclose(fast.b_end, slow.b_end, atol=1e-6)
    ids, k = np.array([x for r in rows if r[2] for x in r[0][:r[2]]]), np.array([r[2] for r in rows if r[2]])
    assert [x.shape for x, _ in crf._by_length(ids, k)] == [(12, 45)]       # one recursion, not one a length
    with pytest.raises(PySparkException, match="fewer tags"):
        crf.fit_crf(df.withColumn("y", F_slice()), "y", 3, ids="ids", scorer=crf.TableScorer(table), mask="n")


def F_slice():
    from pyspark.sql import functions as F
    return F.slice("y", 1, 1)

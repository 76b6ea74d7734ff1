"""Rules on runs against the same rules on a tag for each position."""

import random

import pytest
from pyspark.sql import functions as F

from bytespan.operators import crf, runs
from bytespan.operators import evaluate as ev
from bytespan.operators import spans as sp
from bytespan.operators import stitch as st
from bytespan.operators import tags as tg

IOB = ["O", "O", "B-a", "I-a", "I-b", "B-b", "I-a"]
ANY = [*IOB, "S-a", "E-a", "E-b", "[", "]", ".", "I-x-y"]


def sequences(seed, alphabet, n=150):
    rnd = random.Random(seed)
    out = [[], ["O"], ["B-a"], ["I-a"], ["B-a"] * 4, ["I-a"] * 3 + ["O"]]
    for _ in range(n):
        t = []
        while len(t) < rnd.randint(1, 30):
            t += [rnd.choice(alphabet)] * rnd.choice([1, 1, 1, 2, 5])
        out.append(t)
    return out


@pytest.fixture(scope="module")
def frames(spark):
    def make(alphabet, seed=1):
        rows = [(i, t, len(t)) for i, t in enumerate(sequences(seed, alphabet))]
        return spark.createDataFrame(rows, "doc_id long, tags array<string>, n int").withColumn("runs", runs.from_tags("tags")).repartition(3)
    return make


def same(df, a, b):
    assert df.filter(~a.eqNullSafe(b)).count() == 0


def test_there_and_back(frames):
    df = frames(ANY)
    same(df, runs.to_tags("runs", "n"), F.col("tags"))
    assert df.filter(F.size("runs") > F.size("tags")).count() == 0


def test_schemes(frames):
    df = frames(IOB)
    same(df, runs.to_tags(runs.to_iobes("runs", "n"), "n"), tg.to_iobes("tags"))
    same(df, runs.to_tags(runs.to_iob(runs.to_iobes("runs", "n")), "n"), tg.to_iob(tg.to_iobes("tags")))
    df = frames([*IOB, "I-a", "I-b"])
    same(df, runs.to_tags(runs.to_iob2("runs", "n"), "n"), tg.to_iob2("tags"))
    df = frames([*IOB, "I-a-b"])
    same(df, runs.to_tags(runs.to_iob2("runs", "n"), "n"), tg.to_iob2("tags"))
    with pytest.raises(Exception, match="Invalid IOB"):
        frames(["X-a"]).select(runs.to_iobes("runs", "n")).collect()


@pytest.mark.parametrize("stray", ["begin", "ignore"])
def test_spans(frames, stray):
    df = tg.with_spans(frames(IOB), "tags", "spans", stray)
    same(df, runs.to_spans("runs", "n", stray), F.col("spans"))


def test_stray_raises(spark):
    for tags in (["I-a"], ["O", "I-a"], ["B-a", "O", "I-a", "I-a"]):
        df = spark.createDataFrame([(tags, len(tags))], "tags array<string>, n int")
        with pytest.raises(Exception, match="stray I- tag at byte"):
            df.select(runs.to_spans(runs.from_tags("tags"), "n")).collect()
    ok = spark.createDataFrame([(["O", "B-a", "I-b", "B-a"], 4)], "tags array<string>, n int")
    assert [tuple(x) for x in ok.select(runs.to_spans(runs.from_tags("tags"), "n").alias("s")).first().s] == [(1, 2, "a"), (3, 1, "a")]


def test_chunks(frames):
    df = ev.with_chunks(frames(ANY), "tags", "chunks")
    same(df, runs.chunks("runs", "n"), F.col("chunks"))


def test_spans_to_runs(spark):
    rnd = random.Random(9)
    rows = [(i, [(rnd.randint(0, 30), rnd.randint(0, 8), rnd.choice("ab")) for _ in range(rnd.randint(0, 6))], rnd.randint(0, 32)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, spans array<struct<start:int,len:int,type:string>>, n int")
    for rule in ("rightmost", "leftmost"):
        both = runs.with_runs(sp.with_tags(df, conflict=rule), conflict=rule)
        same(both, runs.to_tags("runs", "n"), F.col("tags"))


def test_stitching(spark):
    rnd = random.Random(4)
    W, rows = 8, []
    for doc in range(40):
        n_doc = rnd.randint(0, 40)
        for win in range(max(0, -(-(n_doc - W) // 4)) + 1):
            n = min(W, n_doc - win * 4)
            t = []
            while len(t) < n:
                t += [rnd.choice(IOB)] * rnd.choice([1, 2, 6])
            rows.append((doc, win, win * 4, n, t[:n]))
    df = spark.createDataFrame(rows, "doc_id long, win int, start int, n int, tags array<string>")
    want = st.assemble(st.stitch(df, W), ["tags"])
    got = runs.assemble(runs.stitch(df.withColumn("runs", runs.from_tags("tags")), W))
    j = want.join(got, "doc_id")
    assert j.count() == 40
    same(j, runs.to_tags("runs", "n_doc"), F.col("tags"))


def test_segments_and_counts(frames, spark):
    a, b = frames(ANY, 1), frames(ANY, 2)
    n = F.least("n", "m")
    df = a.join(b.select("doc_id", F.col("tags").alias("other"), F.col("n").alias("m")), "doc_id")
    df = df.select("doc_id", n.alias("n_doc"), F.slice("tags", F.lit(1), n).alias("gold"), F.slice("other", F.lit(1), n).alias("pred"))
    side = lambda c: df.select("doc_id", "n_doc", runs.from_tags(c).alias("runs"))
    total = lambda x: sorted(map(tuple, x.groupBy("gold", "pred").agg(F.sum("n").cast("long")).collect()))
    assert total(runs.pair_segments(side("gold"), side("pred"))) == total(ev.position_pairs(df).withColumn("n", F.lit(1)))
    counts = {r.tag: r.n for r in runs.tag_counts(side("gold"), "runs", "n_doc").collect()}
    assert counts == {r.t: r["count"] for r in df.select(F.explode("gold").alias("t")).groupBy("t").count().collect()}
    with pytest.raises(Exception, match="positions differ"):
        runs.pair_segments(side("gold"), side("pred").filter("doc_id <> 3")).collect()


def test_bigrams(frames):
    df = frames(IOB)
    got = crf.bigram_table(df.select(F.inline_outer(runs.bigrams("runs", "n"))).filter("n is not null"))
    want = crf.tag_bigrams(df, "tags")
    rounded = lambda x: sorted((r.prev, r.next, r.n, round(r.logp, 9)) for r in x.collect())
    assert rounded(got) == rounded(want)


def test_a_long_document_is_as_long_as_its_runs(spark):
    """100 MB with three spans: no value per byte is made."""
    n = 100_000_000
    df = spark.range(1).select(F.lit(1).alias("doc_id"), F.lit(n).alias("n_doc"),
                               F.expr("array(named_struct('start', 5, 'len', 3, 'type', 'a'), named_struct('start', 50000000, 'len', 40000000, 'type', 'b'), named_struct('start', 99999999, 'len', 1, 'type', 'a'))").alias("s"))
    df = df.withColumn("runs", runs.from_spans("s", "n_doc")).withColumn("runs", runs.to_iob(runs.to_iobes("runs", "n_doc")))
    assert [tuple(r) for r in runs.span_rows(df).select("start", "len", "type").collect()] == [(5, 3, "a"), (50_000_000, 40_000_000, "b"), (99_999_999, 1, "a")]
    assert {r.tag: r.n for r in runs.tag_counts(df, "runs", "n_doc").collect()} == {"O": n - 40_000_004, "B-a": 2, "I-a": 2, "B-b": 1, "I-b": 39_999_999}

"""Golden and brute-force tests for windows, clipping, tags, stitching and scoring."""

import random

from pyspark.sql import functions as F

from bytespan.operators import evaluate as ev
from bytespan.operators import spans as sp
from bytespan.operators import stitch as st
from bytespan.operators import tags as tg
from bytespan.operators import windows as wn
from bytespan.plans import roundtrip as rt


def _docs(spark, texts):
    return spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "doc_id long, body binary")


def test_window_counts(spark):
    ns = [0, 149, 150, 151, 225, 226, 400]
    d = _docs(spark, ["x" * n for n in ns])
    got = {r["doc_id"]: r["c"] for r in wn.make_windows(d, 150, 75).groupBy("doc_id").agg(F.count("*").alias("c")).collect()}
    assert [got[i] for i in range(len(ns))] == [1, 1, 1, 2, 2, 3, 5]


def test_clip_edges(spark):
    d = _docs(spark, ["a" * 300])
    spans = spark.createDataFrame([(0, 0, 70, 10, "t"), (0, 1, 145, 10, "t"), (0, 2, 75, 150, "t"), (0, 3, 10, 160, "t")],
                                  "doc_id long, ord int, start int, len int, type string")
    w = wn.make_windows(d, 150, 75)
    got = sorted((r["win"], r["ord"], r["start"]) for r in wn.clip_long(w, spans, 150, 75).collect())
    # span 0 [70,80): windows 0 only; span 1 [145,155): window 1; span 2 fills window 1 exactly; span 3 too long
    assert got == [(0, 0, 70), (1, 1, 70), (1, 2, 0)]
    lost = [r["ord"] for r in wn.lost_spans(w, spans, 150, 75).collect()]
    assert lost == [3]


def _brute_rightmost(spans):
    kept, taken = [], set()
    for s in sorted(spans, key=lambda x: (x[0], x[3]), reverse=True):
        if s[1] < 1 or any(p in taken for p in range(s[0], s[0] + s[1])):
            continue
        kept.append(s)
        taken.update(range(s[0], s[0] + s[1]))
    return sorted((a, b, c) for a, b, c, _ in kept)


def test_rightmost_and_tags_random(spark):
    rng = random.Random(7)
    rows, expect = [], {}
    for doc in range(30):
        n = rng.randint(0, 40)
        spans = []
        for o in range(rng.randint(0, 8)):
            s = rng.randint(0, max(0, n - 1))
            spans.append((s, rng.randint(1, 6), rng.choice("xy"), o))
        spans = [x for x in spans if x[0] + x[1] <= n]
        rows.append((doc, n, [(a, b, c) for a, b, c, _ in spans]))
        kept = _brute_rightmost(spans)
        tags = ["O"] * n
        for a, b, c in kept:
            tags[a] = "B-" + c
            for p in range(a + 1, a + b):
                tags[p] = "I-" + c
        expect[doc] = tags
    df = spark.createDataFrame(rows, "doc_id long, n int, spans array<struct<start:int,len:int,type:string>>")
    got = {r["doc_id"]: r["tags"] for r in sp.with_tags(df, "spans", "n", "tags").collect()}
    assert got == expect


def test_iobes_round_trip(spark):
    tags = ["B-a", "I-a", "I-a", "O", "B-b", "O", "B-a", "B-a", "I-a"]
    df = spark.createDataFrame([(tags,)], "t array<string>")
    r = df.select(tg.to_iobes("t").alias("e")).select("e", tg.to_iob("e").alias("b")).collect()[0]
    assert r["e"] == ["B-a", "I-a", "E-a", "O", "S-b", "O", "S-a", "B-a", "E-a"]
    assert r["b"] == tags


def test_iob2(spark):
    df = spark.createDataFrame([(["I-a", "I-a", "O", "I-b", "I-a", "B-a"],), (["X-a"],), (["B-a-b"],)], "t array<string>")
    got = [r[0] for r in df.select(tg.to_iob2("t")).collect()]
    assert got[0] == ["B-a", "I-a", "O", "B-b", "B-a", "B-a"]
    assert got[1] is None and got[2] is None


def test_tags_to_spans_stray(spark):
    df = spark.createDataFrame([(["I-x", "I-x", "O", "B-y", "I-z", "O", "I-q"],)], "tags array<string>")
    begin = tg.with_spans(df, "tags", "s", "begin").collect()[0]["s"]
    assert [(s.start, s.len, s.type) for s in begin] == [(0, 2, "x"), (3, 2, "y"), (6, 1, "q")]
    ignore = tg.with_spans(df, "tags", "s", "ignore").collect()[0]["s"]
    assert [(s.start, s.len, s.type) for s in ignore] == [(3, 2, "y")]


def _brute_stitch(wins, W):
    """By definition: a window's cut is H, or, where the tag at H continues an
    entity, the last position before H that does not continue it (0 if none);
    a position has the tag of the last window that begins its own part there
    or before."""
    H = W // 2
    cut = [0]
    for t in wins[1:]:
        cut.append(H)
        if t[H].startswith("I-"):
            cut[-1] = max((p for p in range(H) if t[p] != t[H]), default=0)
    n = H * (len(wins) - 1) + len(wins[-1])
    owner = [max(k for k in range(len(wins)) if k * H + cut[k] <= p) for p in range(n)]
    return [wins[k][p - k * H] for p, k in enumerate(owner)]


def test_stitch_random(spark):
    rng = random.Random(3)
    W, S = 8, 4
    rows, expect = [], {}
    for doc in range(60):
        n = rng.randint(1, 30)
        k = max(0, -(-(n - W) // S)) + 1
        wins = []
        for w in range(k):
            m = min(W, n - w * S)
            wins.append([rng.choice(["O", "B-a", "I-a", "I-b", "B-b"]) for _ in range(m)])
            rows.append((doc, w, w * S, m, wins[-1]))
        expect[doc] = _brute_stitch(wins, W)
    df = spark.createDataFrame(rows, "doc_id long, win int, start int, n int, tags array<string>")
    got = {r["doc_id"]: r["tags"] for r in st.assemble(st.stitch(df, W), ["tags"]).collect()}
    assert got == expect


#: Tags and their chunks, worked out by hand.
CHUNKS = [
    ("", []),
    ("O O", []),
    ("B-a I-a O", [(0, 2, "a")]),
    ("I-a I-a", [(0, 2, "a")]),
    ("B-a B-a", [(0, 1, "a"), (1, 1, "a")]),
    ("B-a I-b", [(0, 1, "a"), (1, 1, "b")]),
    ("O I-a O I-a", [(1, 1, "a"), (3, 1, "a")]),
    ("B-a E-a O", [(0, 2, "a")]),
    ("E-a E-a", [(0, 1, "a"), (1, 1, "a")]),
    ("B-a I-a E-a E-a", [(0, 3, "a"), (3, 1, "a")]),
    ("E-a I-a", [(0, 1, "a"), (1, 1, "a")]),
    ("B-a O B-b I-b B-b", [(0, 1, "a"), (2, 2, "b"), (4, 1, "b")]),
    ("I-a B-a I-a", [(0, 1, "a"), (1, 2, "a")]),
    ("B-x-y I-x-y I-x", [(0, 2, "x-y"), (2, 1, "x")]),
]


def test_chunks_by_hand(spark):
    df = spark.createDataFrame([(i, s.split()) for i, (s, _) in enumerate(CHUNKS)], "doc_id long, tags array<string>")
    got = {r["doc_id"]: [(c.start, c.len, c.type) for c in r["chunks"]]
           for r in ev.with_chunks(df, "tags").collect()}
    assert got == {i: c for i, (_, c) in enumerate(CHUNKS)}


def test_roundtrip_recovers_spans(spark):
    text = "Alice met Bob at 10 in Paris. " * 20
    d = _docs(spark, [text])
    words, pos = [], 0
    for i, w in enumerate(text.split(" ")):
        if w[:1].isupper() or any(c.isdigit() for c in w):
            words.append((0, i, pos, len(w), "e"))
        pos += len(w) + 1
    spans = spark.createDataFrame(words, "doc_id long, ord int, start int, len int, type string")
    rec = rt.recovered_spans(d, spans, 150, 75, "error")
    assert sorted((r.start, r.len) for r in rec.collect()) == sorted((w[2], w[3]) for w in words)

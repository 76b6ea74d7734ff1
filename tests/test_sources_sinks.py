"""Golden and round-trip tests of readers and writers, numbering over file blocks, the store."""

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from bytespan.functions import annotations as an
from bytespan.operators import bpe, corpus, quality, runs, sentences, spans
from bytespan.operators import features as fe
from bytespan.operators import tags as tg
from bytespan.operators import words as wd
from bytespan.sinks import store, writers
from bytespan.sources import formats, text


def write(name, content):
    path = os.path.join(tempfile.mkdtemp(prefix="bs-"), name)
    with open(path, "wb") as f:
        f.write(content if isinstance(content, bytes) else content.encode())
    return path


def read(folder):
    parts = sorted(p for p in os.listdir(folder) if p.startswith("part"))
    return b"".join(open(os.path.join(folder, p), "rb").read() for p in parts)


def out():
    return os.path.join(tempfile.mkdtemp(prefix="bs-"), "out")


@pytest.fixture
def small_blocks(spark):
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    yield lambda size: spark.conf.set(key, str(size))
    spark.conf.set(key, old)


# ------------------------------------------------------------------ numbering inside files

def test_sentences_of_a_file_in_many_blocks(spark, small_blocks):
    rnd = random.Random(1)
    lines = [rnd.choice(["", "", " ", *(f"w{i} B-x" for i in range(9))]) for _ in range(4000)] + ["end O"]
    path = write("a.iob", "\n".join(lines))
    want, sent = [], 0
    for i, line in enumerate(lines):
        if line.strip():
            want.append((sent, i, line))
        else:
            sent += 1
    for size in (1 << 27, os.path.getsize(path) // 10 + 1, 997):
        small_blocks(size)
        df = text.read_segments(spark, path, lambda x: F.length(F.trim(x)) == 0)
        got = sorted((r.sent, r.line_no, r.line) for r in df.collect())
        assert got == want
        if size < 1 << 27:
            assert spark.read.text(path).rdd.getNumPartitions() >= 10
        assert sorted((r.line_no, r.line) for r in text.read_lines(spark, path).collect()) == list(enumerate(lines))


def test_word_iob_is_the_same_in_blocks(spark, small_blocks):
    path = write("a.iob", "".join(f"Ann x B-name\nLee y I-name\nsaw z O\n\n{'é' * (i % 4)}q r B-b\n\n" for i in range(300)))
    made = []
    for size in (1 << 27, 500):
        small_blocks(size)
        made.append(sorted((r.doc_id, bytes(r.body), str(r.spans)) for r in formats.read_word_iob(spark, path).collect()))
    assert made[0] == made[1] and len(made[0]) == 600
    assert made[0][0][:2] == (0, b"Ann Lee saw") and "len=7" in made[0][0][2]


def test_conll_boundaries_in_blocks(spark, small_blocks):
    path = write("a.conll", "".join("a B-x B-x\nb I-x O\n\nc O O\n-X- - -\n" for _ in range(200)))
    for size in (1 << 27, 300):
        small_blocks(size)
        got = sorted((r.doc_id, r.gold, r.pred) for r in formats.read_conll(spark, path).collect())
        assert got == sorted((2 * i + k, *x) for i in range(200) for k, x in enumerate([(["B-x", "I-x"], ["B-x", "O"]), (["O"], ["O"])]))


def test_token_offsets_are_rebased(spark, small_blocks):
    """SRC9, WIN8: offsets count from the end of the sentence before, plus one."""
    lines, at, want = [], 0, []
    rnd = random.Random(2)
    for sent in range(400):
        base = 0 if sent == 0 else at + 1
        pos = base
        for _ in range(rnd.randint(1, 4)):
            n = rnd.randint(1, 5)
            lines.append(f"{pos}\t{pos + n}\t{'t' * n}")
            want.append((pos - base, n))
            pos += n + 1
        at = pos - 1
        lines += [""] * rnd.choice([1, 1, 2])
    path = write("a.tok", "\n".join(lines) + "\n")
    for size in (1 << 27, 700):
        small_blocks(size)
        rows = formats.read_token_offsets(spark, path).collect()
        assert sorted((r.start, r.len) for r in rows) == sorted(want) and {r.type for r in rows} == {"TOK"}
        assert len({r.doc_id for r in rows}) == 400


def test_previous_and_dense_ranks(spark):
    rnd = random.Random(3)
    keys = sorted(rnd.sample(range(5000), 300))
    df = spark.createDataFrame([(f"f{k % 2}", k, k * 10) for k in keys], "file string, at long, v long").repartition(5)
    got = {(r.file, r.at): r.p for r in text.previous(df, ["file"], "at", "v", "p", width=64).collect()}
    for f in ("f0", "f1"):
        own = [k for k in keys if f"f{k % 2}" == f]
        assert [got[f, k] for k in own] == [None, *(k * 10 for k in own[:-1])]
    assert {r.at: r.r for r in text.dense_ranks(df, "at", "r", width=100).collect()} == {k: i for i, k in enumerate(keys)}


def test_embeddings(spark, small_blocks):
    """SRC8: header skipped, first occurrence wins, ids dense in line order."""
    lines = ["4 2", "a 1 2", "b 3.5 -4", "a 9 9", "c 0 1", "b 7 7", "<UNKNOWN> 5 6"]
    path = write("e.vec", "\n".join(lines) + "\n")
    for size in (1 << 27, 9):
        small_blocks(size)
        got = sorted((r.id, r.token, list(r.vec)) for r in formats.read_embeddings(spark, path, 2).collect())
        assert got == [(0, "a", [1, 2]), (1, "b", [3.5, -4]), (2, "c", [0, 1]), (3, "<UNKNOWN>", [5, 6])]


# ------------------------------------------------------------------ other readers

def test_bpe_codes_and_ordinal_iob(spark):
    codes = bpe.read_bpe_codes(spark, write("codes", "#version: 1\nx y\nt h\nth e</w>\n")).orderBy("rank").collect()
    assert [tuple(r) for r in codes] == [(0, "t", "h"), (1, "th", "e</w>")]
    path = write("p.iob", "97 B-x\n98,12,3 I-x\n32 O\n\n99 I-y\n")
    rows = sorted(formats.read_ordinal_iob(spark, path).collect(), key=lambda r: r.doc_id)
    assert [(r.bytes, [tuple(s) for s in r.spans]) for r in rows] == [([97, 98, 32], [(0, 2, "x")]), ([99], [(0, 1, "y")])]
    rows = formats.read_ordinal_iob(spark, write("q.iob", "a B-x\nO\nb O\n"), ordinal=False).collect()
    assert [(r.bytes, [tuple(s) for s in r.spans]) for r in rows] == [([97, 32, 98], [(0, 1, "x")])]


def test_triples_round_trip(spark):
    """SNK8 and SRC11."""
    docs = spark.createDataFrame([(0, bytearray(b"a\nb \xff")), (1, bytearray(b"cd"))], "doc_id long, body binary")
    sp = spark.createDataFrame([(0, 0, 0, 1, "x"), (0, 1, 2, 2, "y")], "doc_id long, ord int, start int, len int, type string")
    path = out()
    writers.write_triples(docs, sp, path)
    d, s = formats.read_triples(spark, path)
    assert sorted((r.doc_id, bytes(r.body)) for r in d.collect()) == [(0, b"a b \xff"), (1, b"cd")]
    assert sorted((r.doc_id, r.ord, r.start, r.len, r.type) for r in s.collect()) == [(0, 0, 2, 2, "y"), (0, 1, 0, 1, "x")]


# ------------------------------------------------------------------ writers

def test_byte_iob_round_trip(spark):
    """SNK2 and SRC3, any byte but a line feed."""
    body = bytes(range(11, 256))
    df = spark.createDataFrame([(i, bytearray(body), ["B-x"] + ["I-x"] * 9 + ["O"] * (len(body) - 10)) for i in range(3)], "doc_id long, body binary, tags array<string>")
    path = out()
    writers.write_byte_iob(df, path)
    rows = sorted(formats.read_byte_iob(spark, path).collect(), key=lambda r: r.doc_id)
    assert [bytes(r.body) for r in rows if r.file == rows[0].file][:1] == [body]
    assert all([tuple(s) for s in r.spans] == [(0, 10, "x")] for r in rows) and len(rows) == 3


def test_ordinal_writers(spark):
    """SNK3, SNK4, SNK10, PRJ10 on padded arrays."""
    df = spark.createDataFrame([(0, [104, 105, 0, 0], ["B-x", "I-x", "O", "O"]), (1, [32, 255], ["O", "O"])], "doc_id long, ids array<int>, tags array<string>")
    path = out()
    writers.write_ordinal_iob(df, path)
    assert read(path) == b"104 B-x\n105 I-x\n\n32 O\n255 O\n\n"
    rows = df.select("doc_id", F.posexplode(F.arrays_zip("ids", "tags")).alias("p", "z")).select((F.col("doc_id") * 10 + F.col("p")).alias("pos"), "doc_id", F.col("z.ids").alias("b"), F.col("z.tags").alias("tag")).filter("b > 0")
    path = out()
    writers.write_byte_iob_rows(writers.ordinal_to_byte_iob(rows), path)
    assert read(path) == b"h B-x\ni I-x\n<SPACE> O\n\xff O\n"
    got = {r.doc_id: r.text for r in writers.render_text(rows).collect()}
    assert got == {0: "hi", 1: " �"}


def test_probabilities_scores_and_conll(spark):
    """SNK5, SNK6, SNK7, JN8."""
    df = spark.createDataFrame([(1, "a\tb", 0.5, [1.0, -2.5]), (0, "c", 1.0, [])], "doc_id long, text string, prob double, vec array<double>")
    path = out()
    writers.write_probs_vectors(df, path)
    assert read(path) == b"c\t1.0\t\na b\t0.5\t1.0 -2.5\n"
    pairs = spark.createDataFrame([(1, 0, 97, "O", "B-x"), (0, 1, 98, "I-x", "O"), (0, 0, 99, "B-x", "B-x")], "doc_id long, pos int, byte int, gold string, pred string")
    path = out()
    writers.write_conll(pairs, path)
    assert read(path) == b"99 B-x B-x\n98 I-x O\n\n97 O B-x\n\n"
    back = formats.read_conll(spark, path).collect()
    assert sorted((r.gold, r.pred) for r in back) == [(["B-x", "I-x"], ["B-x", "O"]), (["O"], ["B-x"])]
    path = out()
    for run, value in (("a", 1), ("b", 2), ("a", 3)):
        writers.write_scores(spark.createDataFrame([(value,)], "f1 int"), path, run)
    assert sorted((r.run_id, r.f1) for r in spark.read.parquet(path).collect()) == [("a", 3), ("b", 2)]


# ------------------------------------------------------------------ small operators

def test_tag_scores_passages_and_unions(spark):
    """PRJ14, AGG4, SET1, SRC2."""
    df = spark.createDataFrame([([[0.1, 0.9], [0.4, 0.6]],)], "s array<array<double>>")
    got = df.select(an.tag_scores("s", ["O", "B"]).alias("t")).first().t
    assert [[tuple(x) for x in p] for p in got] == [[("O", 0.1), ("B", 0.9)], [("O", 0.4), ("B", 0.6)]]
    p = spark.createDataFrame([("d", 0, "first"), ("d", 2, "last"), ("e", 1, "only"), ("d", 1, "mid")], "doc_key string, passage_idx int, text string")
    assert sorted((r.doc_key, r.text) for r in corpus.pick_passages(p).collect()) == [("d", "last"), ("e", "only")]
    assert corpus.pick_passages(p, "all").count() == 4
    folder = tempfile.mkdtemp(prefix="bs-")
    for name, lines in (("x.src", "a\nb\n"), ("y.src", "c\nd\ne\n")):
        with open(os.path.join(folder, name), "w") as f:
            f.write(lines)
    docs = formats.read_src(spark, folder, with_file=True)
    sp = docs.filter("doc_id = 1").select("file", "doc_id", F.lit(0).alias("start"))
    other = spark.createDataFrame([(0, bytearray(b"z"))], "doc_id long, body binary")
    d, s = corpus.union_corpora({"two": (other, other.select("doc_id", F.lit(0).alias("start"))), "one": (docs, sp)})
    rows = sorted((r.doc_id, r.corpus, os.path.basename(r.file), r.source_id, bytes(r.body)) for r in d.collect())
    assert rows == [(0, "one", "x.src", 0, b"a"), (1, "one", "x.src", 1, b"b"), (2, "one", "y.src", 0, b"c"), (3, "one", "y.src", 1, b"d"), (4, "one", "y.src", 2, b"e"), (5, "two", "", 0, b"z")]
    assert sorted((r.doc_id, r.source_id) for r in s.collect()) == [(1, 1), (3, 1), (5, 0)]


def test_embedding_chain(spark):
    """JN6: mid-word by itself, final with the end mark first, else unknown bytes."""
    df = spark.createDataFrame([(1, 0, ["th", "e"]), (1, 1, ["th"]), (2, 0, ["é", "x"])], "doc_id long, i int, pieces array<string>")
    emb = spark.createDataFrame([("th", 1), ("e</w>", 2), ("e", 3), ("x", 4), ("<UNKNOWN>", 9)], "token string, id int")
    got = bpe.embedding_ids(bpe.pieces_rows(df), emb).collect()
    assert sorted((r.doc_id, r.i, r.idx, r.emb_id, r.unknown) for r in got) == [(1, 0, 0, 1, 0), (1, 0, 1, 2, 0), (1, 1, 0, 1, 0), (2, 0, 0, 9, 2), (2, 0, 1, 4, 0)]


def test_rare_words_and_singletons(spark):
    """FN9, AGG15, WIN12."""
    rows = wd.words(spark.createDataFrame([(1, "a b a"), (2, "c"), (3, "")], "doc_id long, text string"))
    one = wd.singletons(rows)
    assert sorted(r.word for r in one.collect()) == ["b", "c"]
    ids = rows.filter("len > 0").withColumn("emb_id", F.lit(7))
    for p, want in ((1.0, {"a": 7, "b": 0, "c": 0}), (0.0, {"a": 7, "b": 7, "c": 7})):
        assert {r.word: r.emb_id for r in fe.replace_rare(ids, one, p).collect()} == want


def test_token_pattern(spark):
    """FN15 with another class of word bytes."""
    df = spark.createDataFrame([("ab-c d_1",)], "text string")
    tok = lambda **k: [tuple(x) for x in fe.with_tokens(df, **k).first().tokens]
    assert tok() == [(0, 2), (2, 1), (3, 1), (5, 1), (6, 1), (7, 1)]
    assert tok(pattern="[A-Za-z0-9_-]") == [(0, 4), (5, 3)]


# ------------------------------------------------------------------ linear folds

def test_conflict_rules_of_a_hundred_thousand_spans(spark):
    import time

    n = 100_000
    df = spark.range(1).select(F.expr(f"transform(sequence(0, {n - 1}), i -> named_struct('start', int(i * 3), 'len', int(4 + i % 2), 'type', 'x'))").alias("spans"), F.lit(3 * n + 9).alias("n"))
    begin = time.time()
    for rule in ("rightmost", "leftmost"):
        got = spans.resolve(df, conflict=rule).select(F.size("resolved").alias("k"), F.expr("forall(sequence(1, size(resolved) - 1), i -> resolved[i - 1].start + resolved[i - 1].len <= resolved[i].start)").alias("ok")).first()
        assert got.k == n // 2 and got.ok
    assert time.time() - begin < 60


def test_sentences_of_a_long_text(spark):
    n = 100_000
    df = spark.range(1).select(F.lit(1).alias("doc_id"), F.encode(F.repeat(F.lit("ab c. "), n), "UTF-8").alias("body"))
    got = sentences.split_sentences(df).agg(F.count(F.lit(1)), F.max("start"), F.sum("len")).first()
    assert tuple(got) == (1, 0, 6 * n - 1)
    df = spark.range(1).select(F.lit(1).alias("doc_id"), F.encode(F.repeat(F.lit("Ab c. "), n), "UTF-8").alias("body"))
    got = sentences.split_sentences(df).agg(F.count(F.lit(1)), F.max("start"), F.sum("len")).first()
    assert tuple(got) == (n, 6 * (n - 1), 5 * n)


# ------------------------------------------------------------------ validation

def test_violations(spark):
    docs = spark.createDataFrame([(1, bytearray(b"abcdef")), (2, bytearray(b"a\x00b")), (3, bytearray(b""))], "doc_id long, body binary")
    sp = spark.createDataFrame([(1, 0, 0, 2, "x"), (1, 1, 1, 2, "x"), (1, 2, 4, 5, "y"), (1, 3, 3, 0, "x"), (1, 4, -1, 1, "x"), (7, 0, 0, 1, "x"), (3, 0, 0, 0, "x")],
                               "doc_id long, ord int, start int, len int, type string")
    got = sorted((r.doc_id, -1 if r.ord is None else r.ord, r.kind, r.at, r.detail) for r in quality.span_violations(docs, sp, ["x"]).collect())
    assert got == [(1, 1, "overlap", 1, "1"), (1, 2, "past_end", 4, "3"), (1, 2, "unknown_type", 4, "y"), (1, 3, "empty", 3, "0"), (1, 4, "negative_start", -1, "-1"),
                   (2, -1, "nul_byte", 1, ""), (3, 0, "empty", 0, "0"), (7, 0, "no_document", 0, "")]
    seqs = spark.createDataFrame([(1, ["I-x", "I-x", "O", "I-y", "B-x", "I-y"]), (2, [])], "doc_id long, tags array<string>").withColumn("runs", runs.from_tags("tags"))
    assert sorted((r.doc_id, r.at, r.detail) for r in quality.tag_violations(seqs).collect()) == [(1, 0, "I-x"), (1, 3, "I-y")]
    a, b = (spark.createDataFrame([(i, "l") for i in range(n)], "line_no long, line string") for n in (3, 5))
    assert sorted((r.doc_id, r.detail) for r in quality.line_violations(a, b).collect()) == [(3, "b"), (4, "b")]


# ------------------------------------------------------------------ the store of intermediates

def test_store_rebuilds_when_something_changes(spark):
    path, src = out(), out()
    spark.range(4).write.parquet(src)
    load = lambda f: spark.read.parquet(src).filter(f)
    builds = lambda: store.manifest(spark, path).count()
    first = store.materialize(load("id > 0"), path, {"w": 150})
    assert first.count() == 3 and builds() == 1
    assert store.materialize(load("id > 0"), path, {"w": 150}).count() == 3 and builds() == 1
    store.materialize(load("id > 0"), path, {"w": 75})        # another parameter
    assert builds() == 2
    assert store.materialize(load("id > 1"), path, {"w": 150}).count() == 2 and builds() == 3      # another plan
    spark.range(4, 6).write.mode("append").parquet(src)        # another input
    assert store.materialize(load("id > 0"), path, {"w": 150}).count() == 5 and builds() == 4
    old = {r.folder for r in store.manifest(spark, path).collect()}
    forced = store.materialize(load("id > 0"), path, {"w": 150}, rebuild=True)
    assert forced.count() == 5 and builds() == 5 and not set(forced.inputFiles()) & {f for o in old for f in spark.read.parquet(o).inputFiles()}
    key = store.fingerprint(load("id > 0"), {"w": 150})
    gone = store.discard(spark, path, [key])
    assert len(gone) == 4 and all(spark.read.parquet(g).count() == 0 for g in gone) and builds() == 1
    assert store.materialize(load("id > 0"), path, {"w": 150}).count() == 5 and builds() == 1


def test_store_with_two_writers(spark, monkeypatch):
    """A second writer that publishes while the first one writes: both read one build."""
    path, df = out(), spark.range(3).withColumn("r", F.lit(1))
    real, met = store._publish, []

    def publish(*args):
        if not met:
            met.append(1)
            met.append(store.materialize(df, path))
        real(*args)

    monkeypatch.setattr(store, "_publish", publish)
    mine = store.materialize(df, path)
    assert mine.inputFiles() == met[1].inputFiles() and mine.count() == 3 and store.manifest(spark, path).count() == 2


def test_a_broken_build_is_not_read(spark):
    path = out()
    bad = spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="no"):
        store.materialize(bad, path)
    assert store.manifest(spark, path).count() == 0


def test_iob_schemes_are_still_arrays_too(spark):
    """The array forms stay: they are what the readers use."""
    df = tg.with_spans(spark.createDataFrame([(["B-x", "I-x", "O"],)], "tags array<string>"))
    assert [tuple(s) for s in df.first().spans] == [(0, 2, "x")]

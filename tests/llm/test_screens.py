"""Screens of the near-duplicate search."""

import random
import tracemalloc
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from bytespan.llm import minhash, phrases, repeats


def _traits(spark, rows):
    sk = minhash.sketches(spark.createDataFrame(rows, "doc_id long, text string"))
    return sk.select(F.col("doc_id").alias("doc"), "n_shingles", "bins", "odd")


def test_odd_sketch_never_exceeds_the_difference_of_sets():
    rnd = np.random.default_rng(3)
    for size, other in ((5, 3), (150, 40), (900, 100), (4000, 1500)):
        u = rnd.integers(0, 2**63, size + 2 * other, dtype=np.uint64)
        a, b = np.sort(u[:size + other]), np.sort(u[other:])
        s = minhash.odd_sketch(np.r_[a, b], np.array([len(a), len(b)]))
        assert s.shape == (2, minhash.ODD // 64)
        apart = sum(bin(int(x) & (1 << 64) - 1).count("1") for x in s[0] ^ s[1])
        assert apart <= len(np.setxor1d(a, b))
        assert size > 1000 or apart > 0.7 * len(np.setxor1d(a, b))
    assert minhash.odd_sketch(np.zeros(0, np.uint64), np.array([0, 0])).tolist() == [[0] * (minhash.ODD // 64)] * 2


def test_distant_copies_in_one_bucket_make_few_pairs_and_no_link_is_lost(spark):
    """60 texts at similarities below the threshold for a link, which agree in most bins all the same, and five links among them."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(7))
    passage, texts = [word() for _ in range(220)], []
    for _ in range(60):
        texts.append([word() for _ in range(50)] + passage)
    for k in range(5):
        texts.append([word()] + texts[k][1:])
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    members = spark.createDataFrame([(b, i, i) for b in (7, 8) for i, _ in rows], "bucket long, doc long, comp long")
    got = {(r.a, r.b) for r in minhash._pairs(members, _traits(spark, rows)).collect()}
    assert {(k, 60 + k) for k in range(5)} <= got
    assert len(got) < 200       # of 2,080


def test_a_document_meets_its_traits_once(spark):
    members = spark.createDataFrame([(b, d, d % 2) for d in range(3) for b in range(20)], "bucket long, doc long, comp long")
    traits = spark.createDataFrame([(d, d * 10) for d in range(3)], "doc long, x long")
    own = minhash._described(members, traits)
    assert sorted(tuple(r) for r in own.select("bucket", "doc", "comp", "x").collect()) == sorted((b, d, d % 2, d * 10) for d in range(3) for b in range(20))


def test_shard_index_takes_few_bytes_a_word():
    rnd = np.random.default_rng(2)
    s = np.minimum(rnd.zipf(1.3, 1 << 18), 9000).astype(np.int32)
    s[rnd.random(len(s)) < 0.1] = 0
    tracemalloc.start()
    index = phrases.Index(phrases._joined(s), 2)
    ((words, n),) = index.phrases()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    pairs = Counter((a, b) for a, b in zip(s[:-1].tolist(), s[1:].tolist()) if a and b)
    assert {(a, b): c for (a, b), c in zip(words.tolist(), n.tolist())} == pairs
    assert peak < 52 * len(s)


def test_repeats_leave_one_table(spark):
    """Spent tables would count as disk until the session ends."""
    from pathlib import Path

    from bytespan.session import ensure_checkpoint_dir

    place = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    tables = lambda: {p for d in ("tables", "scratch") for p in place.glob(f"{d}/*")}
    rnd = random.Random(6)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(300))
    rows = [(1, text), (2, "x" + text[:200] + "yy"), (3, text), (4, "z" * 40 + text[100:260]), (5, None)]
    before = tables()
    got = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in got} == {1: 0, 2: 200, 3: 300, 4: 160, 5: 0}
    assert len(tables() - before) == 1


def test_transforms_and_their_merge_sort_few_rows(monkeypatch):
    """Snippets that share long passages: rows are ordered some ten times, not once for each of 50 symbols."""
    rnd, rows = random.Random(9), [0]
    text = lambda n: bytes(rnd.choice(b"abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    parts = []
    for _ in range(120):
        gram = text(24)
        parts += [text(rnd.randint(1, 26)) + gram + text(26) for _ in range(rnd.randint(2, 6))]
        parts.append(parts[-1][1:] + b"x")
    docs = np.array([rnd.randint(0, 99) for _ in parts])
    parts = [p if len(p) >= 50 else p + text(50 - len(p)) for p in parts]
    for name in ("sort", "argsort", "lexsort"):
        def counted(a, *args, _sort=getattr(np, name), **kw):
            rows[0] += len(a[0]) if isinstance(a, tuple) else len(a)
            return _sort(a, *args, **kw)
        monkeypatch.setattr(np, name, counted)
    got = repeats.least_documents(parts, docs)
    assert rows[0] < 15 * sum(len(p) + 1 for p in parts)
    best = {}
    for p, d in zip(parts, docs.tolist()):
        for k in range(len(p) - 49):
            best[p[k:k + 50]] = min(best.get(p[k:k + 50], 100), d)
    assert [g.tolist() for g in got] == [[best[p[k:k + 50]] for k in range(len(p) - 49)] for p in parts]


def test_merge_of_wide_alphabets_and_deep_repeats():
    """Few symbols fit into a sort key, and repeats are longer than what a round adds."""
    rnd = random.Random(10)
    every, base = bytes(range(256)), bytes(rnd.randrange(256) for _ in range(90))
    parts = [every, base, base[3:70] + b"z", base[5:], bytes(60), bytes(75), base, bytes(51) + base[:49], b"ab" * 40, b"ab" * 31]
    words = [bytes(p) for p in parts]
    made = [repeats.transform(np.array([*(c + 1 for c in w), 0]), np.full(len(w) + 1, len(w))) for w in words]
    for depth in (1, 2, 7, 50):
        rows, new, lcp = repeats.merge([b for _, b in made], [1] * len(words), depth)
        begin = np.cumsum([0, *(len(w) + 1 for w in words)])
        at = [(int(k), int(made[k][0][r - begin[k]])) for r in rows for k in [np.searchsorted(begin, r, "right") - 1]]
        tail = lambda x: (*(c + 1 for c in words[x[0]][x[1]:]), x[0] - 99)  # noqa: E731, B023
        cut = [tail(x)[:depth] for x in at]
        assert cut == sorted(cut)
        common = [next((j for j, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y))) for x, y in zip(cut[:-1], cut[1:])]
        assert lcp.tolist() == [0] + [n if n < depth else -1 for n in common]
        assert new.tolist() == [True] + [n < depth for n in common]


def test_members_of_open_buckets_meet_their_component_by_document(spark, monkeypatch):
    """Texts that share many open buckets: a join by document has a row a document, not one a bucket in every round."""
    from pyspark.sql.classic.dataframe import DataFrame

    monkeypatch.setattr(minhash, "SMALL", 5)
    rnd, left, join = random.Random(12), [], DataFrame.join
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(7))
    passage = [word() for _ in range(130)]
    texts = [[word() for _ in range(45)] + passage for _ in range(20)]
    texts += [[word(), *t[1:]] for t in texts[:6]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]

    def counted(self, other, on=None, how=None):
        if isinstance(on, str) and on == "doc" and how == "left":
            left.append(self.count())
        return join(self, other, on, how)

    monkeypatch.setattr(DataFrame, "join", counted)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i % 20 for i in range(26)}
    assert left and max(left) <= len(rows) and sum(left) <= 6 * len(rows)

"""Tokens, packing, near duplicates, repeats: brute force and edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bytespan.llm import minhash, packing, repeats, textarrays, tokens
from bytespan.llm.common import anti, semi

LONG = "lorem ipsum dolor " * 9000


def frame(spark, rows):
    """documents with columns whose names operators also use inside."""
    return spark.createDataFrame([(i, t, "en", "s", 1, 7, "x") for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, n long, k string").repartition(3)


@pytest.fixture(scope="module")
def lib():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary_path(tokens.VOCAB))


ODD = ["", None, " ", "\n\t", "aaaaaaa", "x<|endoftext|>y <|startoftext|>", "Σίσυφος ΣΑΣ", "½ ²³ ªº", "don't WE'LL ''s", "éÅ É×÷ß.", "日本語 テスト",
       "\x85\xa0a b\x00", "<|ENDOFTEXT|>", LONG, "a" * 5000, "1234 5.6,7"]


def test_token_counts(spark, lib):
    rnd = random.Random(1)
    some = ["".join(rnd.choice(["a", "b", "'", "s", "é", "É", "1", " ", "\n", "Σ", "<|endoftext|>", "_", "-", "的", "!"]) for _ in range(rnd.randint(1, 30)))
            for _ in range(300)]
    rows = list(enumerate(ODD + some)) + [(0, "again"), (None, "no id")]
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(frame(spark, rows)).collect()))
    n = [len(x.ids) for x in lib.encode_batch([t or "" for _, t in rows], add_special_tokens=False)]
    assert got == sorted((i is None, i or 0, len((t or "").encode()), k, k > 2048) for (i, t), k in zip(rows, n))


def test_token_counts_of_an_empty_table(spark):
    assert tokens.token_counts(frame(spark, [(1, "a")]).filter("false")).count() == 0


def test_slices_cover_rows_of_any_length():
    offsets = np.array([0, 0, 5, 5, 100, 101, 101])
    assert list(textarrays.slices(offsets, 10)) == [(0, 3), (3, 4), (4, 6)]


def test_packing_is_a_partition_into_full_sequences(spark, lib):
    rnd = random.Random(2)
    rows = list(enumerate([*ODD, *(" ".join(["word"] * rnd.randint(0, 1500)) for _ in range(80))])) + [(3, "same id"), (3, "same id")]
    got = packing.packed(frame(spark, rows)).toPandas()
    ids = [x.ids + [0] for x in lib.encode_batch([t or "" for _, t in rows], add_special_tokens=False)]
    want = sorted((i, p, s, len(x[s:s + 2048]), zlib.crc32(np.array(x[s:s + 2048], "<u4").tobytes()))
                  for (i, _), x in zip(rows, ids) for p, s in enumerate(range(0, len(x), 2048)))
    assert sorted(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all()
    assert got.groupby("sequence_id").length.sum().max() <= 2048
    assert packing.packed(frame(spark, [(1, "a")]).filter("false")).count() == 0


def test_local_search_empties_a_bin_that_best_fit_leaves():
    sizes = [5, 4, 4, 3, 2, 2]           # two bins of 10 hold them all
    bins = [[0, 3], [1, 2], [4, 5]]
    out = packing.local_search(sizes, bins, 10)
    assert len(out) == 2 and sorted(i for b in out for i in b) == list(range(6))
    rnd = random.Random(3)
    for _ in range(50):
        sizes = [rnd.randint(1, 60) for _ in range(rnd.randint(0, 40))]
        out = packing.pack(sizes, 100)
        assert sorted(i for b in out for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= 100 for b in out)
        assert len(out) <= len(packing.best_fit(sizes, 100))


def _sets(rows):
    out = []
    for i, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = [x for x in __import__("re").split("[ \t-\r]+", w) if x]
        out.append((i, {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    return out


def _components(rows):
    sets, comp = _sets(rows), {i: i for i, _ in rows if i is not None}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x
    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if None not in (i, j) and s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = sorted((root(i), root(j)))
                comp[y] = x
    return sorted((i is None, i or 0, len(s), None if i is None else root(i), i is None or root(i) == i) for i, s in sets)


def test_near_duplicates(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcde") for _ in range(6))
    rows, n = [], 0
    for _ in range(12):                   # groups around a base, in chains, and unlike texts with a shared passage
        base = [word() for _ in range(rnd.choice([3, 5, 8, 60, 200]))]
        for _ in range(rnd.randint(1, 9)):
            own = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 60))):
                own[rnd.randrange(len(own))] = word()
            rows.append((n := n + 1, " ".join(own)))
            if rnd.random() < 0.3:
                base = own
    passage = [word() for _ in range(60)]
    rows += [(n + k, " ".join([word() for _ in range(25)] + passage)) for k in range(1, 25)]
    rows += [(900, None), (901, ""), (902, " \n"), (903, "two words"), (904, "Two  WORDS"), (905, LONG), (906, LONG), (None, "two words"), (907, rows[0][1]), (907, rows[-9][1])]
    rnd.shuffle(rows)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, rows)).collect())
    assert got == _components(rows)
    kept = minhash.without_copies(frame(spark, rows))
    assert kept.columns == frame(spark, rows[:1]).columns
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == sorted({i for i, *_ in [(x[1],) for x in got if x[4] and not x[0]]})
    assert kept.filter("doc_id is null").count() == 1


@pytest.mark.parametrize("small", [2, 5])
def test_pairs_hidden_in_large_open_buckets(spark, monkeypatch, small):
    """Texts that share most of a passage without being near copies, and near copies
    among them: buckets stay open and are dealt anew."""
    monkeypatch.setattr(minhash, "SMALL", small)
    rnd = random.Random(small)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(7))
    passage, rows = [word() for _ in range(70)], []
    for _ in range(18):
        own = [word() for _ in range(35)] + passage
        rows.append((len(rows), " ".join(own)))
        if rnd.random() < 0.5:
            at = rnd.randrange(30)
            rows.append((len(rows), " ".join(own[:at] + [word()] + own[at + 1:])))
    assert 3 < sum(x[4] for x in _components(rows)) < len(rows)
    got = minhash.near_duplicates(frame(spark, rows)).collect()
    assert sorted((False, r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == _components(rows)


def test_near_duplicates_of_an_empty_table(spark):
    assert minhash.near_duplicates(frame(spark, [(1, "a")]).filter("false")).count() == 0


def test_sketch_agrees_as_often_as_sets_do():
    rnd = np.random.default_rng(5)
    for size in (4, 40, 900):
        same = []
        for _ in range(60):
            u = rnd.integers(0, 2**63, size, dtype=np.uint64)
            a, b = np.sort(u), np.sort(u[: int(size * 0.75)])
            s = minhash.sketch(np.r_[a, b], np.array([len(a), len(b)]))
            same.append((s[0] == s[1]).mean())
        assert abs(np.mean(same) - 0.75) < 0.04


def _removed(rows, size=50):
    first, out = {}, []
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for k in range(len(b) - size + 1):
                first[b[k:k + size]] = min(first.get(b[k:k + size], i), i)
    for i, t in rows:
        b = (t or "").encode()
        m = np.zeros(len(b) + size, bool)
        for k in range(len(b) - size + 1):
            if i is not None and first[b[k:k + size]] < i:
                m[k:k + size] = True
        m = m[:len(b)]
        rest = np.frombuffer(b, np.uint8)[~m].tobytes()
        out.append((i is None, i or 0, len(b), int(m.sum()), int((m & ~np.r_[False, m[:-1]][:len(m)]).sum()), hashlib.sha256(rest).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [3, 20_000])
def test_repeated_strings(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    rnd = random.Random(6)
    text = lambda a, n: "".join(rnd.choice(a) for _ in range(n))
    base = text("abcdé ", 130)
    rows = [(i, text("xyz", rnd.randint(0, 60)) + base[rnd.randint(0, 20):rnd.randint(60, 130)] + text("xyz", 20)) for i in range(60)]
    rows += [(500, None), (501, ""), (502, base * 3), (7, base), (7, base), (None, base), (503, "a" * 400), (504, "a" * 90), (505, base[:49]), (506, "\x00" + base[:50])]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.without_repeats(frame(spark, rows)).collect())
    assert got == _removed(rows)


def test_long_texts_are_cut_into_overlapping_parts(monkeypatch):
    rnd = random.Random(7)
    texts = ["".join(rnd.choice("abcd") for _ in range(n)) for n in (0, 49, 50, 900, 130)]
    data, offsets = textarrays.text_buffer(pa.array(texts))
    strings = lambda: {(int(r), data[s + k:s + k + 50].tobytes(), int(g)) for r, s, e, g in zip(*repeats.snippets(data, offsets)) for k in range(e - s - 49)}
    whole = strings()
    assert {(r, b) for r, b, _ in whole} == {(r, t[k:k + 50].encode()) for r, t in enumerate(texts) for k in range(len(t) - 49)}
    monkeypatch.setattr(repeats, "PIECE", 64)
    assert strings() == whole


def test_merged_transforms_give_least_documents():
    rnd = random.Random(8)
    for _ in range(60):
        size = rnd.choice([3, 5, 8])
        parts = [bytes(rnd.choice(b"ab\x00\xff") for _ in range(rnd.randint(size, size + 25))) for _ in range(rnd.randint(1, 9))]
        docs = np.array([rnd.randint(0, 9) for _ in parts])
        best = {}
        for p, d in zip(parts, docs):
            for k in range(len(p) - size + 1):
                best[p[k:k + size]] = min(best.get(p[k:k + size], 99), d)
        got = repeats.least_documents(parts, docs, size, shards=rnd.randint(1, 5))
        assert [g.tolist() for g in got] == [[best[p[k:k + size]] for k in range(len(p) - size + 1)] for p in parts]


def test_common_prefixes_of_the_merge():
    words = [b"banana", b"bandana", b"anas"]
    sym = [np.array([*(c + 1 for c in w), 0]) for w in words]
    made = [repeats.transform(s, np.full(len(s), len(s) - 1)) for s in sym]
    shard, _, lcp = repeats.interleave([b for _, b in made], [1, 1, 1], 50)
    own = sorted((w[k:].decode(), n) for n, w in enumerate(words) for k in range(len(w) + 1))
    assert [n for _, n in own[3:]] == shard[3:].tolist()     # the closings come first, in order
    prefix = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert lcp[4:].tolist() == [prefix(a[0], b[0]) for a, b in zip(own[3:], own[4:])]


def test_semi_and_anti_against_plain_joins(spark):
    rows = frame(spark, [(i, "t") for i in range(500)] + [(None, "t"), (3, "t")])
    ids = spark.range(0, 1000, 7).select(F.col("id").alias("doc_id"))
    assert sorted(r.doc_id for r in semi(rows, ids, "doc_id").collect()) == list(range(0, 500, 7))
    out = [r.doc_id for r in anti(rows, ids, "doc_id").collect()]
    assert out.count(None) == 1 and sorted(x for x in out if x is not None) == sorted([i for i in range(500) if i % 7] + [3])
    assert anti(rows, ids, "doc_id").columns == rows.columns


@pytest.mark.parametrize("words", range(7))
def test_near_duplicates_of_a_table_of_few_words(spark, words):
    text = " ".join("abcdefg"[:words])
    got = minhash.near_duplicates(spark.createDataFrame([(4, text)], "doc_id long, text string")).collect()
    assert [tuple(r) for r in got] == [(4, int(words > 0) + max(0, words - 5), 4, True)]

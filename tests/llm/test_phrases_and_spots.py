"""Operators 11 and 12 from their definitions, and edge cases."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from bytespan.llm import phrases, spotsigs

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows, parts=3):
    """documents with columns whose names operators also use inside."""
    return spark.createDataFrame([(i, t, lang, 1, "x", 2, "y", 3) for i, t, lang in rows],
                                 "doc_id long, text string, lang string, n long, word string, block int, key string, a int").repartition(parts)


# --- operator 11

def spots(text):
    words = [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.lower()) if w]
    content = [i for i, w in enumerate(words) if w not in spotsigs.ANCHORS]
    out = set()
    for i, w in [(-1, "^"), *((i, w) for i, w in enumerate(words) if w in spotsigs.ANCHORS)]:
        chain = [words[j] for j in content if j > i][:spotsigs.CHAIN]
        if chain:
            out.add(hashlib.md5(" ".join([w, *chain]).encode()).hexdigest()[:spotsigs.DIGITS])
    return sorted(out)


def jaccard(a, b):
    return len({*a} & {*b}) / len({*a} | {*b}) if a or b else 1.0


def edited(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    texts = [r[1] or "" for r in rows]
    out = []
    for (i, *_), t, nxt in zip(rows, texts, texts[1:] + texts[:1]):
        k = len(t) // 4
        e = t[:len(t) - k] + nxt[:k]
        a, b, c = spots(t), spots(e), spots(nxt)
        out.append((str(i), len(t), hashlib.sha256(e.encode()).hexdigest(), " ".join(a), " ".join(b), round(jaccard(a, b), 9), round(jaccard(a, c), 9)))
    return sorted(out)


WORDS = ["the", "of", "a", "der", "le", "cat", "sat", "élan", "Zug", "x1", "...", "it", "is", "mat", "The", "日本"]
ODD = [None, "", " ", "...", "the", "the of", "cat", "the cat", "cat the", "The cat. The CAT", "a\nb\x00c", "日本 the 日本語 of", "wörter und noch the mehr wörter", "🙂 the 🙂🙂 cat sat"]


@pytest.mark.parametrize("parts", [1, 5])
def test_fingerprints_and_edits(spark, parts):
    rnd = random.Random(parts)
    rows = [(i * 7 - 30, t, "en") for i, t in enumerate(ODD)]
    rows += [(1000 + i, " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 60))), None) for i in range(150)]
    rows += [(5, "again the cat", "en"), (5, "again", "en"), (5, None, "en"), (None, "no the id", "en"), (None, "another the id", "en")]
    got = [(str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9))
           for r in spotsigs.edits(frame(spark, rows, parts)).collect()]
    assert sorted(got) == edited(rows)


def test_edits_of_tiny_tables_and_long_texts(spark):
    assert spotsigs.edits(frame(spark, [(1, "a", "en")]).filter("false")).count() == 0
    for rows in ([(7, "one the two three", "en")], [(2, "the cat " * 40_000, "en"), (1, "x", "en")], [(3, None, "en"), (3, None, "en")]):
        got = sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint) for r in spotsigs.edits(frame(spark, rows)).collect())
        assert got == [x[:4] for x in edited(rows)]


def test_edits_stay_in_the_jvm(spark):
    plan = spotsigs.edits(frame(spark, [(1, "a", "en")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("percent,bucket", [(75, 1000), (50, 3), (100, 1000)])
def test_links_lose_no_pair(spark, monkeypatch, percent, bucket):
    monkeypatch.setattr(spotsigs, "BUCKET", bucket)
    rnd = random.Random(percent)
    rows = []
    for i in range(25):
        base = [rnd.choice(WORDS) for _ in range(rnd.randint(1, 40))]
        for k in range(4):
            t = [w if rnd.random() > 0.03 * k else rnd.choice(WORDS) for w in base]
            rows.append((len(rows), " ".join(t), "en"))
    rows += [(900, rows[3][1], "en"), (901, "", "en"), (902, None, "en"), (903, "...", "en"), (None, rows[3][1], "en"), (3, rows[3][1], "en")]
    pairs, members = spotsigs.links(frame(spark, rows), percent)
    sets = {}
    for i, t, _ in rows:
        s = tuple(spots(t or ""))
        if i is not None and s:
            sets.setdefault(s, set()).add(i)
    assert sorted(map(tuple, members.collect())) == sorted((i, min(ids)) for ids in sets.values() for i in ids)
    names = sorted((min(ids), s) for s, ids in sets.items())
    want = [(x, y, len({*s} & {*t}), len({*s} | {*t})) for k, (x, s) in enumerate(names) for y, t in names[k + 1:] if 100 * len({*s} & {*t}) >= percent * len({*s} | {*t})]
    assert sorted(map(tuple, pairs.collect())) == want


# --- operator 12

def grams(words, longest):
    return Counter(tuple(words[i:i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))


def mined(rows, least, top):
    f = {}
    for _, t, lang in rows:
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (t or "").translate(LOW)):
            f.setdefault("und" if lang is None else lang, Counter()).update(grams([w for w in re.split(r"[ \t]+", piece) if w], 4))
    out = []
    for lang, c in f.items():
        n = sum(v for k, v in c.items() if len(k) == 1)
        cand = {k: v for k, v in c.items() if len(k) > 1 and v >= least}
        rows = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            s, _, l, r = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))  # noqa: E741
            rows.append((-s, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def corpus(seed):
    rnd = random.Random(seed)
    words = ["to", "be", "or", "not", "That", "is", "é", "Ünd", "x", "x"]
    texts = [" ".join(rnd.choice(words) + rnd.choice(["", "", "", ".", ", ", "\t", "\n"]) for _ in range(rnd.randint(0, 50))) for _ in range(80)]
    rows = [(i, t, rnd.choice(["en", "en", "de", None])) for i, t in enumerate(texts)]
    return rows + [(1, None, "en"), (None, "to be or not to be to be", "en"), (3, "", ""), (4, "...", "fr"), (5, "to be to be to be to be to be", "en")] * 3


@pytest.mark.parametrize("shard,parts", [(1 << 21, 1), (40, 4), (300, 2)])
def test_collocations(spark, monkeypatch, shard, parts):
    monkeypatch.setattr(phrases, "SHARD", shard)
    rows = corpus(shard)
    got = sorted(map(tuple, phrases.collocations(frame(spark, rows, parts), top=50, least=4).collect()))
    assert got == mined(rows, 4, 50)
    assert any(len(r[2].split()) == 4 for r in got) and any(len(r[2].split()) == 3 for r in got)


def test_collocations_of_nothing(spark):
    assert phrases.collocations(frame(spark, [(1, "a b", "en")]).filter("false")).count() == 0
    assert phrases.collocations(frame(spark, [(1, "a b c", "en"), (2, None, None)])).count() == 0


def test_scores_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(7 * 10**13 + 1, 9 * 10**13, 7 * 10**13 + 5), (5, 6, 7)], "a long, l long, r long")
    got = [r.s for r in rows.select(phrases._score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()]
    assert got == [2_000_000 * (7 * 10**13 + 1) // (16 * 10**13 + 5), 2_000_000 * 5 // 13]


def test_index_extends_to_both_sides():
    rnd = np.random.default_rng(3)
    s = rnd.integers(0, 4, 400)
    index = phrases.Index(s, 4)
    runs = [r for r in "".join(map(str, s)).split("0") if r]
    count = lambda p: sum(r.startswith(p, i) for r in runs for i in range(len(r)))
    for order in ((True, True, True), (False, False, False), (True, False, True), (False, True, True)):
        at = index.words()
        for left in order:
            at = index.extended(*at, left=left)
            names = ["".join(map(str, p)) for p in at[0].tolist()]
            assert len(set(names)) == len(names) and at[3].tolist() == [count(p) for p in names]
            assert sum(at[3]) == sum(max(0, len(r) - len(names[0]) + 1) for r in runs)

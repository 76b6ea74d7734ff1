"""Operator 13 against both tokenizers on whole texts."""

import hashlib
import random
from collections import Counter, defaultdict
from itertools import accumulate

import pytest

from bytespan.llm import align, tokens

COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokens.vocabulary_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=tokens.vocabulary_path(align.B))


def brute(texts, tools):
    """Measures of each text, from the definition."""
    ta, tb = tools
    back = {s: bytes([x]) for x, s in tokens.byte_symbols().items()}
    name = {i: t for t, i in ta.get_vocab().items()}
    found = []
    for t in texts:
        a, b = ta.encode(" " + t, add_special_tokens=False).ids if t else [], tb.encode(t) if t else []
        xa = [b"".join(back[c] for c in name[i]) for i in a]
        xb = [bytes([int(p[3:5], 16)]) if tb.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [tb.id_to_piece(i)]]
        if not t or b"".join(xa) != (" " + t).encode() or b"".join(xb) != (" " + t).encode():
            found.append(None)
            continue
        ea = list(accumulate(map(len, xa)))
        eb = list(accumulate(map(len, xb)))
        both = sorted(set(ea) & set(eb))
        groups, links, lo = [], [], 0
        for at in both:
            groups.append(",".join(str(i) for i, e in zip(a, ea) if lo < e <= at) + "|" + ",".join(str(i) for i, e in zip(b, eb) if lo < e <= at))
            links.append((a[ea.index(at)], b[eb.index(at)]))
            lo = at
        found.append((a, b, groups, links))
    count = Counter(x for f in found if f for x in f[3])
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [(0, 0, 0, 0, 0, 0, "") if f is None else
            (len(f[0]), len(f[1]), len(f[2]), len(f[3]), sum(count[x] == best[x[1]] for x in f[3]), sum(count[x] for x in f[3]),
             hashlib.sha256(";".join(f[2]).encode()).hexdigest()) for f in found]


ODD = ["", None, " ", "  ", "a", " a ", "a  b", "a  b 　c", "x <s> </s> <unk> <|endoftext|> y", "▁ low ▁", "日本語 テスト ２", "é é", "don't  we'll\n\n x\t y ",
       "\x85 a", "\x00 b\x1c c", "a’ b   c", "ﬁ ́x", "word " * 3000, "\r\n a;\r b", "🙂 🙂🙂 x"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y", 2) for i, t in rows], "doc_id long, text string, n long, key string, part string, a int").repartition(3)


def check(spark, rows, tools):
    got = sorted((str(r.doc_id), *[r[c] for c in COLUMNS]) for r in align.aligned(frame(spark, rows)).collect())
    want = sorted((str(i), *x) for (i, _), x in zip(rows, brute([t or "" for _, t in rows], tools)))
    assert [x for x in zip(got, want) if x[0][:5] + x[0][7:] != x[1][:5] + x[1][7:]] == []
    assert got == want


def test_odd_texts_copies_and_clashing_columns(spark, tools):
    rnd = random.Random(5)
    some = ["".join(rnd.choice(["a", "the", "é", " ", " ", "  ", "\n", "1", "'s", "的", ".", " ", "’"]) for _ in range(rnd.randint(1, 25))) for _ in range(200)]
    rows = list(enumerate(ODD + some)) + [(0, "again and again")] * 5 + [(None, "no id"), (None, "no id")]
    check(spark, rows, tools)


def test_many_small_shards_give_the_same(spark, tools, monkeypatch):
    monkeypatch.setattr(align, "SHARD", 40)
    monkeypatch.setattr(align, "BATCH", 3)
    check(spark, [(i, t) for i, t in enumerate(["the cat sat on the mat", "the dog sat", "a cat, a dog.", "", "the cat sat on the mat"] * 4)], tools)


def test_documents_of_the_table(spark, tools):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if len(r.text) < 6000]
    check(spark, rows, tools)


def test_empty_table(spark):
    assert align.aligned(frame(spark, [(1, "a")]).filter("false")).count() == 0
    assert align.aligned(frame(spark, [(1, None)])).collect()[0].groups_sha256 == ""


def test_scratch_tables_go(spark):
    out = align.aligned(frame(spark, [(1, "some words")]))
    out.collect()
    names = [x.namespace for x in spark.sql("show databases").collect() if x.namespace.startswith("bytespan_scratch")]
    before = sum(spark.sql(f"show tables in {n}").count() for n in names)
    align.aligned(frame(spark, [(1, "some words")])).collect()
    assert sum(spark.sql(f"show tables in {n}").count() for n in names) == before + 1   # the one that the result reads

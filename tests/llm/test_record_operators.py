"""Toxicity, personal data, decontamination, licences, chat, top-k, pipeline."""

import math
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

import corpus_pipeline
from bytespan.llm import chat, decontaminate, licenses, pii, queries, topk, toxicity
from bytespan.llm.textarrays import LOWER, SPACE, bounds, text_buffer

from .test_text_operators import LONG, frame

WORDS = "than and onesen erblest it hein ti inenan eranenes whou therouou thon the heoron".split()


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def bigrams():
    text = ("you idiot and moron the scum of a worthless clown with trash is stupid in this pathetic loser "
            "that were here for it to be on and in an as at by or not so we he she is if " * 50).encode()
    code = toxicity._CLASS[np.frombuffer(text, np.uint8)]
    return toxicity.bigram_model(np.bincount(code[:-1] * 28 + code[1:], minlength=784).reshape(28, 28))


def test_lattices_are_read_back(bigrams):
    got = toxicity.decode([b"1d10t", b"i d i o t", b"m.o.r.o.n", b"m0r0n", b"$cum", b"tr@sh", b"st-up-id", b"idiooooot", b""], bigrams)
    assert got == [b"idiot", b"idiot", b"moron", b"moron", b"scum", b"trash", b"stupid", b"idiot", b""]


def test_viterbi_against_all_paths(bigrams):
    """The search finds the best of all readings of a short lattice."""
    import itertools

    for word in (b"1s", b"0n3", b"a-b", b"@t"):
        best = (-math.inf, [])
        for path in itertools.product(range(29), repeat=len(word)):
            score, state, out = 0.0, 0, []
            for b, c in zip(word, path):
                if c == 28:
                    score += toxicity._SKIP[b]
                else:
                    score += bigrams[state, c] + toxicity._EMIT[b, c]
                    state = c
                    out.append(c)
            best = max(best, (score + bigrams[state, 0], out))
        assert toxicity.decode([word], bigrams)[0].decode() == "".join(" abcdefghijklmnopqrstuvwxyz?"[c] for c in best[1]).strip(), word


def test_only_disguised_spans_are_searched():
    text = "plain Words, 12 and 1d10t!! then M.O.R.O.N s t u p i d aaa end."
    data, offsets = text_buffer(pa.array([text]))
    low = LOWER[data]
    s, e, r = toxicity.disguised(low, *bounds(~SPACE[low], offsets))
    assert [low.tobytes()[a:b].decode() for a, b in zip(s, e)] == ["1d10t", "m.o.r.o.n", "aaa", "s t u p i d"]


def test_words_in_pieces_are_read(bigrams):
    """Spaced at the end of a clause, with several separators, or in chunks."""
    for text, word in [("that m o r o n.", b"moron"), ("what an i d i o t!", b"idiot"), ("an i  d  i \n o\t t", b"idiot"), ("a mo ron", b"moron"), ("you st up id, no", b"stupid"),
                       ("(i d i o t)", b"idiot"), ("\"mo\" - ron", b"moron"), ("so he is a m, o, r, o, n", b"moron"), ("st. up. 1d?", b"stupid"), ("a s t u p i d.", b"stupid")]:
        data, offsets = text_buffer(pa.array(["one", text, None, "x"]))
        words, at, row = toxicity.lattices(LOWER[data], offsets)
        read = toxicity.readings(words, bigrams)
        assert word in {read[i] for i in at}, (text, words, read)
        assert set(row.tolist()) == {1}
        slot = set(toxicity._slots(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[1].tolist())
        r, found = toxicity.features(data, offsets, bigrams)
        assert slot <= set(found[r == 1].tolist())
    assert toxicity.lattices(*text_buffer(pa.array([None, ""], pa.string())))[0] == []


def test_toxicity_held_out(spark):
    rnd = random.Random(1)
    rows, labels = [], []
    for i in range(900):
        bad = i % 8 == 0
        word = rnd.choice(["idiot", "moron", "1diot", "m0ron", "IDIOT,"]) if bad else ""
        rows.append((i, f"{prose(rnd, 20)} {word} {prose(rnd, 20)}"))
        labels.append((i, int(bad)))
    rows += [(5000, None), (5001, ""), (5002, LONG), (None, "you idiot"), (1, rows[1][1])]
    lab = spark.createDataFrame([(*x, 0.5) for x in labels] + [(None, 1, 0.1), (5001, None, 0.2)], "doc_id long, toxic int, score double")
    got = toxicity.score(frame(spark, rows), lab).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all()
    m = got[got.held_out].merge(pd.DataFrame(labels, columns=["doc_id", "toxic"]), on="doc_id")
    assert len(m) > 150 and (m.predicted == m.toxic).mean() > 0.98
    assert (got.predicted == (got.score >= 0.3)).all()
    left = toxicity.without_toxic(frame(spark, rows), lab)
    assert left.columns == frame(spark, rows[:1]).columns
    assert left.count() == int((got.predicted == 0).sum())
    none = toxicity.score(frame(spark, rows[:3]), lab.filter("false")).toPandas()
    assert none.score.max() < 0.01
    assert toxicity.score(frame(spark, rows[:3]).filter("false"), lab).count() == 0


PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute_spans(text):
    out = []
    for k, p in PATTERNS:
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m.group().split(".")),
                    "card": 16 <= len(d) <= 19 and pii.luhn(d), "phone": 8 <= len(d) <= 15}[k]:
                out.append((k, *m.span()))
    return out


def test_base_spans_against_the_patterns():
    rnd = random.Random(3)
    for _ in range(20000):
        t = "".join(rnd.choice("a.@-+1204 ()%x") for _ in range(rnd.randint(0, 40)))
        if rnd.random() < 0.3:
            t = re.sub("[ax]", lambda m: str(rnd.randint(0, 9)) * rnd.randint(1, 6), t)
        assert [(pii.KINDS[k], s, e) for k, s, e in pii.base_spans(t)] == brute_spans(t), t


def test_repeated_mentions_get_their_label(spark):
    rows = ["call +1 (632) 555-4827 now", "mail a.b@c.example.com or a.b [at] c.example.com", "nr 1234567 only", "é +44 20 7946 0999.", None, "",
            "1" * 50_000, "a" * 50_000 + "@", "card 4111 1111 1111 1111"]
    rows = list(enumerate(rows * 8)) + [(None, "x@y.zz"), (0, rows[0])]
    found = pii.entities(frame(spark, rows))
    texts = dict(rows)
    for r in pii.digest(found).collect():
        if r.doc_id is None:
            assert r.spans == "email:0:6"
            continue
        base = brute_spans(texts[r.doc_id] or "")
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == __import__("hashlib").sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))
        assert r.n_email + r.n_ip + r.n_card + r.n_phone == len(list(filter(None, r.spans.split(",")))) == len(base) + r.n_added
    assert {texts[r.doc_id][s.start:s.end] for r in found.collect() if r.doc_id is not None for s in r.added} == {"a.b [at] c.example.com"}
    masked = {r.doc_id: r for r in pii.redacted(frame(spark, rows)).collect()}
    assert masked[1].text == "mail [EMAIL] or [EMAIL]" and masked[1].n_chars == len(masked[1].text)
    assert masked[3].text == "é [PHONE]." and masked[4].text is None and masked[2].text == "nr 1234567 only"
    assert pii.redacted(frame(spark, rows).filter("false")).count() == 0


def test_messages_against_enumeration():
    """On a chain with one skip edge (no loop) beliefs are exact marginals."""
    import itertools

    rng = np.random.default_rng(1)
    field = pii.Field(rng.normal(size=(pii.WIDTH, 5)), rng.normal(size=(5, 5)), rng.normal(size=(5, 5)))
    feats, a, b, kind = [[1], [2, 3], [4]], np.array([0, 1]), np.array([1, 2]), np.array([0, 1])
    p = np.zeros((3, 5))
    for y in itertools.product(range(5), repeat=3):
        w = sum(field.unary[f, k] for fs, k in zip(feats, y) for f in fs) + sum(field.pair[t, y[i], y[j]] for i, j, t in zip(a, b, kind))
        for i, k in enumerate(y):
            p[i, k] += math.exp(w)
    got = field.beliefs(feats, np.full(3, -1), a, b, kind)
    assert np.allclose(got, p / p.sum(axis=1, keepdims=True), atol=0.02)


def test_evidence_reaches_every_repeat():
    """One address in base form and 50 disguised ones: all are added, whatever other documents lie in the batch."""
    field = pii.Field(np.zeros((pii.WIDTH, 5)), np.zeros((5, 5)), np.pad(pii.SKIP * (2 * np.eye(4) - 1), ((1, 0), (1, 0))))
    text = "mail a.b@c.example.com" + " or a.b [at] c.example.com" * 50
    other = "a.b [at] c.example.com " * 3
    for rows in ([text], [other, text, "", "one 1234567", other]):
        base, added = pii.find(field, rows)
        assert [len(x) for x in added] == [50 * (t == text) for t in rows] and [len(x) for x in base] == [t == text for t in rows]


def test_copies_do_not_fill_the_field_sample(spark):
    """Chain pairs come from all documents, long ones too; copies give unary candidates once."""
    copied = " ".join(f"call {1000000 + i}" for i in range(15))
    rows = [copied] * 300 + [f"mail a{i}@c.example.com or +44 20 7946 {1000 + i}" for i in range(200)] + [" ".join(f"x {5000000 + i}" for i in range(1200))]
    docs = frame(spark, list(enumerate(rows)))
    pairs = {r.pair: r.n for r in pii.counted(docs).filter("pair is not null").groupBy("pair").agg({"n": "sum"}).toDF("pair", "n").collect()}
    assert pairs == {0: 300 * 14 + 1199, 5 + 4: 200}
    got = pii.drawn(docs, 1.0).collect()
    assert len(got) == 15 + 400 + 1200 == len({(r.doc, r.place) for r in got})
    some = pii.drawn(docs, 0.2).collect()
    assert 230 < len(some) < 420 and {1, 4} <= {r.label for r in some}
    chain = np.ones((5, 5))
    chain[0, 0] += pairs[0]
    chain[1, 4] += 200
    assert np.allclose(pii.fit(docs, nodes=400).pair[0], pii._log_ratio(chain + chain.T))


def run_sql(name, **tables):
    con = duckdb.connect()
    for k, v in tables.items():
        con.register(k, pa.table(v) if isinstance(v, dict) else v.toArrow())
    return con.execute(queries.SQL[name]).df()


def same(spark_frame, sql_frame):
    cols = sorted(spark_frame.columns)
    assert cols == sorted(sql_frame.columns)
    rows = lambda f: sorted((tuple(None if pd.isna(x) else x for x in r) for r in f[cols].astype(object).itertuples(index=False, name=None)), key=repr)
    assert rows(spark_frame.toPandas()) == rows(sql_frame)


def test_decontamination(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(rnd.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rnd.randint(12, 70)))) for i in range(90)]
    items += [(200, None), (201, ""), (202, "three words here"), (203, "six words are here for you"), (204, items[0][1])]
    rows = [(i, " ".join(word() for _ in range(rnd.randint(0, 300)))) for i in range(60)]
    for i in range(0, 60, 2):
        n, t = rnd.choice(items[:90])
        w = t.split()
        if i % 3 == 0:     # a changed word, the question alone, the answer alone
            w = [w[:len(w) // 2], w[len(w) // 2:], [*w[:5], "zzz", *w[6:]]][i // 3 % 3]
        rows[i] = (i, f"{rows[i][1]} {' '.join(w).upper()}\n{rows[i][1]}")
    rows += [(100, None), (101, ""), (102, LONG[:9000]), (103, "x Three words HERE y six words are here for you"), (None, items[3][1]), (104, items[0][1]), (104, items[0][1])]
    bench = spark.createDataFrame([(i, t, 1.0) for i, t in items], "item_id long, text string, score double")
    docs = frame(spark, rows)
    got = decontaminate.contaminated(docs, bench)
    assert got.count() > 20
    same(got.select("doc_id", "item_id", "n_question", "question", "n_answer", "answer"), run_sql("op7_benchmark_decontamination", documents=docs, benchmark=bench))
    bad = {r.doc_id for r in got.collect()}
    assert sorted(r.doc_id for r in decontaminate.without_leaks(docs, bench).filter("doc_id is not null").collect()) == sorted(i for i, _ in rows if i is not None and i not in bad)
    assert decontaminate.contaminated(docs, bench.filter("false")).count() == 0
    assert decontaminate.contaminated(docs.filter("false"), bench).count() == 0
    assert decontaminate.without_leaks(docs, bench.filter("item_id = 201")).count() == len(rows)


def test_scattered_halves_in_several_index_parts(spark, monkeypatch):
    """Questions and answers far apart, with words missing, among items that share
    their words; every part of the index uses the statistics of all items."""
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(40)]
    items = [(7, " ".join(words))] + [(100 + i, " ".join(rnd.sample(words, 30) + [f"x{i}{k}" for k in range(10)])) for i in range(24)]
    filler = lambda n: " ".join(f"f{rnd.randint(0, 60)}" for _ in range(n))
    rows = [(12, f"{' '.join(words[:16])} {filler(400)} {' '.join(words[20:36])}"), (13, f"{' '.join(words[20:36])} {filler(30)} {' '.join(words[4:20])}"),
            (14, " ".join(words[:16])), (15, f"{' '.join(words[:15])} {filler(9)} {' '.join(words[20:40])}"), (16, filler(3000) + " " + items[3][1])]
    for i in range(60):       # runs of an item's words in any order, gaps between
        _, t = rnd.choice(items)
        w = t.split()
        cut = sorted(rnd.sample(range(1, 40), rnd.randint(1, 3)))
        parts = [w[a:b] for a, b in zip([0, *cut], [*cut, 40])]
        rnd.shuffle(parts)
        rows.append((200 + i, f" {filler(rnd.randint(0, 20))} ".join(" ".join(p) for p in parts)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, rows)
    scores = []
    for limit in (20_000, 4):
        monkeypatch.setattr(decontaminate, "ITEMS", limit)
        got = decontaminate.contaminated(docs, bench)
        found = got.select("doc_id", "item_id", "n_question", "question", "n_answer", "answer")
        assert (12, 7, 12, 16, 12, 16) in [tuple(r) for r in found.collect()]
        same(found, run_sql("op7_benchmark_decontamination", documents=docs, benchmark=bench))
        scores.append({(r.doc_id, r.item_id): round(r.score, 9) for r in got.collect()})
    assert scores[0] == scores[1] and len(decontaminate.indexes(bench)) > 3


def test_thresholds_lose_no_confirmed_item(monkeypatch):
    """Retrieval against a look at every item, scores against the formula."""
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice("abcdefgh") + str(rnd.randint(0, 4)) for _ in range(rnd.randint(1, 40))) for _ in range(150)]
    every = decontaminate.Statistics(texts)
    index = decontaminate.Index(list(range(150)), texts, every)
    docs = []
    for _ in range(80):
        w = rnd.choice(texts).split()
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = rnd.choice(["zz", *w])
        docs.append(" ".join(w + rnd.choice(texts).split()[:rnd.randint(0, 9)]))
    data, offsets = text_buffer(pa.array(docs))
    _, _, row, word = decontaminate.word_arrays(data, offsets)
    for cells in (1 << 22, 700):
        monkeypatch.setattr(decontaminate, "CELLS", cells)
        r, item, score = index.retrieve(row, word)
        got = {(a, b): s for a, b, s in zip(r.tolist(), item.tolist(), score.tolist())}
        halves = lambda w: (w[:-(-len(w) // 2)], w[-(-len(w) // 2):]) if len(w) >= 10 else (w, w)
        runs = lambda w, k: {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}
        units = [u for t in texts for u in halves(t.split())]
        mean = sum(map(len, units)) / len(units)
        need = 0
        for a, d in enumerate(docs):
            for b, t in enumerate(texts):
                k = min(5, len(t.split()))
                parts = [runs(u, k) for u in halves(t.split())]
                if all(100 * len(x & runs(d.split(), k)) >= 75 * len(x) for x in parts):
                    need += 1
                    x = 0.0
                    for u in halves(t.split()):
                        for w in set(u) & set(d.split()):
                            df, tf = sum(w in v for v in units), u.count(w)
                            x += math.log(1 + (len(units) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(u) / mean))
                    assert abs(got[a, b] - x) < 1e-6
        assert need > 50 and len(index.confirm(row, word, r, item)) == need


def test_licences(spark):
    rows = [(0, "Some text.\nReleased under the MIT License.\nmore"), (1, "LICENSED under the apache  license version 2.0\n\nx"), (2, None), (3, ""),
            (4, licenses.TEMPLATES["MIT"][1].replace(", ", ",\n")), (5, "Released under"), (6, "This work is licensed under the GNU General Public License, version 2."),
            (7, "a\n\nReleased under\nthe MIT License.\n\nb\nc"), (8, LONG), (8, "Released under the MIT License."), (None, "Released under the MIT License."),
            (9, "Licensed under CC BY-NC 4.0. And then many more words stand in this very line."), (10, "\n\n\n"), (11, "Licensed under CC BY-SA 4.0.\n" * 3)]
    docs = frame(spark, rows)
    got = licenses.license_units(docs)
    assert got.count() >= 9
    same(got, run_sql("op8_license_scan", documents=docs))
    assert licenses.license_units(docs.filter("false")).count() == 0
    assert licenses.license_units(docs, {"X": ["alpha beta gamma"]}).count() == 0


def test_chat(spark):
    rows = [(0, 0, "system", "Be kind."), (0, 1, "user", "hé"), (0, 2, "assistant", "ho"), (0, 3, "bob", None), (0, 3, "bob", None), (0, 300, "user", "late"),
            (1, 0, None, "who"), (1, None, "user", "null turn"), (None, 0, "user", "no id"), (2, 0, "system", "alone"), (3, 1, "user", ""), (3, 1, "ann", "tie")]
    rows += [(4, k, f"p{k % 3}", "t" * (k % 7)) for k in range(2000)]
    conv = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, segment string, n int").repartition(3)
    got = chat.perspectives(conv)
    same(got, run_sql("op9_chat_perspectives", conversations=conv.select("conv_id", "turn", "role", "text")))
    one = got.filter("conv_id = 0 and perspective = 'bob'").orderBy("start").collect()
    assert "".join(r.segment for r in one[:2]) == "<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>user name=user\nhé<|im_end|>\n"
    assert [r.target for r in one] == [r.speaker == "bob" for r in one]
    assert chat.perspectives(conv.filter("false")).count() == 0
    assert "Python" not in got._jdf.queryExecution().toString() and "InArrow" not in got._jdf.queryExecution().toString()


def test_top_k(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=40) / 6]) for i in range(1, 1500)]
    rows += [(1600, rows[0][1]), (1700, rows[0][1]), (1601, rows[0][1]), (1602, None), (1800, [math.nan] * 40), (1603, [None] * 40), (1604, [math.inf] * 40),
             (None, rows[0][1]), (1605, [1.0, 2.0]), (1900, [1.0, 1.0]), (2000, []), (1606, rows[5][1]), (1606, rows[5][1])]
    emb = spark.createDataFrame([(i, v, 3, 1.0) for i, v in rows], "vec_id long, embedding array<float>, label int, score double").repartition(5)
    got = topk.top_k(emb)
    same(got, run_sql("op10_exact_top_k", embeddings=emb.select("vec_id", "embedding")))
    assert topk.top_k(emb.filter("false")).count() == 0


def test_branch_and_bound_compacts_and_is_exact():
    rng = np.random.default_rng(7)
    values = rng.integers(-50, 50, size=(64, 3000))
    values[:, :20] *= 20
    ids, q = np.arange(3000), rng.integers(-50, 50, size=64)
    norms = [np.sqrt((values[d:].astype(float) ** 2).sum(axis=0)) for d in range(0, 64, topk.STEP)]
    i, s = topk.best(q, ids, values, norms, 7, 10)
    full = q @ values
    order = [k for k in np.lexsort((ids, -full)) if k != 7][:10]
    assert i.tolist() == order and s.tolist() == full[order].tolist()


def test_cells_of_the_grid_hold_one_batch(spark):
    """pairs of blobs are never rows of a join; a cell's queries meet its candidates batch by batch."""
    rng = np.random.default_rng(9)
    emb = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=20)]) for i in range(700)], "vec_id long, embedding array<float>")
    assert "Join" not in topk.top_k(emb)._jdf.queryExecution().executedPlan().toString()
    for scale in (50, 1 << 27):     # as doubles, and as integers beyond them
        q, v = rng.integers(-scale, scale, size=(40, 300)), rng.integers(-scale, scale, size=(40, 2000))
        v[:, 1000:1040], qids, ids = v[:, :40], np.arange(300) * 5, np.arange(2000)
        cell = topk._Cell(40, 10)
        cell.parts = [(qids[:100], q[:, :100]), (qids[100:], q[:, 100:])]
        for i in range(0, 2000, 400):
            cell.meet(ids[i:i + 400], v[:, i:i + 400])
        got = [x for b in cell.rows() for x in zip(*(b.column(c).to_pylist() for c in range(3)))]
        full, want = q.T @ v, []
        for n, own in enumerate(qids.tolist()):
            want += [(own, c, int(full[n, c])) for c in [c for c in np.lexsort((ids, -full[n])).tolist() if c != own][:10]]
        assert sorted(got) == sorted(want)


def test_pipeline_stages(spark, tmp_path):
    rnd = random.Random(8)
    bench = [(0, prose(rnd, 10) + " quite unlike anything else written in this small set of texts today")]
    rows = [(i, prose(rnd, rnd.randint(30, 90))) for i in range(300)]
    for i in range(0, 300, 10):
        rows[i] = (i, rows[i][1] + " idiot moron")
    rows[7] = (7, rows[6][1] + " end")
    rows[9] = (9, rows[9][1] + " " + bench[0][1])
    rows[11] = (11, rows[11][1] + " mail me@home.example.com")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = [i for i in range(300) if i % 10 and i not in (7, 9)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(kept) == want and kept[11].endswith(" mail [EMAIL]")
    name, stage = corpus_pipeline.STAGES[-1]
    assert sorted(r.doc_id for r in stage(spark, docs, str(tmp_path)).filter("piece = 0").collect()) == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]


def test_toxicity_does_not_depend_on_the_layout(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    pairs = np.zeros((28, 28))
    for r in docs.collect():
        code = toxicity._CLASS[np.frombuffer(r.text.encode(), np.uint8)]
        pairs += np.bincount(code[:-1].astype(int) * 28 + code[1:], minlength=784).reshape(28, 28)
    models = [toxicity.fit(docs.repartition(n), labels.repartition(n)) for n in (1, 3, 7, 64)]
    for n, m in zip((1, 3, 7, 64), models):
        assert (toxicity.letter_pairs(docs.repartition(n)) == pairs).all()
        assert m.chosen.tolist() == models[0].chosen.tolist() and len(m.chosen) > 100
        assert np.allclose(m.weights, models[0].weights, atol=1e-9) and abs(m.intercept - models[0].intercept) < 1e-9

"""CRF kernels against brute force; readers / writers round trips."""

import itertools
import os
import tempfile

import numpy as np

from bytespan.operators import crf
from bytespan.operators.bpe import encode_word


def _brute(x, U, bs, be):
    L, T = x.shape
    best, best_e, energies = None, -1e18, []
    for y in itertools.product(range(T), repeat=L):
        e = crf.path_energy_np(list(y), x, U, bs, be)
        energies.append(e)
        if e > best_e + 1e-12:
            best, best_e = list(y), e
    m = max(energies)
    return best, m + np.log(sum(np.exp(np.array(energies) - m)))


def test_viterbi_logz_bruteforce():
    rng = np.random.default_rng(0)
    for T in (2, 3):
        for L in range(1, 6):
            x = rng.normal(size=(L, T))
            U, bs, be = rng.normal(size=(T, T)), rng.normal(size=T), rng.normal(size=T)
            path, logz = _brute(x, U, bs, be)
            assert list(crf.viterbi_path(x, U, bs, be)) == path
            assert abs(crf.log_partition_np(x, U, bs, be) - logz) < 1e-9


def test_masked_viterbi():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(5, 3))
    U, bs, be = rng.normal(size=(3, 3)), rng.normal(size=3), rng.normal(size=3)
    p = crf.viterbi_path(x, U, bs, be, n=3)
    full3, _ = _brute(x[:3], U, bs, be)
    assert list(p[:3]) == full3 and list(p[3:]) == [-1, -1]


def test_viterbi_udf(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4, 3))
    U, bs, be = rng.normal(size=(3, 3)), rng.normal(size=3), rng.normal(size=3)
    df = spark.createDataFrame([(x.tolist(),)], "s array<array<double>>")
    got = crf.viterbi(df, "s", U, bs, be).collect()[0]["path"]
    assert got == _brute(x, U, bs, be)[0]


def test_bpe_encode():
    codes = {("l", "o"): 0, ("lo", "w</w>"): 1, ("e", "r</w>"): 2}
    assert encode_word("low", codes) == ["low"]
    assert encode_word("lower", codes) == ["lo", "w", "er"]


def test_src_tgt_round_trip(spark):
    from bytespan.sinks.writers import write_src_tgt
    from bytespan.sources.formats import read_src_tgt
    d = tempfile.mkdtemp(prefix="bs-")
    src, tgt = os.path.join(d, "a.src"), os.path.join(d, "a.tgt")
    with open(src, "wb") as f:
        f.write("wild‐type AUT2 x\nBob met Ann\n".encode())
    with open(tgt, "w") as f:
        f.write("S12 L4 gene\nS8 L3 name S0 L3 name\n")
    docs, spans = read_src_tgt(spark, src, tgt)
    got = sorted((r.doc_id, r.start, r.len, r.type) for r in spans.collect())
    assert got == [(0, 12, 4, "gene"), (1, 0, 3, "name"), (1, 8, 3, "name")]
    out = os.path.join(d, "out")
    write_src_tgt(docs, spans, out)
    lines = "".join(open(os.path.join(out, "tgt", p)).read() for p in sorted(os.listdir(os.path.join(out, "tgt")))
                    if p.startswith("part"))
    assert lines.split("\n")[:2] == ["S12 L4 gene", "S8 L3 name S0 L3 name"]


def test_byte_iob_reader(spark):
    from bytespan.sources.formats import read_byte_iob
    d = tempfile.mkdtemp(prefix="bs-")
    p = os.path.join(d, "x.iob")
    with open(p, "w") as f:
        f.write("A B-x\nb I-x\n<SPACE> O\nc B-y\n\nz O\nq B-x")
    rows = sorted(read_byte_iob(spark, p).collect(), key=lambda r: r.doc_id)
    assert rows[0].body == b"Ab c"
    assert [(s.start, s.len, s.type) for s in rows[0].spans] == [(0, 2, "x"), (3, 1, "y")]
    assert [(s.start, s.len, s.type) for s in rows[1].spans] == [(1, 1, "x")]   # last line flushed


def test_batched_kernels_match_single():
    rng = np.random.default_rng(5)
    X = rng.normal(size=(7, 6, 3))
    X[2, 3] = X[2, 3, 0]          # ties inside one row
    U, bs, be = rng.normal(size=(3, 3)), rng.normal(size=3), rng.normal(size=3)
    vb = crf.viterbi_batch(X, U, bs, be)
    lb = crf.logz_batch(X, U, bs, be)
    for k in range(7):
        assert list(vb[k]) == list(crf.viterbi_path(X[k], U, bs, be))
        assert abs(lb[k] - crf.log_partition_np(X[k], U, bs, be)) < 1e-9

"""Operator 4: personal data by a skip-chain conditional random field.

Base spans come from fixed patterns and are never given up.  Candidates are the
number-like and address-like stretches of a text; they are the nodes of a
random field over the labels none, email, ip, card, phone.  A node's potential
is a softmax model of its shape and of the word before it, trained on about
``NODES`` candidates at most, drawn by a hash from all documents (those alike in
all candidates count once), with features left out at random, so that weaker
shapes get weight too; a candidate without a base span that repeats one with a
base span is not shown as "none", since it is the field's to decide.  Neighbours in the text are joined by chain edges;
candidates that repeat, or share their last seven digits, are joined by skip
edges: two directly, three or more through one hub variable without a potential
of its own, so that evidence is two edges away however often a key repeats and
the number of edges is linear.  Chain potentials are log ratios of neighbouring labels, counted over all documents; a skip edge
has ``SKIP`` for equal and -``SKIP`` for different labels, and is neutral
towards "none".
Candidates that hold a base span are evidence.  Loopy message passing gives
beliefs: each document's messages are passed until none changes by ``TOLERANCE``
or more; only a document whose messages never settle ends after ``ROUNDS``
rounds and four more for each of its nodes.  A candidate that overlaps no base span and
is believed with ``BELIEF`` or more becomes an added span.

Defined results: null or empty text has no span; overlapping spans of several
kinds all stay; repeated rows and null ids are treated row by row.  Every
pattern is searched in time linear in the text.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT_ROWS, kept, map_arrow, map_batches, texts
from .textarrays import mix, slices, text_buffer

KINDS = ("email", "ip", "card", "phone")
BELIEF = 0.9
SKIP = 4.0
NODES = 100_000    # candidates that unary weights are fitted on, at most (a drawn number: about)
ROUNDS = 200
TOLERANCE = 1e-4
WIDTH = 160        # unary features

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"(?<![0-9])\+?\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,}")
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)) ?[A-Za-z0-9.-]{1,64}(?: ?(?:\[dot\]|\(dot\)) ?[A-Za-z0-9-]{1,64}){0,4}")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses; each @ looks back to the end of the last."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        nxt = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            floor = nxt = m.end()
        else:
            floor = at + 1
        at = text.find("@", nxt)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) in code points, by kind and start."""
    out = [(0, s, e) for s, e in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            out.append((3, *m.span()))
    return out


def _word_before(text: str, start: int) -> str:
    return text[max(0, start - 24):start].rstrip(" :=#\"'(").rpartition(" ")[2].lower()


def candidates(text: str) -> list[tuple[int, int, str, list[int]]]:
    """(start, end, skip key, features) in text order."""
    out = []
    for m in _NUMBER.finditer(text):
        s, e = m.span()
        w, d = m.group(), _NOT_DIGIT.sub("", m.group())
        f = [min(len(d), 24), 25 if w[0] == "+" else 26, 27 + ("(" in w), 29 + min(w.count("."), 4), 34 + min(w.count("-"), 4),
             39 + min(w.count(" "), 5), 45 + (16 <= len(d) <= 19 and luhn(d)), 47 + (s > 0 and text[s - 1].isalnum()),
             49 + (e < len(text) and text[e].isalnum()), 51 + int(d[0])]
        out.append((s, e, d[-7:], [*f, 64 + zlib.crc32(_word_before(text, s).encode("utf-8", "replace")) % 64]))
    if "@" in text:
        out += [(s, e, text[s:e].lower(), [61, 128 + zlib.crc32(_word_before(text, s).encode("utf-8", "replace")) % 32]) for s, e in emails(text)]
    if "at]" in text or "at)" in text:
        for m in _SPELLED.finditer(text):
            key = re.sub(r" ?[\[(]at[\])] ?", "@", re.sub(r" ?[\[(]dot[\])] ?", ".", m.group())).lower()
            out.append((*m.span(), key, [62, 128 + zlib.crc32(_word_before(text, m.start()).encode("utf-8", "replace")) % 32]))
    return sorted(out, key=lambda c: c[:2])


class Field:
    """Unary weights and edge potentials."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.pair = unary, np.stack([chain, skip])

    def beliefs(self, feats: list[list[int]], evidence: np.ndarray, a: np.ndarray, b: np.ndarray, kind: np.ndarray,
                doc: np.ndarray | None = None) -> np.ndarray:
        """Sum-product messages along edges (a, b) of a kind; evidence: label or
        -1; nodes beyond ``feats`` are hubs, always the b of their edges; doc:
        document number of each candidate, by default one for all."""
        n, k = len(feats), len(KINDS) + 1
        if not n:
            return np.zeros((0, k))
        nodes = max(n, int(b.max(initial=-1)) + 1)
        log = np.zeros((nodes, k))
        log[:n] = np.stack([self.unary[f].sum(axis=0) for f in feats])
        known = np.flatnonzero(evidence >= 0)
        log[known] = -50
        log[known, evidence[known]] = 0
        doc = np.zeros(n, np.int64) if doc is None else doc
        owner = np.r_[doc[a], doc[a]]
        bound = ROUNDS + 4 * (np.bincount(doc) + np.bincount(doc[a[b >= n]], minlength=doc.max() + 1))
        src, dst = np.r_[a, b], np.r_[b, a]
        psi = np.exp(np.concatenate([self.pair[kind], self.pair[kind].transpose(0, 2, 1)]))
        back = np.r_[np.arange(len(a)) + len(a), np.arange(len(a))]
        msg = np.zeros((len(src), k))
        add = lambda at, m: log + np.bincount((at[:, None] * k + np.arange(k)).ravel(), m.ravel(), minlength=nodes * k).reshape(nodes, k)
        live, place, t = np.arange(len(src)), np.empty(len(src), np.int64), 0
        while len(live):   # edges of documents that have not settled
            place[live] = np.arange(len(live))
            s, d, p, r, o = src[live], dst[live], psi[live], place[back[live]], owner[live]
            old, going = msg[live], True
            while going:
                t += 1
                out = add(d, old)[s] - old[r]
                new = np.log(np.einsum("ei,eij->ej", np.exp(out - out.max(axis=1, keepdims=True)), p))
                new = 0.5 * old + 0.5 * (new - np.logaddexp.reduce(new, axis=1, keepdims=True))
                moved = np.bincount(o, np.abs(new - old).max(axis=1) >= TOLERANCE, minlength=len(bound)) > 0
                old = new
                stay = (moved & (t < bound))[o]
                going = bool(stay.all())
            msg[live] = old
            live = live[stay]
        log = add(dst, msg)[:n]
        return np.exp(log - np.logaddexp.reduce(log, axis=1, keepdims=True))


def _graph(docs: list[list]) -> tuple[np.ndarray, ...]:
    """Edges of the candidates of several documents, numbered through: chain 0,
    skip 1; hubs are numbered after all candidates."""
    a, b, kind, n = [], [], [], 0
    hub = sum(map(len, docs))
    for nodes in docs:
        same: dict[str, list[int]] = {}
        for i, c in enumerate(nodes):
            if i:
                a.append(n + i - 1)
                b.append(n + i)
                kind.append(0)
            same.setdefault(c[2], []).append(n + i)
        for own in same.values():
            if len(own) == 2:
                a.append(own[0])
                b.append(own[1])
                kind.append(1)
            elif len(own) > 2:
                a += own
                b += [hub] * len(own)
                kind += [1] * len(own)
                hub += 1
        n += len(nodes)
    return np.array(a, np.int64), np.array(b, np.int64), np.array(kind, np.int64)


def _labels(nodes: list, base: list) -> list[int]:
    """Label of each candidate: the kind of a base span that it overlaps, else none (0)."""
    out, spans = [], sorted((s, e, k) for k, s, e in base)
    i = 0
    for s, e, *_ in nodes:
        while i < len(spans) and spans[i][1] <= s:
            i += 1
        hit = [k for x, y, k in spans[i:i + len(KINDS) + 1] if x < e and y > s]
        out.append(1 + hit[0] if hit else 0)
    return out


def _softmax(feats: list[list[int]], y: np.ndarray, steps: int = 200, drop: float = 0.5) -> np.ndarray:
    """Weights (features x labels) by scaled gradient steps on the mean loss."""
    k, rng = len(KINDS) + 1, np.random.default_rng(1)
    row, at = np.repeat(np.arange(len(feats)), [len(f) for f in feats]), np.concatenate(feats)
    w, m, v, one = np.zeros((WIDTH, k)), np.zeros((WIDTH, k)), np.zeros((WIDTH, k)), np.eye(k)[y]
    for t in range(1, steps + 1):
        keep = rng.random(len(at)) >= drop
        r, f = row[keep], at[keep]
        z = np.zeros((len(feats), k))
        np.add.at(z, r, w[f])
        p = np.exp(z - np.logaddexp.reduce(z, axis=1, keepdims=True)) - one
        g = np.zeros_like(w)
        np.add.at(g, f, p[r])
        g = g / len(feats) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-9)
    return w


def _rows(b: pa.RecordBatch) -> Iterator[tuple[int, str]]:
    """Rows that can hold a span: with a digit, an @ or a spelled one."""
    data, offsets = text_buffer(b.column("text"))
    for i, j in slices(offsets):
        part = data[offsets[i]:offsets[j]]
        near = np.flatnonzero((part - 48 < 10) | (part == 64) | (part == 91) | (part == 40))
        for r in np.unique(np.searchsorted(offsets[i:j + 1] - offsets[i], near, "right") - 1).tolist():
            yield i + r, data[offsets[i + r]:offsets[i + r + 1]].tobytes().decode("utf-8", "replace")


def _log_ratio(count: np.ndarray) -> np.ndarray:
    p = count / count.sum()
    q = p.sum(axis=1)
    return np.clip(np.log(p / (q[:, None] * q[None])), -3, 3)


def _content(nodes: list, labels: list[int]) -> int:
    """64-bit hash of a document's candidates (keys, features, labels)."""
    return int.from_bytes(hashlib.blake2b(repr([(x[2], x[3], y) for x, y in zip(nodes, labels)]).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def _shown(nodes: list, labels: list[int]) -> np.ndarray:
    """Candidates whose label is shown in training: not those without a base
    span that repeat one with a base span."""
    twin = {x[2] for x, y in zip(nodes, labels) if y}
    return np.array([bool(y) or x[2] not in twin for x, y in zip(nodes, labels)])


def counted(documents: DataFrame) -> DataFrame:
    """-> doc (hash of a document's candidates) and n (how many are shown); or
    pair (5 first label + second label) and n (how often it occurs), null doc."""
    k = len(KINDS) + 1

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        docs, n, pairs = [], [], np.zeros(k * k, np.int64)
        for _, text in _rows(b):
            if c := candidates(text):
                lab = _labels(c, base_spans(text))
                shown = _shown(c, lab)
                docs.append(_content(c, lab))
                n.append(int(shown.sum()))
                y = np.array(lab)
                both = shown[:-1] & shown[1:]
                pairs += np.bincount(y[:-1][both] * k + y[1:][both], minlength=k * k)
        at = np.flatnonzero(pairs).tolist()
        return pa.record_batch([pa.array(docs + [None] * len(at), pa.int64()), pa.array([None] * len(docs) + at, pa.int32()),
                                pa.array(n + pairs[at].tolist(), pa.int64())], names=["doc", "pair", "n"])

    return map_batches(texts(documents), run, "doc long, pair int, n long")


def drawn(documents: DataFrame, share: float) -> DataFrame:
    """-> doc, place, feats, label of a share of all shown candidates, by a hash
    of (doc, place); documents alike in all candidates count once."""
    least = int(share * (1 << 30))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        docs, place, feats, label = [], [], [], []
        for _, text in _rows(b):
            if c := candidates(text):
                lab = _labels(c, base_spans(text))
                d = _content(c, lab)
                h = mix(np.arange(len(c)).astype(np.uint64) + mix(np.array([d], np.int64).view(np.uint64)))
                for i in np.flatnonzero(_shown(c, lab) & ((h >> np.uint64(34)).astype(np.int64) < least)).tolist():
                    docs.append(d)
                    place.append(i)
                    feats.append(c[i][3])
                    label.append(lab[i])
        return pa.record_batch([pa.array(docs, pa.int64()), pa.array(place, pa.int64()), pa.array(feats, pa.list_(pa.int32())),
                                pa.array(label, pa.int32())], names=["doc", "place", "feats", "label"])

    rows = map_batches(texts(documents), run, "doc long, place long, feats array<int>, label int")
    return rows.groupBy("doc", "place").agg(F.min(F.struct("feats", "label")).alias("x")).select("doc", "place", "x.*")


def fit(documents: DataFrame, nodes: int = NODES) -> Field:
    """Chain potentials from the neighbours of all documents, unary weights from
    at most about ``nodes`` candidates."""
    k = len(KINDS) + 1
    seen = kept(counted(documents))
    chain = np.ones(k * k)
    for r in seen.filter("pair is not null").groupBy("pair").agg(F.sum("n").alias("n")).collect():   # at most 25
        chain[r["pair"]] += r["n"]
    chain = chain.reshape(k, k)
    n = seen.filter("doc is not null").groupBy("doc").agg(F.max("n").alias("n")).agg(F.sum("n")).first()[0] or 0
    # three standard deviations below the bound
    share = 1.0 if n <= nodes else max(0.0, nodes - 3 * nodes ** 0.5) / n
    got = sorted(drawn(documents, share).collect(), key=lambda r: (r["doc"], r["place"])) if n else []
    skip = np.zeros((k, k))
    skip[1:, 1:] = SKIP * (2 * np.eye(k - 1) - 1)
    pair = np.stack([_log_ratio(chain + chain.T), skip])
    unary = _softmax([r["feats"] for r in got], np.array([r["label"] for r in got])) if got else np.zeros((WIDTH, k))
    return Field(unary, pair[0], pair[1])


def find(field: Field, rows: list[str]) -> tuple[list[list[tuple[int, int, int]]], list[list[tuple[int, int, int]]]]:
    """Base and added spans of each text, by kind and start."""
    base, nodes = [base_spans(t) for t in rows], [candidates(t) for t in rows]
    flat = [c for d in nodes for c in d]
    known = np.array([x for d, b in zip(nodes, base) for x in _labels(d, b)], np.int64)
    p = field.beliefs([c[3] for c in flat], np.where(known > 0, known, -1), *_graph(nodes), np.repeat(np.arange(len(nodes)), [len(d) for d in nodes]))
    added: list[list[tuple[int, int, int]]] = []
    i = 0
    for d in nodes:
        new = []
        for c in d:
            label = int(p[i].argmax())
            if known[i] == 0 and label and p[i, label] >= BELIEF:
                new.append((label - 1, c[0], c[1]))
            i += 1
        added.append(sorted(new))
    return base, added


_SPAN = "array<struct<kind:string,start:long,end:long>>"


def _listed(spans: list) -> list[dict]:
    return [{"kind": KINDS[k], "start": s, "end": e} for k, s, e in spans]


def entities(documents: DataFrame) -> DataFrame:
    """-> doc_id, base, added (arrays of kind, start, end in code points)."""
    field = fit(documents)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        at = list(_rows(b))
        found = find(field, [t for _, t in at])
        out = []
        for spans in found:
            rows: list = [[]] * b.num_rows
            for (r, _), s in zip(at, spans):
                rows[r] = _listed(s)
            out.append(pa.array(rows, span))
        return pa.record_batch([b.column("doc_id"), *out], names=["doc_id", "base", "added"])

    return map_batches(texts(documents), run, f"doc_id long, base {_SPAN}, added {_SPAN}")


def digest(found: DataFrame) -> DataFrame:
    """The query's columns from ``entities``."""
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    every = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(
        order[s["kind"]].alias("o"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter("every", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    out = found.withColumn("every", every)
    return out.select("doc_id", *map(number, KINDS),
                      F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.col("every")).alias("spans"),
                      F.size("added").cast("long").alias("n_added"))


def redacted(documents: DataFrame) -> DataFrame:
    """``documents`` with every span replaced by its kind in brackets, all
    columns kept; ``n_chars``, where there, follows the new text."""
    field, schema = fit(documents), documents.schema

    def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
        out, end = [], 0
        for s, e, k in sorted((s, -e, k) for k, s, e in spans):
            if s >= end:
                out += [text[end:s], f"[{KINDS[k].upper()}]"]
            end = max(end, -e)
        return "".join([*out, text[end:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, TEXT_ROWS):
                b = whole.slice(i, TEXT_ROWS)
                at = list(_rows(b))
                base, added = find(field, [t for _, t in at])
                new = {r: mask(t, x + y) for (r, t), x, y in zip(at, base, added) if x or y}
                if new:
                    text = b.column("text").to_pylist()
                    for r, t in new.items():
                        text[r] = t
                    b = b.set_column(b.schema.get_field_index("text"), "text", pa.array(text, b.schema.field("text").type))
                    if "n_chars" in b.schema.names:
                        n = b.column("n_chars").to_pylist()
                        for r, t in new.items():
                            n[r] = len(t)
                        b = b.set_column(b.schema.get_field_index("n_chars"), "n_chars", pa.array(n, b.schema.field("n_chars").type))
                yield b

    return map_arrow(documents, run, schema)


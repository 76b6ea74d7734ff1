"""Operator 3: toxicity after noisy-channel deobfuscation.

A character bigram model is counted over every byte of every document.  Words
that may be disguised (signs or digits for letters, separators or spaces
between letters, letters repeated three times or more), and every group of
neighbouring short tokens (``PIECE`` letters at most, ``JOINED`` together),
whatever marks and white space lie between them, become character lattices: each byte is read as one of its letters, as a border, or as nothing,
at a channel cost, and a Viterbi search over the bigram model picks the
reading.  All disguised words of a batch are searched together.  Other words
have a lattice of one path; raw words stand beside the readings in any case.

A logistic model then scores raw and restored words and their prefixes.  It is
fitted on at most ``SAMPLE`` labelled rows that are not held out, drawn by a
hash of doc_id; features are those most enriched in toxic rows.  Labels, lang,
source and doc_id are no inputs of a score.

Defined results: null or empty text has the score of the intercept alone;
without toxic labels every score is near 0, without others near 1; of several labels of one doc_id the largest counts; repeated rows are scored
each; a null doc_id is scored and not held out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT_ROWS, kept, map_arrow, map_batches, texts
from .textarrays import LOWER, SPACE, bounds, mix, run_hashes, slices, text_buffer

SAMPLE = 40_000      # labelled rows that the model is fitted on, at most
FEATURES = 4096      # weights of the model, at most
SLOTS = 1 << 22      # hashed features before selection
THRESHOLD = 0.3
PREFIXES = (4, 5, 6)
PIECE, JOINED = 3, 12    # letters of a piece of a word in pieces, and of the whole, at most
KNOWN = 200_000          # readings that a worker remembers

#: Readings of signs as letters (fixed values of the channel).
READINGS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a",
            "$": "s", "!": "il", "|": "il", "+": "t", "(": "c"}
SEPARATORS = ".-_*~/\\'\" "
COST_LEET, COST_BORDER, COST_SEPARATOR, COST_REPEAT = -0.5, -7.0, -0.3, -0.7

N = 28               # border, a to z, any other letter
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = 27
_NOTHING = 28


def _channel() -> tuple[np.ndarray, np.ndarray]:
    """Log weight of each byte as each class, and as nothing."""
    emit, skip = np.full((256, N), -np.inf), np.full(256, -np.inf)
    for b in range(256):
        emit[b, _CLASS[b]] = 0 if _CLASS[b] else COST_BORDER
    for s, letters in READINGS.items():
        for c in letters:
            emit[ord(s), _CLASS[ord(c)]] = COST_LEET
    for s in SEPARATORS:
        skip[ord(s)] = COST_SEPARATOR
    return emit, skip


_EMIT, _SKIP = _channel()
_LEET = np.zeros(256, bool)
_LEET[[ord(c) for c in READINGS]] = True
_SEP = np.zeros(256, bool)
_SEP[[ord(c) for c in SEPARATORS]] = True
_ALPHA = _CLASS > 0
_CLOSING = np.zeros(256, bool)
_CLOSING[[ord(c) for c in "!|+(.,;:?"]] = True
_BEFORE, _AFTER = "([{<\"'*_~-.,;:", "!|+(.,;:?)]}>\"'*_~-"   # marks around a piece
_ALONE = "".join(c for c in dict.fromkeys(_BEFORE + _AFTER) if c not in READINGS)          # or between two
_GAP = re.compile(b"(?<=[^ ])[" + re.escape(_AFTER).encode() + b"]* +(?:[" + re.escape(_ALONE).encode() + b"]+ +)*[" + re.escape(_BEFORE).encode() + b"]*(?=[^ ])")


def letter_pairs(documents: DataFrame) -> np.ndarray:
    """Bigram counts (28 x 28) over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N * N, np.int64)
        for b in batches:
            data, offsets = text_buffer(b.column("text"))
            for i, j in slices(offsets):
                code = _CLASS[data[offsets[i]:offsets[j]]]
                inside = np.ones(len(code) + 1, bool)
                inside[offsets[i:j + 1] - offsets[i]] = False     # no pair reaches over two rows
                total += np.bincount((code[:-1] * N + code[1:])[inside[1:-1]], minlength=N * N)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["pair", "n"])

    rows = map_arrow(documents.select("text"), run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(N * N)
    for r in rows:   # at most 784
        out[r["pair"]] = r["n"]
    return out.reshape(N, N)


def bigram_model(pairs: np.ndarray) -> np.ndarray:
    p = pairs + 0.5
    return np.log(p / p.sum(axis=1, keepdims=True))


def decode(words: list[bytes], model: np.ndarray) -> list[bytes]:
    """Best reading of each word's lattice; borders come out as spaces."""
    out: list[bytes] = [b""] * len(words)
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    letters = np.frombuffer(b" abcdefghijklmnopqrstuvwxyz?", np.uint8)
    i = 0
    while i < len(order):   # words of like length together, a bounded number of cells
        length = len(words[order[i]])
        j = i + 1
        while j < len(order) and len(words[order[j]]) <= max(length, 8) * 1.3 and (j - i) * len(words[order[j]]) < 20_000:
            j += 1
        part, i = order[i:j], j
        size = max(1, max(len(words[k]) for k in part))
        grid = np.zeros((len(part), size), np.uint8)
        used = np.zeros((len(part), size), bool)
        for r, k in enumerate(part):
            grid[r, :len(words[k])] = np.frombuffer(words[k], np.uint8)
            used[r, :len(words[k])] = True
        score = np.full((len(part), N), -np.inf)
        score[:, 0] = 0
        back = np.empty((size, len(part), N), np.uint8)
        for p in range(size):
            reach = score[:, :, None] + model[None]
            best = reach.argmax(axis=1)
            b = grid[:, p]
            take = np.take_along_axis(reach, best[:, None, :], 1)[:, 0] + _EMIT[b]
            skip = _SKIP[b].copy()
            if p:   # the same letter once more
                skip[(b == grid[:, p - 1]) & _ALPHA[b]] = COST_REPEAT
            skip[~used[:, p]] = 0
            take[~used[:, p]] = -np.inf
            stay = score + skip[:, None]
            back[p] = np.where(stay > take, _NOTHING, best)
            score = np.maximum(stay, take)
        state = (score + model[:, 0]).argmax(axis=1)
        emitted = np.full((len(part), size), 255, np.uint8)
        for p in range(size - 1, -1, -1):
            was = back[p, np.arange(len(part)), state]
            made = was != _NOTHING
            emitted[made, p] = letters[state[made]]
            state = np.where(made, was, state)
        for r, k in enumerate(part):
            out[k] = emitted[r][emitted[r] != 255].tobytes().replace(b"?", b" ").strip()
    return out


def disguised(data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans whose lattice has more than one path: start, end, row.  ``data``
    is lower case; spans are words, or runs of three or more one-letter words,
    with or without marks around them."""
    n = len(data)
    alpha, leet, sep = _ALPHA[data], _LEET[data], _SEP[data]
    sign = np.zeros(n, np.int64)
    if n > 2:
        sign[:-1] = leet[:-1] & alpha[1:]                           # a sign before a letter
        sign[1:] |= leet[1:] & ~_CLOSING[data[1:]] & alpha[:-1]     # or after one
        sign[1:-1] |= sep[1:-1] & alpha[:-2] & (alpha[2:] | leet[2:])   # a separator between letters
        sign[2:] |= alpha[2:] & (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & (data[2:] < 128)
    total = np.r_[0, np.cumsum(sign)]
    letters = np.r_[0, np.cumsum(alpha)]
    odd = (total[end] > total[start]) & (letters[end] - letters[start] >= 2)
    end = end.copy()
    while (closing := odd & (end > start + 1) & _CLOSING[data[end - 1]]).any():   # marks that end a word
        end[closing] -= 1
    first, last, one, row_ = _pieces(data, start, end, row, 1)
    near = np.zeros(len(first), bool)
    near[1:] = one[1:] & one[:-1] & (row_[1:] == row_[:-1])
    head = np.flatnonzero(one & ~near)
    tail = np.flatnonzero(one & ~np.r_[near[1:], False][:len(one)])
    long = tail - head >= 2
    return (np.r_[start[odd], first[head[long]]], np.r_[end[odd], last[tail[long]]], np.r_[row[odd], row_[head[long]]])


def _marks(signs: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in signs]] = True
    return out


def _pieces(data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """Tokens without the marks around them (those of marks alone are left out):
    start, end, whether ``most`` letters or signs for letters at most and
    nothing else, and row."""
    before, after, alone = _marks(_BEFORE), _marks(_AFTER), np.r_[0, np.cumsum(_marks(_ALONE)[data])]
    some = alone[end] - alone[start] < end - start
    start, end, row = start[some], end[some], row[some]
    left, right = np.flatnonzero(~before[data]), np.flatnonzero(~after[data])
    last = np.r_[-1, right][np.searchsorted(right, end)] + 1
    end = np.where(last > start, last, np.minimum(end, start + 1))
    start = np.minimum(np.r_[left, len(data)][np.searchsorted(left, start)], end - 1)
    good = np.r_[0, np.cumsum(_ALPHA[data] | _LEET[data])]
    return start, end, (end - start <= most) & (good[end] - good[start] == end - start), row


def in_pieces(data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups of two or more neighbouring short tokens: start, end, row."""
    start, end, short, row = _pieces(data, start, end, row, PIECE)
    size = np.r_[0, np.cumsum(end - start)]
    letters = np.r_[0, np.cumsum(_ALPHA[data])]
    run = np.r_[0, np.cumsum(~short)]
    found, head = [], np.flatnonzero(short)
    for k in range(2, JOINED + 1):   # groups of k from heads whose group of k - 1 is whole
        head = head[head + k <= len(start)]
        head = head[(run[head + k] == run[head]) & (row[head + k - 1] == row[head]) & (size[head + k] - size[head] <= JOINED)]
        own = head[size[head + k] - size[head] >= min(PREFIXES)]
        s, e = start[own], end[own + k - 1]
        some = letters[e] - letters[s] >= 2
        found.append((s[some], e[some], row[own][some]))
    return tuple(np.concatenate(x) for x in zip(*found))


def lattices(low: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words to search, with one space where pieces meet; which of them each place holds; each place's row."""
    low = np.where(SPACE[low], np.uint8(32), low)
    words = bounds(low != 32, offsets)
    s, e, r = (np.concatenate(x) for x in zip(disguised(low, *words), in_pieces(low, *words)))
    raw, seen = low.tobytes(), {}
    at = [seen.setdefault(raw[a:b], len(seen)) for a, b in zip(s.tolist(), e.tolist())]
    return [_GAP.sub(b" ", w) for w in seen], np.array(at, np.int64), r


_READ: dict[bytes, bytes] = {}
_READ_BY = [b""]


def readings(words: list[bytes], model: np.ndarray) -> list[bytes]:
    """``decode`` with a bounded memory of this worker's earlier short words."""
    if _READ_BY[0] != (by := model.tobytes()) or len(_READ) > KNOWN:
        _READ.clear()
        _READ_BY[0] = by
    new = list({w for w in words if w not in _READ})
    found = dict(zip(new, decode(new, model)))
    out = [found[w] if w in found else _READ[w] for w in words]
    _READ.update((w, x) for w, x in found.items() if len(w) <= 64)
    return out


def _slots(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots of runs of letters: the word, and its prefixes; and which run each is of."""
    which, found = [np.arange(len(start))], [run_hashes(low, start, end)]
    for k in PREFIXES:
        more = np.flatnonzero(end - start > k)
        which.append(more)
        found.append(mix(run_hashes(low, start[more], start[more] + k) + np.uint64(k)))
    return np.concatenate(which), (np.concatenate(found) % np.uint64(SLOTS)).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of raw and restored words; not distinct."""
    low = LOWER[data]
    start, end, row = bounds(_ALPHA[low], offsets)
    which, slot = _slots(low, start, end)
    rows, slots = [row[which]], [slot]
    words, at, r = lattices(low, offsets)
    if words:
        restored = readings(words, model)
        buf = np.frombuffer(b"".join(restored), np.uint8)
        edge = np.r_[0, np.cumsum([len(x) for x in restored])]
        ws, we, token = bounds(_ALPHA[buf], edge)
        which, slot = _slots(buf, ws, we)
        token = token[which]
        # each place of a disguised word has the features of its reading
        order = np.argsort(token, kind="stable")
        token, slot = token[order], slot[order]
        first = np.searchsorted(token, np.arange(len(restored) + 1))
        n = (first[1:] - first[:-1])[at]
        place = np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        rows.append(np.repeat(r, n))
        slots.append(slot[place])
    return np.concatenate(rows), np.concatenate(slots)


def _distinct(row: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(row * SLOTS + slot)
    return key // SLOTS, key % SLOTS


def _sample(documents: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """text, toxic of at most about ``sample`` labelled rows that are not held out."""
    own = (labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
           .filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    n = own.count()
    if n > sample:   # half a standard deviation and more below the bound
        share = (sample - 3 * sample ** 0.5) / n
        own = own.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < int(share * (1 << 30)))
    # at most ``sample`` rows of 12 bytes: a proven bound
    return kept(texts(documents).join(F.broadcast(own), "doc_id").select("text", "toxic"))


class Model:
    """Character model, and weights by feature slot."""

    def __init__(self, pairs: np.ndarray, slots: np.ndarray, weights: np.ndarray, intercept: float):
        self.bigrams, self.chosen, self.weights, self.intercept = bigram_model(pairs), slots, weights, intercept
        self._at: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"_at": None}

    def found(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, chosen feature) of a batch."""
        if self._at is None:
            self._at = np.full(SLOTS, -1, np.int32)
            self._at[self.chosen] = np.arange(len(self.chosen))
        row, slot = features(data, offsets, self.bigrams)
        at = self._at[slot]
        key = np.unique(row[at >= 0] * SLOTS + at[at >= 0])
        return key // SLOTS, key % SLOTS

    def scores(self, column: pa.Array) -> np.ndarray:
        data, offsets = text_buffer(column)
        out = []
        for i, j in slices(offsets):
            row, at = self.found(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
            out.append(np.bincount(row, self.weights[at], minlength=j - i))
        return 1 / (1 + np.exp(-(np.concatenate([np.zeros(0), *out]) + self.intercept)))


def _logistic(row: np.ndarray, at: np.ndarray, y: np.ndarray, width: int, steps: int = 800) -> tuple[np.ndarray, float]:
    """Weights of a logistic model with a small ridge, by scaled gradient steps."""
    w, b, n = np.zeros(width), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), max(1, len(y))
    # Adam on the mean loss
    m, v, t = np.zeros(width + 1), np.zeros(width + 1), 0
    for t in range(1, steps + 1):
        z = np.bincount(row, w[at], minlength=len(y)) + b
        r = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        g = np.r_[np.bincount(at, r[row], minlength=width) / n + 1e-5 * w, r.mean()]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, width: int = FEATURES) -> Model:
    pairs = letter_pairs(documents)
    bigrams = bigram_model(pairs)
    rows = _sample(documents, labels, sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, SLOTS), np.int32)
        for b in batches:
            toxic = b.column("toxic").to_numpy(zero_copy_only=False) > 0
            data, offsets = text_buffer(b.column("text"))
            for i, j in slices(offsets):
                row, slot = _distinct(*features(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], bigrams))
                for y in (0, 1):
                    total[y] += np.bincount(slot[toxic[i:j][row] == y], minlength=SLOTS).astype(np.int32)
        at = np.flatnonzero(total.any(axis=0))   # a slot may be toxic in another task
        yield pa.record_batch([pa.array(at), pa.array(total[1, at].astype(np.int64)), pa.array(total[0, at].astype(np.int64))],
                              names=["slot", "n1", "n0"])

    n1, n0 = rows.agg(F.sum((F.col("toxic") > 0).cast("long")), F.sum((F.col("toxic") <= 0).cast("long"))).first()
    if not n1 or not n0:
        return Model(pairs, np.zeros(0, np.int64), np.zeros(0), -30.0 if not n1 else 30.0)
    counts = map_arrow(rows, count, "slot long, n1 long, n0 long").groupBy("slot").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    # the slots most enriched in toxic rows: at most ``width`` come to the driver
    odds = F.log((F.col("n1") + 0.5) / (F.lit(n1) + 1) / ((F.col("n0") + 0.5) / (F.lit(n0) + 1)))
    top = (counts.filter("n1 >= 3").withColumn("odds", odds).filter("odds > 1")
           .orderBy(F.desc(F.col("n1") * F.col("odds")), "slot").limit(width).select("slot").collect())
    chosen = np.array(sorted(r["slot"] for r in top), np.int64)
    model = Model(pairs, chosen, np.zeros(len(chosen)), 0.0)

    def found(b: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_buffer(b.column("text"))
        out = []
        for i, j in slices(offsets):
            row, at = model.found(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
            out += np.split(at.astype(np.int32), np.searchsorted(row, np.arange(1, j - i)))
        return pa.record_batch([pa.array(out, pa.list_(pa.int32())), b.column("toxic").cast(pa.int32())], names=["at", "toxic"])

    # at most ``sample`` rows of few numbers
    got = map_batches(rows, found, "at array<int>, toxic int").toPandas()
    size = got["at"].map(len).to_numpy()
    at = np.concatenate([np.zeros(0, np.int64), *got["at"]]).astype(np.int64)
    model.weights, model.intercept = _logistic(np.repeat(np.arange(len(got)), size), at, (got["toxic"].to_numpy() > 0).astype(float), len(chosen))
    return model


def score(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """-> doc_id, held_out, score, predicted."""
    model = fit(documents, labels)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([b.column("doc_id"), pa.array(model.scores(b.column("text")))], names=["doc_id", "score"])

    out = map_batches(texts(documents), run, "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def restored(documents: DataFrame) -> DataFrame:
    """-> doc_id, disguised, reading: every disguised span with its best reading."""
    model = bigram_model(letter_pairs(documents))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_buffer(b.column("text"))
        ids, was, now = [], [], []
        for i, j in slices(offsets):
            low = LOWER[data[offsets[i]:offsets[j]]]
            words, at, r = lattices(low, offsets[i:j + 1] - offsets[i])
            read = readings(words, model)
            ids += (r + i).tolist()
            was += [words[k].decode("utf-8", "replace") for k in at.tolist()]
            now += [read[k].decode() for k in at.tolist()]
        return pa.record_batch([b.column("doc_id").take(pa.array(ids, pa.int64())), pa.array(was, pa.string()), pa.array(now, pa.string())],
                               names=["doc_id", "disguised", "reading"])

    return map_batches(texts(documents), run, "doc_id long, disguised string, reading string")


def without_toxic(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``documents``, all columns, whose score is below the threshold."""
    model = fit(documents, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, TEXT_ROWS):
                part = b.slice(i, TEXT_ROWS)
                yield part.filter(pa.array(model.scores(part.column("text")) < threshold))

    return map_arrow(documents, run, documents.schema)

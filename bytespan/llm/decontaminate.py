"""Operator 7: benchmark decontamination by BM25 retrieval and overlap.

The question and the answer of every test item are units of a BM25 inverted
index whose units lie in blocks; the index keeps, for every term, its largest
impact in each block.  Every training text is a query.  As in block-max WAND a
text is dropped where the sum of its terms' largest impacts stays below the
least threshold, then each block by the block's own maxima, and only what is
left is scored; all items are retrieved whose question and answer both reach
their thresholds, none by rank.  A retrieved item is confirmed: at least
``PERCENT`` of the 5-word shingles of its question and of its answer occur in
the text.

The thresholds follow from that: with at most m shingles missing at most m
different words of a unit are missing, so the text has at least the unit's own
score less its m largest impacts.  Retrieval therefore loses nothing that the
confirmation would find, however far apart the words stand.

Items without separate columns have their first half of words as question, the
rest as answer; below ten words both are the whole item, and shingles are as long
as the item if it has fewer than five words.  Document frequencies and the mean
length are those of the whole benchmark.  The index goes to all tasks in parts of
at most ``ITEMS`` items; a larger benchmark takes several passes.

Defined results: null, empty or blank texts and items match nothing; an item
that appears twice matches under each of its rows' ids; repeated documents are
reported each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT_ROWS, map_arrow, map_batches, texts
from .textarrays import mix, slices, text_buffer, word_arrays

K1, B = 1.2, 0.75
PERCENT, WORDS = 75, 5
BLOCK = 32          # items of a block, two units each
ITEMS = 20_000      # items of one index
TABLE_BITS = 20
CELLS = 1 << 22     # scores of texts and units held together


def grams(word: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within a row, and the place of their first word."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = np.full(n, k, np.uint64)
        for j in range(k):
            h = mix(h * np.uint64(0x5851F42D4C957F2D) + word[j:j + n])
    at = np.flatnonzero(row[:n] == row[k - 1:k - 1 + n])
    return h[at], at


def _words(texts_: list[str]) -> list[np.ndarray]:
    """Word hashes of each text."""
    data, offsets = text_buffer(pa.array(texts_, pa.string()))
    _, _, row, word = word_arrays(data, offsets)
    return np.split(word, np.searchsorted(row, np.arange(1, len(texts_)))) if texts_ else []


def units(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Question and answer of an item's words."""
    half = -(-len(word) // 2)
    return (word[:half], word[half:]) if len(word) >= 2 * WORDS else (word, word)


class Statistics:
    """Of all units of a benchmark: document frequency of each term, number, mean length."""

    def __init__(self, texts_: list[str]):
        every = [u for w in _words(texts_) if len(w) for u in units(w)]
        self.n, self.mean = len(every), float(np.mean([len(u) for u in every])) if every else 1.0
        self.terms, self.df = np.unique(np.concatenate([np.zeros(0, np.uint64), *map(np.unique, every)]), return_counts=True)

    def idf(self, terms: np.ndarray) -> np.ndarray:
        df = self.df[np.searchsorted(self.terms, terms)] if len(terms) else np.zeros(0)
        return np.log(1 + (self.n - df + 0.5) / (df + 0.5))


class Index:
    """Inverted index of a part of the benchmark; item i has the units 2i and 2i + 1."""

    def __init__(self, ids: list[int], texts_: list[str], all_: Statistics):
        self.ids = np.array(ids, np.int64)
        item_words = _words(texts_)
        each = [u for w in item_words for u in units(w)]
        size = np.array([len(u) for u in each], np.int64)
        n, word = len(each), np.concatenate([np.zeros(0, np.uint64), *each])
        # postings: distinct (term, unit) with its frequency
        self.terms, term = np.unique(word, return_inverse=True)
        key, tf = np.unique(term * max(1, n) + np.repeat(np.arange(n), size), return_counts=True)
        t, unit = key // max(1, n), key % max(1, n)
        impact = all_.idf(self.terms)[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[unit] / all_.mean))
        self.first = np.searchsorted(t, np.arange(len(self.terms) + 1))
        self.unit, self.impact, self.units = unit, impact, n
        # shingles to confirm, and how much of a unit's own score a text must have
        self.parts, self.need = [], np.full(n, np.inf)
        own = np.split(impact[np.argsort(unit, kind="stable")], np.cumsum(np.bincount(unit, minlength=n))[:-1]) if n else []
        for i, w in enumerate(item_words):
            k = min(WORDS, len(w))
            shingles = [np.unique(grams(u, np.zeros(len(u)), k)[0]) if k else np.zeros(0, np.uint64) for u in units(w)]
            self.parts.append((k, *shingles))
            for j, x in enumerate(shingles):
                if len(x):
                    missing = len(x) - -(-PERCENT * len(x) // 100)
                    scores = np.sort(own[2 * i + j])
                    self.need[2 * i + j] = scores[:len(scores) - missing].sum()
        self.blocks = -(-n // (2 * BLOCK))
        self.best = np.zeros(len(self.terms))
        np.maximum.at(self.best, t, impact)
        # largest impact of a term in a block, as postings of blocks
        bkey, at = np.unique(t * max(1, self.blocks) + unit // (2 * BLOCK), return_inverse=True)
        self.block_of, bt = bkey % max(1, self.blocks), bkey // max(1, self.blocks)
        self.block_best = np.zeros(len(bkey))
        np.maximum.at(self.block_best, at, impact)
        self.block_first = np.searchsorted(bt, np.arange(len(self.terms) + 1))
        self.block_need = np.array([self.need[i:i + 2 * BLOCK].min() for i in range(0, n, 2 * BLOCK)] or [np.inf])
        self._table: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"_table": None}

    def term_of(self, word: np.ndarray) -> np.ndarray:
        """Number of each word's term, -1 for words of no item."""
        mask = np.uint64((1 << TABLE_BITS) - 1)
        if self._table is None:
            self._table = np.zeros(1 << TABLE_BITS, bool)
            self._table[(self.terms & mask).astype(np.int64)] = True
        out = np.full(len(word), -1, np.int64)
        near = np.flatnonzero(self._table[(word & mask).astype(np.int64)])
        at = np.searchsorted(self.terms, word[near])
        at[at == len(self.terms)] = 0
        same = self.terms[at] == word[near] if len(self.terms) else np.zeros(0, bool)
        out[near[same]] = at[same]
        return out

    @staticmethod
    def _spread(first: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Posting places of the terms t, and which t each is of."""
        n = first[t + 1] - first[t]
        of = np.repeat(np.arange(len(t)), n)
        return np.repeat(first[t] - (np.cumsum(n) - n), n) + np.arange(n.sum()), of

    def retrieve(self, row: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, score of both units) of all texts and items whose question and answer reach their thresholds."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        least = float(self.need.min(initial=np.inf)) * (1 - 1e-9)
        t = self.term_of(word) if np.isfinite(least) else np.full(len(word), -1)
        key = np.unique(row[t >= 0].astype(np.int64) * max(1, len(self.terms)) + t[t >= 0])
        rows, r = np.unique(key // max(1, len(self.terms)), return_inverse=True)
        tt = key % max(1, len(self.terms))
        fits = np.bincount(r, self.best[tt], minlength=len(rows)) >= least if len(rows) else np.zeros(0, bool)
        keep = np.cumsum(fits) - 1
        r, tt, rows = keep[r[fits[r]]], tt[fits[r]], rows[fits]
        step = max(1, CELLS // max(1, self.units))
        for i in range(0, len(rows), step):
            own = slice(*np.searchsorted(r, [i, i + step]).tolist())
            found.append(self._scored(rows[i:i + step], r[own] - i, tt[own]))
        return tuple(np.concatenate(x) for x in zip(*found))

    def _scored(self, rows: np.ndarray, r: np.ndarray, tt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # blocks whose own maxima reach their least threshold
        at, q = self._spread(self.block_first, tt)
        bound = np.bincount(r[q] * self.blocks + self.block_of[at], self.block_best[at], len(rows) * self.blocks)
        high = bound.reshape(len(rows), self.blocks) >= self.block_need * (1 - 1e-9)
        # exact scores within them
        at, q = self._spread(self.first, tt)
        own = high[r[q], self.unit[at] // (2 * BLOCK)]
        at, q = at[own], q[own]
        score = np.bincount(r[q] * self.units + self.unit[at], self.impact[at], len(rows) * self.units).reshape(len(rows), self.units)
        good = score >= self.need * (1 - 1e-9)
        text, item = np.nonzero(good[:, ::2] & good[:, 1::2])
        return rows[text], item, score[text, 2 * item] + score[text, 2 * item + 1]

    def confirm(self, row: np.ndarray, word: np.ndarray, found: np.ndarray, item: np.ndarray) -> list[tuple[int, ...]]:
        """(place in ``found``, first word of the first matched shingle, question
        shingles matched, all, answer shingles matched, all) of the confirmed pairs."""
        out = []
        first, last = np.searchsorted(row, found), np.searchsorted(row, found, "right")
        text: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for p, (r, i) in enumerate(zip(found.tolist(), item.tolist())):
            k, *parts = self.parts[i]
            if (r, k) not in text:
                own = word[first[p]:last[p]]
                text[r, k] = np.unique(grams(own, np.zeros(len(own)), k)[0], return_index=True)
            known, place = text[r, k]
            hits = [np.searchsorted(known, x) for x in parts]
            hits = [h[(h < len(known)) & (known[np.minimum(h, len(known) - 1)] == x)] if len(known) else h[:0] for h, x in zip(hits, parts)]
            if all(len(h) * 100 >= PERCENT * len(x) for h, x in zip(hits, parts)):
                out.append((p, int(place[np.concatenate(hits)].min()), *(n for h, x in zip(hits, parts) for n in (len(h), len(x)))))
        return out


def indexes(benchmark: DataFrame, limit: int | None = None) -> list[Index]:
    """The benchmark as indexes of at most about ``limit`` items each, under statistics of all its items."""
    items = benchmark.filter("item_id is not null and text is not null").select("item_id", "text").distinct()
    parts = -(-items.count() // (limit or ITEMS))
    rows = [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p).orderBy("item_id", "text").collect() for p in range(parts)]
    every = Statistics([r["text"] for part in rows for r in part])
    return [Index([r["item_id"] for r in part], [r["text"] for r in part], every) for part in rows if part]


_FOUND = "doc_id long, item_id long, passage long, score double, n_question long, question long, n_answer long, answer long"


def _leaks(index: Index, b: pa.RecordBatch) -> list[tuple]:
    """(row, item, first matched word, score, counts) of one batch."""
    data, offsets = text_buffer(b.column("text"))
    out = []
    for i, j in slices(offsets):
        _, _, row, word = word_arrays(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
        r, item, score = index.retrieve(row, word)
        for p, at, *n in index.confirm(row, word, r, item):
            out.append((i + int(r[p]), int(index.ids[item[p]]), at, float(score[p]), *n))
    return out


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """-> doc_id, item_id, the word where the first matched shingle begins, the
    BM25 score, and the matched and all shingles of question and answer."""
    out = None
    for index in indexes(benchmark):
        def run(b: pa.RecordBatch, index=index) -> pa.RecordBatch:
            found = _leaks(index, b)
            cols = list(zip(*found)) if found else [()] * 8
            arrays = [b.column("doc_id").take(pa.array(cols[0], pa.int64()))]
            kinds = [pa.int64(), pa.int64(), pa.float64()] + [pa.int64()] * 4
            arrays += [pa.array(c, k) for c, k in zip(cols[1:], kinds)]
            return pa.record_batch(arrays, names=[x.split()[0] for x in _FOUND.split(", ")])

        part = map_batches(texts(documents), run, _FOUND)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return documents.sparkSession.createDataFrame([], _FOUND)
    return out


def without_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents``, all columns, that hold no test item."""
    for index in indexes(benchmark):
        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(0, b.num_rows, TEXT_ROWS):
                    part = b.slice(i, TEXT_ROWS)
                    clean = np.ones(part.num_rows, bool)
                    clean[[x[0] for x in _leaks(index, part)]] = False
                    yield part.filter(pa.array(clean))

        documents = map_arrow(documents, run, documents.schema)
    return documents

"""Operator 1: token counts by rank-synchronous merging.

Texts are normalised and cut into pre-tokens as the vocabulary file says
(NFC, white space, lower case; letters, single digits, other runs).  Every
distinct pre-token that this worker has not met yet becomes a row of a ragged
numpy array of byte symbols; in each round every row finds its adjacent pair of
lowest rank and merges all its occurrences at once, rows without a mergeable
pair leave, and the surviving symbols are the tokens.

Defined results: null or empty text has no token; a text that holds a special
string counts it as one token, as the library does by default; a null doc_id
is kept; repeated rows give repeated results.  No shuffle; memory is bounded by
one slice of rows and a cache of ``CACHE`` chunks.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts
from .textarrays import LOWER, SPACE, bounds, run_hashes, slices, text_buffer

VOCAB = "word_bpe_49k.json"
LIMIT = 2048
CACHE = 2_000_000   # chunks a worker knows before it begins anew
CHUNK = 50_000    # pre-tokens merged together
SLOT_BITS = 19


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> dict[int, str]:
    """The byte alphabet of byte-level vocabularies: printable bytes stand for
    themselves, the others for the characters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class RankMerger:
    """Batched byte-pair merging over ragged arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, end = spec["model"], spec["model"]["end_of_word_suffix"] or ""
        vocab, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        sym = byte_symbols()
        self.inner = np.array([vocab[sym[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[sym[b] + end] for b in range(256)], np.int64)
        self.width = max(vocab.values()) + 1
        a, b = (np.array([vocab[m[i]] for m in merges], np.int64) for i in (0, 1))
        keys, to = a * self.width + b, np.array([vocab[x + y] for x, y in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.to = keys[order], order.astype(np.int32), to
        # rank table: a slot holds one pair; pairs whose slot was taken are found by bisection
        slot = self._slot(keys)
        self.slot_key, self.slot_rank = np.full(1 << SLOT_BITS, -1, np.int64), np.zeros(1 << SLOT_BITS, np.int32)
        self.slot_key[slot], self.slot_rank[slot] = keys, np.arange(len(keys))
        self.shared = np.zeros(1 << SLOT_BITS, bool)
        self.shared[slot[self.slot_key[slot] != keys]] = True

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, the number of merges where there is none."""
        key = left * self.width + right
        slot = self._slot(key)
        same = self.slot_key[slot] == key
        rank = np.where(same, self.slot_rank[slot], np.int32(len(self.keys)))
        again = np.flatnonzero(~same & self.shared[slot])
        if len(again):
            at = np.searchsorted(self.keys, key[again])
            at[at == len(self.keys)] = 0
            rank[again] = np.where(self.keys[at] == key[again], self.ranks[at], len(self.keys))
        return rank

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words behind one another, and tokens per word."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym, row = self.inner[raw], np.repeat(np.arange(len(words), dtype=np.int32), n)
        ends = np.cumsum(n) - 1
        sym[ends[n > 0]] = self.last[raw[ends[n > 0]]]
        none, done_sym, done_row = len(self.keys), [], []
        rank = np.full(len(sym), none, np.int32)   # of the pair that begins at a symbol
        inside = np.flatnonzero(row[:-1] == row[1:])
        rank[inside] = self._rank(sym[inside], sym[inside + 1])
        while len(sym):
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            low = np.minimum.reduceat(rank, first)
            size = np.diff(np.r_[first, len(row)])
            if low.max() == none:   # rows without a mergeable pair are finished
                live = np.repeat(low < none, size)
                done_sym.append(sym[~live])
                done_row.append(row[~live])
                sym, row, rank = sym[live], row[live], rank[live]
                size, low = size[low < none], low[low < none]
                if not len(sym):
                    break
            hit = rank == np.repeat(low, size)
            if (hit[1:] & hit[:-1]).any():   # runs of one pair (aaa): every second place from the left
                place = np.arange(len(hit))
                start = np.where(hit & ~np.r_[False, hit[:-1]], place, 0)
                hit &= (place - np.maximum.accumulate(start)) % 2 == 0
            sym[hit] = self.to[rank[hit]]
            stay = np.r_[True, ~hit[:-1]]
            merged = np.cumsum(stay)[hit] - 1
            sym, row, rank = sym[stay], row[stay], rank[stay]
            # only pairs that touch a merged symbol have a new rank
            left = merged[merged > 0] - 1
            for at in (merged[merged < len(sym) - 1], left):
                new = np.full(len(at), none, np.int32)
                own = row[at] == row[at + 1]
                new[own] = self._rank(sym[at[own]], sym[at[own] + 1])
                rank[at] = new
            if len(merged) and merged[-1] == len(sym) - 1:
                rank[-1] = none
        if not done_sym:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        sym, row = np.concatenate(done_sym), np.concatenate(done_row)
        order = np.argsort(row, kind="stable")
        return sym[order], np.bincount(row, minlength=len(words))


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)      # ASCII that is neither letter nor white space
_MARK[33:127] = True
_MARK &= ~_LETTER
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LEAD = 0xC3                     # lead byte of the letters from U+00C0 to U+00FF, two bytes of which are signs


class Encoder:
    """Ids of whole batches of texts through one ``RankMerger``.

    Texts are cut at white space and between letters and ASCII marks, where
    every pre-token ends too; a chunk is known by its 64-bit hash.  Chunks of
    letters or marks alone are pre-tokens and go to the merger as bytes; others
    are cut by the library's own normaliser and pattern."""

    def __init__(self, name: str):
        from tokenizers import Tokenizer

        path = vocabulary_path(name)
        self.merger, self.own = RankMerger(path), Tokenizer.from_file(path)
        added = {t.content: i for i, t in self.own.get_added_tokens_decoder().items()}
        self.special = {k: [v] for k, v in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, added)) + ")")
        self.bytes_of = {v: k for k, v in byte_symbols().items()}
        self.hash, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _odd(self, texts: list[str]) -> list[np.ndarray]:
        """Ids by the library's normaliser and pattern, special strings apart."""
        cut, normal, pre = [], self.own.normalizer.normalize_str, self.own.pre_tokenizer.pre_tokenize_str
        for t in texts:
            cut.append([])
            for part in self.cut.split(t):
                cut[-1] += [part] if part in self.special else [w for w, _ in pre(normal(part))]
        words = sorted({w for ws in cut for w in ws if w not in self.special})
        ids, n = self.merger.merge([bytes(self.bytes_of[c] for c in w) for w in words])
        of = self.special | dict(zip(words, np.split(ids, np.cumsum(n)[:-1])))
        return [np.concatenate([np.zeros(0, np.int64), *(of[w] for w in ws)]) for ws in cut]

    def _chunks(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        low, letter, mark = LOWER[data], _LETTER[data], _MARK[data]
        if (data == _LEAD).any():
            pair = np.flatnonzero(data[:-1] == _LEAD)
            pair = pair[(data[pair + 1] != 0x97) & (data[pair + 1] != 0xB7)]
            letter[pair] = letter[pair + 1] = True
            capital = pair[data[pair + 1] < 0x9F]
            low[capital + 1] += 32
        cut = np.zeros(len(data), bool)
        cut[:-1] = letter[:-1] & mark[1:] | mark[:-1] & (data[:-1] != 39) & letter[1:]
        start, end, row = bounds(~SPACE[data], offsets, cut)
        return low, letter, mark, start, end, row

    def _learn(self, new: np.ndarray, start, end, low, letter, mark) -> None:
        """Take chunks of unknown hashes ``new`` into the tables."""
        digit = np.r_[0, np.cumsum(_DIGIT[low])]
        letters, marks = np.r_[0, np.cumsum(letter)], np.r_[0, np.cumsum(mark)]
        size = end - start
        plain = letters[end] - letters[start] == size
        plain |= (marks[end] - marks[start] == size) & ((digit[end] == digit[start]) | (size == 1))
        raw = low.tobytes()
        words = [raw[a:b] for a, b in zip(start[plain].tolist(), end[plain].tolist())]
        parts, sizes = [], np.zeros(len(new), np.int64)
        for i in range(0, len(words), CHUNK):
            ids, n = self.merger.merge(words[i:i + CHUNK])
            parts.append(ids)
            sizes[np.flatnonzero(plain)[i:i + CHUNK]] = n
        odd = self._odd([raw[a:b].decode("utf-8", "replace") for a, b in zip(start[~plain].tolist(), end[~plain].tolist())])
        parts += odd
        sizes[~plain] = [len(x) for x in odd]
        order = np.r_[np.flatnonzero(plain), np.flatnonzero(~plain)]
        at = np.zeros(len(new), np.int64)
        at[order] = np.cumsum(sizes[order]) - sizes[order] + len(self.pool)
        self.pool = np.concatenate([self.pool, *parts]).astype(np.uint32)
        place = np.searchsorted(self.hash, new)
        self.hash, self.at, self.n = (np.insert(x, place, y) for x, y in ((self.hash, new), (self.at, at), (self.n, sizes)))

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows behind one another, and ids per row."""
        rows = len(offsets) - 1
        special = self._special_rows(data, offsets)
        low, letter, mark, start, end, row = self._chunks(data, offsets)
        if special:
            own = ~np.isin(row, list(special))
            start, end, row = start[own], end[own], row[own]
        h, first, word = np.unique(run_hashes(low, start, end), return_index=True, return_inverse=True)
        if len(self.hash) > CACHE:   # begin anew: memory stays bounded
            self.hash, self.at, self.n, self.pool = self.hash[:0], self.at[:0], self.n[:0], self.pool[:0]
        at = np.searchsorted(self.hash, h)
        known = np.zeros(len(h), bool)
        inside = at < len(self.hash)
        known[inside] = self.hash[at[inside]] == h[inside]
        if not known.all():
            self._learn(h[~known], start[first[~known]], end[first[~known]], low, letter, mark)
            at = np.searchsorted(self.hash, h)
        n = self.n[at][word]
        begin = self.at[at][word]
        total = np.cumsum(n)
        out = self.pool[np.repeat(begin - (total - n), n) + np.arange(total[-1] if len(total) else 0)]
        count = np.bincount(row, weights=n, minlength=rows).astype(np.int64)
        if special:
            pieces = np.split(out, np.cumsum(count)[:-1])
            for i, x in special.items():
                pieces[i] = x.astype(np.uint32)
            out, count = np.concatenate(pieces), np.array([len(x) for x in pieces], np.int64)
        return out, count

    def _special_rows(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, np.ndarray]:
        """Rows that hold a special string, by row number, as ids."""
        near = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
        found = {}
        for i in np.unique(np.searchsorted(offsets, near, "right") - 1).tolist():
            text = data[offsets[i]:offsets[i + 1]].tobytes().decode("utf-8", "replace")
            if self.cut.search(text):
                found[i] = self._odd([text])[0]
        return found


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """One encoder per Python worker."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]


def token_counts(documents: DataFrame, vocab: str = VOCAB, limit: int = LIMIT) -> DataFrame:
    """-> doc_id, n_bytes, n_tokens, over_limit, one row per row of documents."""

    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_buffer(b.column("text"))
        n = [encoder(vocab).ids(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])[1] for i, j in slices(offsets)]
        return pa.record_batch([b.column("doc_id"), b.column("n_bytes"), pa.array(np.concatenate([np.zeros(0, np.int64), *n]))],
                               names=["doc_id", "n_bytes", "n_tokens"])

    src = texts(documents, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    out = map_batches(src, count, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)

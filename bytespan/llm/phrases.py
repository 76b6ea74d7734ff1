"""Operator 12: phrase mining with a bidirectional index per shard.

Texts are cut into pieces and words; about ``SHARD`` words form a shard, kept as
a sequence of word numbers with borders between pieces.  A shard is indexed by
two truncated Burrows-Wheeler transforms, of its sequence and of the reversed
one, whose suffixes are ordered by their first symbols as far as phrases go; all
phrases of one length are intervals that are extended together, by a word to the
left or to the right, and both intervals of a phrase are kept in step.  Counts
of extensions are summed over shards.

Counting goes in two rounds, because a phrase is no more frequent than its
parts.  Word counts come first; shards cut their sequences at rare words and
enumerate pairs; sums over shards tell each shard which of its pairs are
frequent, and it cuts its sequence at the others before it enumerates longer
phrases.  Nothing is dropped that could reach the least count.

Words are numbered by (lang, word) below 2^31, two to a 64-bit key, so keys are
exact.  Scores use decimals.  Defined results: null text is empty; null lang is ``und``; a null
doc_id does not matter; repeated rows count again; an empty table gives no row;
only text and lang are read.  A shard is bounded by ``SHARD`` words and one text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .align import packed, unpacked
from .common import Scratch, map_arrow
from .textarrays import LOWER, bounds, text_buffer

SHARD = 1 << 21      # words
LEAST, LONGEST = 30, 4
COVERED = 80         # per cent of a phrase's occurrences inside a longer one that drop it
TOP = 2000
BUCKETS = 1 << 16    # hash buckets in which words are numbered
SALTS = 64           # parts of a language that are ranked apart first

_END = np.zeros(256, bool)
_END[[*b".,;:!?", 10, 11, 12, 13]] = True
_GAP = np.zeros(256, bool)
_GAP[[9, 32]] = True


class Index:
    """Bidirectional index of a sequence of numbers; 0 is a border.

    Suffixes are ordered by their first ``depth`` symbols, which is enough for
    intervals of phrases up to that length.  A shard is far below 2^31 words, so
    all but the keys of sorts are 32-bit numbers.
    """

    def __init__(self, sequence: np.ndarray, depth: int):
        self.sequence = np.zeros(len(sequence) + 2, np.int32)
        self.sequence[1:-1] = sequence
        self.depth, self.sigma = depth, int(self.sequence.max()) + 1

    def _side(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Transform of ``s``, and where each row's symbol stands among the suffixes."""
        rank, width, order = s, 1, None
        while order is None or width < self.depth:
            key = rank.astype(np.int64)
            if self.depth > 1:
                key *= int(rank.max()) + 1
                key[:max(0, len(s) - width)] += rank[width:]
            order = None
            order = np.argsort(key, kind="stable")
            key = key[order]
            new = key[1:] != key[:-1]
            del key
            place = np.zeros(len(s), np.int32)
            np.cumsum(new, out=place[1:])
            rank = np.empty(len(s), np.int32)
            rank[order] = place
            width *= 2
        order -= 1
        symbols = s[order]
        del order, rank, place, new
        to = np.empty(len(s), np.int32)
        to[np.argsort(symbols, kind="stable")] = np.arange(len(s), dtype=np.int32)
        return symbols, to

    @cached_property
    def forward(self) -> tuple[np.ndarray, np.ndarray]:
        return self._side(self.sequence)

    @cached_property
    def backward(self) -> tuple[np.ndarray, np.ndarray]:
        return self._side(self.sequence[::-1].copy())

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Phrases of one word: symbols, interval in either transform, size."""
        size = np.bincount(self.sequence, minlength=self.sigma)
        at = np.cumsum(size) - size
        own = np.flatnonzero(size)
        own = own[own > 0]
        at = at[own].astype(np.int32)
        return own[:, None].astype(np.int32), at, at, size[own].astype(np.int32)

    def extended(self, phrases: np.ndarray, lo: np.ndarray, ol: np.ndarray, size: np.ndarray, left: bool) -> tuple[np.ndarray, ...]:
        """All phrases that are one word longer on one side, with their
        intervals (``lo`` in the forward, ``ol`` in the backward transform)."""
        symbols, to = self.forward if left else self.backward
        near, far = (lo, ol) if left else (ol, lo)
        begin = np.cumsum(size, dtype=np.int32) - size
        rows = np.arange(int(size.sum()), dtype=np.int32)
        rows += np.repeat(near - begin, size)
        key = np.repeat(np.arange(len(size)) * self.sigma, size)
        key += symbols[rows]
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][:len(key)]).astype(np.int32)
        owner, symbol = (x.astype(np.int32) for x in np.divmod(key[first], self.sigma))
        count = np.diff(np.r_[first, np.int32(len(key))])
        del key
        near, far = to[rows[order[first]]], far[owner] + first - begin[owner]
        del rows, order
        real = symbol > 0
        word, old = symbol[real, None], phrases[owner[real]]
        phrases = np.concatenate([word, old] if left else [old, word], axis=1)
        near, far, count = near[real], far[real], count[real]
        return (phrases, near, far, count) if left else (phrases, far, near, count)

    def phrases(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(phrases, counts) of each length from two up to the depth; sides take turns."""
        at = self.words()
        for length in range(2, self.depth + 1):
            at = self.extended(*at, left=length % 2 == 1)
            yield at[0], at[3]


def _joined(s: np.ndarray, cut: np.ndarray | None = None) -> np.ndarray:
    """``s`` with borders where ``cut`` says so (before that place), one border
    between runs, and without words that stand alone."""
    word = s > 0
    begins = word & ~np.r_[False, word[:-1]]
    if cut is not None:
        begins |= word & cut
    ends = word & ~np.r_[word[1:], False] | word & np.r_[begins[1:], True]
    alone = begins & ends
    begins, word = begins & ~alone, word & ~alone
    at = word.astype(np.int32) + begins
    np.cumsum(at, out=at)
    out = np.zeros(int(at[-1]) if len(at) else 0, np.int32)
    out[at[word] - 1] = s[word]
    return out


SHARDS = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("local", pa.int32()), ("n", pa.int64()), ("blob", pa.binary())])


class _Words:
    """Words of one task's texts, given out as shards."""

    def __init__(self, task: int):
        self.task, self.count = task, 0
        self.clear()

    def clear(self) -> None:
        self.dictionaries, self.codes, self.langs, self.begins = [], [], [], []
        self.names: dict[str, int] = {}
        self.base = self.size = 0

    def add(self, texts: pa.Array, langs: pa.Array) -> None:
        data, offsets = text_buffer(texts)
        data = LOWER[data]
        end = _END[data]
        inside = ~(end | _GAP[data])
        start, stop, row = bounds(inside, offsets)
        if not len(start):
            return
        edges = np.r_[0, np.cumsum(stop - start)].astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data[inside]))]).dictionary_encode()
        ends = np.cumsum(end)[start]
        self.begins.append(np.r_[True, (row[1:] != row[:-1]) | (ends[1:] != ends[:-1])])
        self.codes.append(words.indices.to_numpy() + self.base)
        self.dictionaries.append(words.dictionary)
        self.base += len(words.dictionary)
        self.langs.append(np.array([self.names.setdefault(x, len(self.names)) for x in langs.to_pylist()], np.int32)[row])
        self.size += len(start)

    def shard(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            merged = pa.concat_arrays(self.dictionaries).dictionary_encode()
            n_words = len(merged.dictionary)
            both = np.concatenate(self.langs).astype(np.int64)
            both *= n_words
            both += merged.indices.to_numpy()[np.concatenate(self.codes)]
            self.codes, self.langs, self.dictionaries = [], [], []
            both, local = np.unique(both, return_inverse=True)
            local = local.astype(np.int32)
            n = np.bincount(local)
            often = np.argsort(-n, kind="stable")     # frequent words have small numbers, which pack well
            number = np.empty(len(n), np.int32)
            number[often] = np.arange(len(n))
            begins = np.concatenate(self.begins)
            at = np.cumsum(begins, dtype=np.int32)
            at += np.arange(len(local), dtype=np.int32)
            sequence = np.zeros(len(local) + int(begins.sum()), np.int32)
            sequence[at] = number[local] + 1
            name = self.task << 32 | self.count
            self.count += 1
            lang, word = np.divmod(both[often], n_words)
            k = len(often)
            yield pa.record_batch([pa.array([name] * k, pa.int64()), pa.array(list(self.names)).take(pa.array(lang)),
                                   merged.dictionary.take(pa.array(word)).cast(pa.large_string()).cast(pa.string()),
                                   pa.array(np.arange(k, dtype=np.int32)), pa.array(n[often]), pa.nulls(k, pa.binary())], schema=SHARDS)
            yield pa.record_batch([pa.array([name]), pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()),
                                   pa.array([packed(sequence=sequence)], pa.binary())], schema=SHARDS)
        self.clear()


def shards(documents: DataFrame) -> DataFrame:
    """-> shard, lang, word, local, n for each word of a shard, and a row with its sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = _Words(TaskContext.get().partitionId())
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                words.add(part.column("text"), part.column("lang"))
                if words.size >= SHARD:
                    yield from words.shard()
        yield from words.shard()

    src = documents.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    return map_arrow(src, run, "shard long, lang string, word string, local int, n long, blob binary")


def numbered(rows: DataFrame, least: int) -> DataFrame:
    """Rows of words -> shard, local, id, f, lang, word of the words that occur
    ``least`` times; lang and word on one row of each word.  A word's number is
    its rank in its hash bucket and the bucket, so one shuffle sums and numbers."""
    words = rows.filter("word is not null").withColumn("bucket", F.pmod(F.xxhash64("lang", "word"), F.lit(BUCKETS))).repartition("bucket")
    same = Window.partitionBy("bucket", "lang", "word")
    words = words.withColumns({"f": F.sum("n").over(same), "own": F.min("shard").over(same) == F.col("shard")}).filter(F.col("f") >= least)
    rank = F.dense_rank().over(Window.partitionBy("bucket").orderBy("lang", "word"))
    number = (rank.cast("long") - 1) * BUCKETS + F.col("bucket") + 1
    words = words.withColumn("id", number).withColumn("id", F.when(F.col("id") < 1 << 31, F.col("id")).otherwise(F.raise_error(F.lit("more than 2^31 words"))))
    once = lambda c: F.when(F.col("own"), F.col(c)).alias(c)
    return words.select("shard", "local", "id", "f", once("lang"), once("word"))


def _map(rows: pa.Table) -> pa.Table:
    """A shard's frequent words: local and global numbers as one value."""
    local, ids = rows.column("local").to_numpy(), rows.column("id").to_numpy()
    order = np.argsort(ids)
    return pa.table({"shard": [rows.column("shard")[0].as_py()], "map": pa.array([packed(local=local[order].astype(np.int32), id=ids[order].astype(np.int64))], pa.binary())})


def _symbols(blob: bytes, known: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """A shard's sequence over its frequent words (rare ones are borders), and
    the global ids of its symbols 1, 2, ..."""
    sequence = unpacked(blob)["sequence"]
    known = unpacked(known) if known is not None else {"local": np.zeros(0, np.int32), "id": np.zeros(0, np.int64)}
    symbol = np.zeros(max(int(sequence.max(initial=0)), int(known["local"].max(initial=0)) + 1) + 1, np.int32)
    symbol[known["local"] + 1] = np.arange(1, len(known["id"]) + 1)
    return symbol[sequence], np.r_[0, known["id"]]


def _key(ids: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The ids of two words of each row as one number; a missing second one is 0."""
    key = ids[words[:, 0]]
    key <<= 32
    if words.shape[1] > 1:
        key |= ids[words[:, 1]]
    return key


def _chunked(**columns: np.ndarray) -> list[pa.RecordBatch]:
    return pa.table(columns).to_batches(max_chunksize=100_000)


def pairs_of_shards(indexed: DataFrame) -> DataFrame:
    """(shard, blob, map) -> shard, p, n: pairs of adjacent frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, blob, known in zip(*(b.column(c) for c in ("shard", "blob", "map"))):
                sequence, ids = _symbols(blob.as_py(), known.as_py())
                ((words, n),) = Index(_joined(sequence), 2).phrases()
                yield from _chunked(shard=np.full(len(n), shard.as_py(), np.int64), p=_key(ids, words), n=n.astype(np.int32))

    return indexed.mapInArrow(run, "shard long, p long, n int")


def _longer(shard: pa.Table, good: pa.Table) -> pa.Table:
    """Phrases of three words and more of a shard all of whose pairs are frequent."""
    sequence, ids = _symbols(shard.column("blob")[0].as_py(), shard.column("map")[0].as_py())
    good = good.column("p").to_numpy()
    number = lambda x: np.searchsorted(ids, x)
    good = np.sort(number(good >> 32) * len(ids) + number(good & 0xFFFFFFFF))
    pair = np.zeros(len(sequence), np.int64)
    pair[1:] = sequence[:-1]
    pair *= len(ids)
    pair[1:] += sequence[1:]
    at = np.minimum(np.searchsorted(good, pair), max(0, len(good) - 1))
    cut = good[at] != pair if len(good) else np.ones(len(pair), bool)
    del pair, at
    sequence = _joined(sequence, cut)
    found = list(Index(sequence, LONGEST).phrases())[1:]
    columns = {"p": np.concatenate([_key(ids, w[:, :2]) for w, _ in found]), "q": np.concatenate([_key(ids, w[:, 2:]) for w, _ in found]),
               "n": np.concatenate([n for _, n in found]).astype(np.int32)}
    return pa.Table.from_batches(_chunked(**columns), schema=pa.table(columns).schema)


def counted(documents: DataFrame, scratch: Scratch, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent words (id, lang, word, f), frequent phrases (p, q: their words
    two by two, f), and the number of all words of each lang (lang, n)."""
    rows = scratch.keep(shards(documents), bucketed="shard")
    size = scratch.keep(rows.filter("word is not null").groupBy("lang").agg(F.sum("n").alias("n")))
    often = scratch.keep(numbered(rows, least))
    words = scratch.keep(often.filter("word is not null").select("id", "lang", "word", "f"))
    maps = scratch.keep(often.select("shard", "local", "id").groupBy("shard").applyInArrow(_map, "shard long, map binary"), bucketed="shard")
    scratch.drop(often)
    # sequences stay where they are: both tables lie in buckets of shards
    indexed = rows.filter("blob is not null").select("shard", "blob").join(maps, "shard", "left")
    total = F.sum("n").over(Window.partitionBy("p"))
    good = scratch.keep(pairs_of_shards(indexed).withColumn("f", total).filter(F.col("f") >= least).select("shard", "p", "f"))
    longer = indexed.groupBy("shard").cogroup(good.select("shard", "p").groupBy("shard")).applyInArrow(_longer, "p long, q long, n int")
    longer = longer.groupBy("p", "q").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    two = good.groupBy("p").agg(F.max("f").alias("f")).select("p", F.lit(0).cast("long").alias("q"), "f")
    phrases = scratch.keep(two.unionByName(longer))
    scratch.drop(rows, maps, good)
    return words, phrases, size


def _score(a, l, r):  # noqa: E741
    """floor(2000000 a / (l + r)), exact beyond 64 bits."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * wide(a), wide(l) + wide(r))


def _two(*words: Column | None) -> Column:
    """Key of one word or two."""
    first, second = words[0], words[1] if len(words) > 1 else None
    key = F.shiftleft(first, 32)
    return key if second is None else key.bitwiseOR(second)


def _keyed(words: list[Column]) -> tuple[Column, Column]:
    return _two(*words[:2]), _two(*words[2:]) if len(words) > 2 else F.lit(0).cast("long")


def collocations(documents: DataFrame, top: int = TOP, least: int = LEAST) -> DataFrame:
    """-> lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each lang."""
    low = F.lit((1 << 32) - 1)
    word = [F.shiftrightunsigned("p", 32), F.col("p").bitwiseAND(low), F.shiftrightunsigned("q", 32), F.col("q").bitwiseAND(low)]
    length = F.lit(2) + (word[2] > 0).cast("int") + (word[3] > 0).cast("int")
    with Scratch(documents.sparkSession) as scratch:
        words, phrases, size = counted(documents, scratch, least)
        every = phrases.unionByName(words.select(_two(F.col("id")).alias("p"), F.lit(0).cast("long").alias("q"), "f"))
        scored = []
        for k in range(2, LONGEST + 1):
            rows = phrases.filter(length == k).withColumnRenamed("f", "a")
            if k < LONGEST:      # most occurrences inside one longer phrase: those of k + 1 words have the most
                more = phrases.filter(length == k + 1)
                sides = [more.select(*[c.alias(x) for c, x in zip(_keyed(word[i:i + k]), "pq")], "f") for i in (0, 1)]
                inside = sides[0].unionByName(sides[1]).groupBy("p", "q").agg(F.max("f").alias("inside"))
                rows = rows.join(inside, ["p", "q"], "left").filter(F.coalesce(F.col("inside") * 100 < F.col("a") * COVERED, F.lit(True))).drop("inside")
            cuts = []
            for cut in range(1, k):
                for side, part in (("l", word[:cut]), ("r", word[cut:k])):
                    p, q = _keyed(part)
                    rows = rows.withColumns({"kp": p, "kq": q}).join(every.toDF("kp", "kq", f"{side}{cut}"), ["kp", "kq"]).drop("kp", "kq")
                cuts.append(F.struct(_score(F.col("a"), F.col(f"l{cut}"), F.col(f"r{cut}")).alias("score"), F.lit(cut).alias("cut"),
                                     F.col(f"l{cut}").alias("l"), F.col(f"r{cut}").alias("r")))
            scored.append(rows.select("p", "q", "a", (F.least(*cuts) if len(cuts) > 1 else cuts[0]).alias("x")))
        rows = scored[0]
        for more in scored[1:]:
            rows = rows.unionByName(more)
        rows = rows.select("p", "q", "a", "x.l", "x.r", "x.score")
        for k, w in enumerate(word):
            name = words.select(F.col("id").alias("k"), F.col("word").alias(f"w{k}"), *([] if k else [F.col("lang")]))
            rows = rows.withColumn("k", w).join(name, "k", "left" if k > 1 else "inner").drop("k")
        rows = rows.select("lang", F.concat_ws(" ", *[f"w{k}" for k in range(LONGEST)]).alias("phrase"), "a", "l", "r", "score")
        order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
        first = F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("first", first).filter(F.col("first") <= top)
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
        return scratch.release(scratch.keep(rows.join(size, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")))

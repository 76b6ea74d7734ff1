"""Operator 5: best-fit packing with swap-based local search.

Every document becomes its ids and a closing id 0; what is longer than a
sequence is cut into full pieces and a rest.  Pieces (40 bytes each, never
their ids) are dealt out by document hash; each task packs pools of ``POOL``
pieces by best fit in falling order and then exchanges pieces between underfull
bins, one for one, two for one, or moves them.  A step counts only if the sum
of squared fills grows, so the search ends; it stops early at the lower bound
(sum of lengths over capacity, rounded up).

Defined results: null or empty text is the single id 0; repeated rows are
packed each for itself; an empty table gives no row.  One pool costs at most
one bin more than its lower bound in all cases seen; pools end with the task,
so the loss is one bin in many thousand.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import map_batches, texts
from .textarrays import slices, text_buffer
from .tokens import LIMIT, VOCAB, encoder

POOL = 1 << 16
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(documents: DataFrame, vocab: str = VOCAB, capacity: int = LIMIT) -> DataFrame:
    """-> doc_id, piece, start, length, ids_crc32: what has to be packed."""

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_buffer(b.column("text"))
        row, piece, start, length, crc = [], [], [], [], []
        for i, j in slices(offsets):
            ids, n = encoder(vocab).ids(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
            raw = memoryview(ids.astype("<u4").tobytes())
            at = 0
            for r, k in enumerate(n.tolist(), i):
                for p, s in enumerate(range(0, k + 1, capacity)):
                    e = min(s + capacity, k + 1)
                    x = zlib.crc32(raw[4 * (at + s):4 * (at + min(e, k))])
                    row.append(r)
                    piece.append(p)
                    start.append(s)
                    length.append(e - s)
                    crc.append(zlib.crc32(b"\0\0\0\0", x) if e > k else x)
                at += k
        return pa.record_batch([b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                                *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                               names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_batches(texts(documents), cut, PIECES)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins as lists of places in ``sizes``."""
    bins: list[list[int]] = []
    by_free: dict[int, list[int]] = {}
    mask = 0   # bit f: some open bin has f free
    for i in sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True):
        s = sizes[i]
        fits = mask >> s
        if fits:
            free = (fits & -fits).bit_length() - 1 + s
            k = by_free[free].pop()
            if not by_free[free]:
                mask ^= 1 << free
        else:
            free, k = capacity, len(bins)
            bins.append([])
        bins[k].append(i)
        if free - s:
            by_free.setdefault(free - s, []).append(k)
            mask |= 1 << (free - s)
    return bins


def local_search(sizes: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Empty bins by moves and swaps that raise the sum of squared fills."""
    least = -(-sum(sizes) // capacity)
    bins = [b for b in bins if b]
    fill = [sum(sizes[i] for i in b) for b in bins]
    stuck: set[int] = set()
    while sum(map(bool, bins)) > least:
        victim = min((k for k in range(len(bins)) if bins[k] and k not in stuck and fill[k] < capacity),
                     key=fill.__getitem__, default=None)
        if victim is None:
            break
        step = _step(sizes, bins, fill, victim, capacity)
        if step is None:
            stuck.add(victim)
            continue
        other, give, take = step
        stuck.clear()
        bins[victim] = [i for i in bins[victim] if i not in give] + take
        bins[other] = [i for i in bins[other] if i not in take] + give
        fill[victim], fill[other] = (sum(sizes[i] for i in bins[k]) for k in (victim, other))
    return [b for b in bins if b]


def _step(sizes, bins, fill, victim, capacity) -> tuple[int, list[int], list[int]] | None:
    """The move that shifts most out of ``victim`` into one bin at least as full:
    (bin, pieces given, pieces taken)."""
    others = [k for k in range(len(bins)) if k != victim and fill[victim] <= fill[k] < capacity]
    own = sorted(bins[victim], key=sizes.__getitem__, reverse=True)
    free = np.array([capacity - fill[k] for k in others])
    for i in own:   # a move empties the bin fastest; into the bin that it fills best
        fits = np.flatnonzero(free >= sizes[i])
        if len(fits):
            return others[fits[np.argmin(free[fits])]], [i], []
    there = [(i, k) for k in others for i in bins[k]]
    if not there:
        return None
    size = np.array([sizes[i] for i, _ in there])
    room = size + np.array([capacity - fill[k] for _, k in there])
    best, found = 0, None
    for give in [[i] for i in own] + [[i, j] for n, i in enumerate(own) for j in own[n + 1:]]:
        x = sum(sizes[i] for i in give)
        gain = np.where((x > size) & (x <= room), x - size, 0)
        at = int(np.argmax(gain))
        if gain[at] > best:
            best, found = int(gain[at]), (there[at][1], give, [there[at][0]])
    return found


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    whole = [[i] for i, s in enumerate(sizes) if s >= capacity]
    rest = [i for i, s in enumerate(sizes) if s < capacity]
    part = [sizes[i] for i in rest]
    return whole + [[rest[i] for i in b] for b in local_search(part, best_fit(part, capacity), capacity)]


def packed(documents: DataFrame, vocab: str = VOCAB, capacity: int = LIMIT, pool: int = POOL) -> DataFrame:
    """-> pieces with sequence_id and offset, gapless within a sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held, n = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            nonlocal made
            t = pa.Table.from_batches(held).combine_chunks()
            sizes = t.column("length").to_pylist()
            seq, offset = [0] * len(sizes), [0] * len(sizes)
            for b in pack(sizes, capacity):
                at = 0
                for i in b:
                    seq[i], offset[i] = (task << 33) + made, at
                    at += sizes[i]
                made += 1
            t = t.append_column("sequence_id", pa.array(seq, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))
            return t.to_batches()

        for b in batches:
            for i in range(0, b.num_rows, pool):
                held.append(b.slice(i, pool))
                n += held[-1].num_rows
                if n >= pool:
                    yield from close()
                    held, n = [], 0
        if n:
            yield from close()

    # the order within a task is fixed, so a task that runs again packs alike
    dealt = pieces(documents, vocab, capacity).repartition("doc_id", "piece").sortWithinPartitions("doc_id", "piece", "length", "ids_crc32")
    return dealt.mapInArrow(run, PIECES + ", sequence_id long, offset long")

"""Operator 10: exact top-k search by columnar branch and bound.

Vectors are packed into blobs laid out by dimension, in the smallest integer
type that holds them.  A cell of the grid is a block of at most about
``QUERIES`` queries and a share of the candidates' blobs; a blob is sent once for
each block, a query once for each share, never a pair of blobs.  The blobs of a
cell come to its task one after another, queries first: the task holds the
queries, one batch of candidates and the k best rows so far of each query.
Scores are accumulated ``STEP`` dimensions at a time; what a candidate can still
gain is at most the product of the norms of both remainders, so candidates that
with that bound stay below the k-th best score of every query are compacted
away.  Each cell returns its k best rows for a query, which are merged by window.

Scores are integers: components become floor(1024 x).  They are multiplied as
doubles where the norms show that no sum leaves the integers that doubles hold,
as 64-bit integers otherwise.  Bounds are floating point and widened, so they
never drop a true member.

Defined results: null vectors, or vectors with a null or non-finite component,
take no part, and neither do rows without an id; vectors of a length other than
a query's are no candidates of that query; ties go to the smaller id; repeated
rows are candidates each, except those with the query's own id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow

SCALE, K, EVERY = 1024, 10, 100
ROWS, STEP = 512, 16
QUERIES = 2048    # queries of a block, at most about
SIDE = 128        # queries that meet a batch of candidates at once
MEET = 1024       # candidates of a batch, at least
SKIP = 15         # batches without bounds after one in which they cleared little
CELLS = 3         # cells of the grid for each shuffle partition, at least about
EXACT = 1 << 52   # sums below it are exact in doubles


def _packed(rows: DataFrame) -> DataFrame:
    """Blobs of at most ``ROWS`` rows of one block and length: block, dim, ids,
    width (bytes of a number), values (dimension after dimension)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}

        def blob(key: tuple[int, int]) -> pa.RecordBatch:
            ids = np.concatenate([x[0] for x in held[key]])
            values = np.concatenate([x[1] for x in held.pop(key)])
            low, high = int(values.min(initial=0)), int(values.max(initial=0))
            kind = next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
            return pa.record_batch([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()), pa.array([ids.tobytes()], pa.binary()),
                                    pa.array([np.dtype(kind).itemsize], pa.int32()), pa.array([np.ascontiguousarray(values.T).astype(kind).tobytes()], pa.binary())],
                                   names=["block", "dim", "ids", "width", "values"])

        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                b = whole.slice(i, ROWS)
                ids, block = (b.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "block"))
                flat, n = b.column("v").flatten().to_numpy(zero_copy_only=False), b.column("v").value_lengths().to_numpy()
                first = np.cumsum(n) - n
                for key in sorted(set(zip(block.tolist(), n.tolist()))):
                    own = np.flatnonzero((block == key[0]) & (n == key[1]))
                    values = flat[first[own][:, None] + np.arange(key[1])]
                    held.setdefault(key, []).append((ids[own].astype(np.int64), values.astype(np.int64).reshape(len(own), key[1])))
                    if sum(len(x[0]) for x in held[key]) >= ROWS:
                        yield blob(key)
        for key in list(held):
            yield blob(key)

    return map_arrow(rows, run, "block long, dim int, ids binary, width int, values binary")


def _open(dim: int, ids: bytes, width: int, values: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(values, f"<i{width}").reshape(dim, len(i)).astype(np.int64)


def best(q: np.ndarray, ids: np.ndarray, values: np.ndarray, norms: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k best candidates of one query; norms: of every
    candidate's remainder after each step, dimension blocks by rows."""
    live = np.flatnonzero(ids != own)
    score = np.zeros(len(live), np.int64)
    for s, d in enumerate(range(0, len(q), STEP)):
        e = min(d + STEP, len(q))
        score = score + q[d:e] @ values[d:e][:, live]
        if e < len(q) and len(live) > k:
            rest = norms[s + 1][live] * float(np.sqrt((q[e:].astype(float) ** 2).sum())) * (1 + 1e-9) + 1
            sure = score - rest
            floor = np.partition(sure, len(sure) - k)[len(sure) - k]
            stay = score + rest >= floor
            live, score = live[stay], score[stay]
    order = np.lexsort((ids[live], -score))[:k]
    return ids[live[order]], score[order]


class _Cell:
    """The queries of a cell and the k best rows that each has met."""

    def __init__(self, dim: int, k: int):
        self.dim, self.k = dim, k
        self.skip = 0
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.sides: list[tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]] | None = None

    def _rests(self, x: np.ndarray) -> list[np.ndarray]:
        """Norms of the rows' remainders from each step on, the whole first."""
        return [np.sqrt((x[d:].astype(float) ** 2).sum(axis=0)) for d in range(0, max(1, self.dim), STEP)]

    def begin(self) -> None:
        ids, values = np.concatenate([x[0] for x in self.parts]), np.concatenate([x[1] for x in self.parts], axis=1)
        self.parts, self.sides = [], []
        for i in range(0, len(ids), SIDE):
            v = values[:, i:i + SIDE]
            self.sides.append((ids[i:i + SIDE], v, self._rests(v), [np.zeros(0, np.int64)] * 3))

    def meet(self, ids: np.ndarray, values: np.ndarray) -> None:
        if self.sides is None:
            self.begin()
        rests = self._rests(values)
        exact = {float: values.astype(float)}
        for n, (qids, q, qrests, (at, near, score)) in enumerate(self.sides):
            # the k-th best score of each query so far
            full = np.flatnonzero(np.bincount(at, minlength=len(qids)) >= self.k)
            floor = np.full(len(qids), -np.inf)
            floor[full] = score[np.searchsorted(at, full, "right") - 1]
            if float(qrests[0].max()) * float(rests[0].max()) < EXACT:
                x, kind = self._scores(q.astype(float), qrests, exact[float], rests, floor), float
            else:
                x, kind = self._single(qids, q, ids, values, rests), int
            if kind is float:
                live, s = x
                if len(full) < len(qids) and len(live) > self.k:
                    s[qids[:, None] == ids[live]] = -np.inf     # not a query's own rows
                    floor = np.maximum(floor, np.partition(s, len(live) - self.k, axis=1)[:, len(live) - self.k])
                hit, c = np.nonzero(s >= floor[:, None])
                own = ids[live[c]] != qids[hit]
                hit, c = hit[own], c[own]
                found = hit, ids[live[c]], s[hit, c].astype(np.int64)
            else:
                found = x
            if not len(found[0]):
                continue
            at, near, score = (np.r_[a, b] for a, b in zip((at, near, score), found))
            order = np.lexsort((near, -score, at))
            at, near, score = at[order], near[order], score[order]
            stay = np.arange(len(at)) - np.searchsorted(at, at) < self.k
            self.sides[n] = (qids, q, qrests, [at[stay], near[stay], score[stay]])

    def _scores(self, q: np.ndarray, qrests, values: np.ndarray, rests, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Candidates that can be among the best of a query, and their scores with
        all queries.  Where bounds cleared few of the last candidates that were
        looked at this way, the next ``SKIP`` batches are multiplied at once."""
        live = np.arange(values.shape[1])
        if self.skip or not self.dim or not np.isfinite(floor).all():
            self.skip = max(0, self.skip - 1)
            return live, q.T @ values
        s = np.zeros((q.shape[1], values.shape[1]))
        for n, d in enumerate(range(0, self.dim, STEP)):
            e = min(d + STEP, self.dim)
            s += q[d:e].T @ values[d:e]
            if e < self.dim:
                rest = qrests[n + 1][:, None] * (rests[n + 1][None, live] * (1 + 1e-9)) + 1
                stay = (s + rest >= floor[:, None]).any(axis=0)
                if stay.mean() < 0.75:
                    live, s, values = live[stay], s[:, stay], values[:, stay]
        if 2 * len(live) > len(rests[0]):
            self.skip = SKIP
        return live, s

    def _single(self, qids: np.ndarray, q: np.ndarray, ids: np.ndarray, values: np.ndarray, rests) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers too large for doubles: query by query, in 64-bit integers."""
        got = [best(np.ascontiguousarray(q[:, n]), ids, values, rests, own, self.k) for n, own in enumerate(qids.tolist())]
        return np.repeat(np.arange(len(got)), [len(i) for i, _ in got]), np.concatenate([i for i, _ in got]), np.concatenate([s for _, s in got])

    def rows(self) -> Iterator[pa.RecordBatch]:
        for qids, _, _, (at, near, score) in self.sides or []:
            yield pa.record_batch([pa.array(qids[at]), pa.array(near), pa.array(score)], names=["query_id", "vec_id", "score"])


def top_k(embeddings: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """-> query_id, rank, vec_id, score for rows whose id is divisible by ``every``."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = (embeddings.filter("vec_id is not null and embedding is not null").filter(good)
            .select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v")))
    asked = rows.filter(F.col("vec_id") % every == 0)
    blocks = max(1, -(-asked.count() // QUERIES))
    tasks = int(embeddings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = max(1, -(-CELLS * tasks // blocks))
    # a cell of the grid is a block of queries and a share of the candidates' blobs
    every_share, every_block = (F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))) for n in (shares, blocks))
    queries = (_packed(asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).repartition(min(blocks, tasks), "block"))
               .select("dim", "block", every_share.alias("share"), F.lit(0).alias("side"), "ids", "width", "values"))
    others = (_packed(rows.withColumn("block", F.lit(0).cast("long")))
              .select("dim", F.pmod(F.xxhash64("ids"), F.lit(shares)).alias("share"), "ids", "width", "values")
              .select("dim", every_block.alias("block"), "share", F.lit(1).alias("side"), "ids", "width", "values"))
    grid = queries.unionByName(others).repartition(tasks, "dim", "block", "share").sortWithinPartitions("dim", "block", "share", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cell, met = None, _Cell(0, k), []

        def meet() -> None:
            if met:
                cell.meet(np.concatenate([x[0] for x in met]), np.concatenate([x[1] for x in met], axis=1))
                met.clear()

        for b in batches:
            for r in range(b.num_rows):
                dim, block, share, side, ids, width, values = (b.column(c)[r].as_py() for c in ("dim", "block", "share", "side", "ids", "width", "values"))
                if key != (dim, block, share):
                    meet()
                    yield from cell.rows()
                    key, cell = (dim, block, share), _Cell(dim, k)
                blob = _open(dim, ids, width, values)
                if side == 0:
                    cell.parts.append(blob)
                elif cell.parts or cell.sides:      # a cell without queries asks for nothing
                    met.append(blob)
                    if sum(len(x[0]) for x in met) >= MEET:
                        meet()
        meet()
        yield from cell.rows()

    found = map_arrow(grid, run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

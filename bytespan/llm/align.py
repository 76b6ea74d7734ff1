"""Operator 13: alignment of two tokenizers' tokens.

Documents are shuffled by their full text; each distinct text is tokenised and
aligned once, and its links count as often as the text occurs.  A text is read
with a space before it and cut in front of every single space between two
non-space characters.  No token of either vocabulary reaches over such a place
(checked for the one, true of the other's pattern), so a chunk's tokens are the
same wherever it stands, and every distinct chunk of a shard is encoded once.

Texts of about ``SHARD`` bytes form a shard: one row with its sequence of chunk
numbers and the links of each chunk, a row for each text, and a row for each
pair of ids with its weighted count.  Pair counts are summed over shards, the
highest of each B id is found, and every shard gets the figures of its own
pairs back; the measures then join the documents by SHA-256 of the text.

Defined results: texts null, empty, or not restored by both token sequences have
zeros and ''; rows without a doc_id are kept and count; repeated rows give
repeated results; an empty table gives no row.  Only doc_id and text are read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, texts
from .tokens import vocabulary_path

A, B = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"   # A: byte_bpe_50k.json's vocabulary as ranks
SHARD = 8 << 20       # bytes of text
BATCH = 20_000        # chunks encoded together

#: White space beyond ASCII, in UTF-8.
_WIDE = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def _spaces(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space characters."""
    out = (data == 32) | (data >= 9) & (data <= 13)
    if (data >= 0x80).any():
        for c in _WIDE:
            lead = np.flatnonzero(data[:len(data) - len(c) + 1] == c[0])
            for k in range(1, len(c)):
                lead = lead[data[lead + k] == c[k]]
            for k in range(len(c)):
                out[lead + k] = True
    return out


class Tokens:
    """Byte strings by number, behind one another."""

    def __init__(self, strings: list[bytes]):
        self.size = np.array([len(x) for x in strings], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(strings), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        n = self.size[ids]
        return self.bytes[np.repeat(self.at[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


class Chunks(NamedTuple):
    """Aligned chunks: figures of each, their links behind one another (A id
    << 32 | B id, one for each group), and their groups as text, each ended by ;."""

    order: np.ndarray    # the chunk's number among those given
    whole: np.ndarray    # both sides restore it
    n_a: np.ndarray
    n_b: np.ndarray
    count: np.ndarray    # groups, and so links
    links: np.ndarray
    said: list[bytes]


class Aligner:
    """Both tokenizers.  A's merges come from its vocabulary as ranks, which is
    the same vocabulary; the tests hold it against the library of ``A``."""

    def __init__(self, a: str, b: str):
        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN

        with open(vocabulary_path(a), "rb") as lines:
            ranks = {base64.b64decode(t): int(n) for t, n in map(bytes.split, lines)}
        self.a = tiktoken.Encoding(a, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(b))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.a_tokens = Tokens(sorted(ranks, key=ranks.get))
        self.b_tokens = Tokens([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        self.digits = Tokens([b"%d;" % i for i in range(max(len(ranks), len(pieces)))])
        #: a piece that held a space after something else could reach over a cut
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)

    def _encoded(self, chunks: list[bytes]) -> tuple[np.ndarray, ...]:
        """Order of the chunks, ids of A and B behind one another, tokens of each chunk."""
        strings = [c.decode("utf-8", "replace") for c in chunks]
        # chunks that begin with one space and have none at either end can stand behind one another for A
        plain = [s.strip() == s[1:] and len(s) > 1 for s in strings]
        order = np.argsort(~np.array(plain, bool), kind="stable")
        strings = [strings[i] for i in order.tolist()]
        together = sum(plain) if self.cuts else 0
        a, n_a = [], []
        for i in range(0, together, BATCH):
            part = strings[i:min(i + BATCH, together)]
            ids = np.array(self.a.encode_ordinary("".join(part)), np.int64)
            end = np.cumsum([len(s.encode()) for s in part])
            a.append(ids)
            n_a.append(np.bincount(np.searchsorted(end, np.cumsum(self.a_tokens.size[ids])), minlength=len(part)))
        for s in strings[together:]:
            ids = np.array(self.a.encode_ordinary(s), np.int64)
            a.append(ids)
            n_a.append([len(ids)])
        b, n_b = [], []
        for i in range(0, len(strings), BATCH):
            ids = self.b.encode([s[1:] for s in strings[i:i + BATCH]], num_threads=1)   # which adds the space itself
            n_b.append([len(x) for x in ids])
            b.append(np.fromiter(chain.from_iterable(ids), np.int64))
        flat = lambda x: np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64)
        return order, flat(a), flat(n_a), flat(b), flat(n_b)

    def aligned(self, chunks: list[bytes]) -> Chunks:
        order, a, n_a, b, n_b = self._encoded(chunks)
        chunks = [chunks[i] for i in order.tolist()]
        n, size = len(chunks), np.array([len(c) for c in chunks], np.int64)
        of_a, of_b = np.repeat(np.arange(n), n_a), np.repeat(np.arange(n), n_b)
        total = lambda of, tokens, ids: np.bincount(of, tokens.size[ids], n).astype(np.int64)
        whole = (total(of_a, self.a_tokens, a) == size) & (total(of_b, self.b_tokens, b) == size)
        here = np.frombuffer(b"".join([c for c, w in zip(chunks, whole.tolist()) if w]), np.uint8)
        held, chunk = whole.copy(), np.repeat(np.flatnonzero(whole), size[whole])
        for tokens, ids, of in ((self.a_tokens, a, of_a), (self.b_tokens, b, of_b)):
            whole[chunk[tokens.joined(ids[held[of]]) != here]] = False
        a, of_a, b, of_b = a[whole[of_a]], of_a[whole[of_a]], b[whole[of_b]], of_b[whole[of_b]]
        # where both sides end: the last token of a group on either side
        end_a, end_b = np.cumsum(self.a_tokens.size[a]), np.cumsum(self.b_tokens.size[b])
        at = np.searchsorted(end_b, end_a)
        last_a = end_b[np.minimum(at, max(0, len(end_b) - 1))] == end_a if len(end_b) else np.zeros(0, bool)
        la, lb = np.flatnonzero(last_a), at[last_a]
        last_b = np.zeros(len(b), bool)
        last_b[lb] = True
        count = np.bincount(of_a[la], minlength=n)
        # groups as text: A's ids of a group, then B's; every id is followed by one sign
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        place_a = np.arange(len(a)) + np.r_[0, lb + 1][group_a]
        place_b = np.arange(len(b)) + (la + 1)[group_b]
        ids, sign, of = (np.zeros(len(a) + len(b), t) for t in (np.int64, np.uint8, np.int64))
        for place, x, last, mark, owner in ((place_a, a, last_a, b"|", of_a), (place_b, b, last_b, b";", of_b)):
            ids[place], sign[place], of[place] = x, np.where(last, mark[0], b","[0]), owner
        text = self.digits.joined(ids)
        ends = np.cumsum(self.digits.size[ids])
        text[ends - 1] = sign
        text, edge = text.tobytes(), np.r_[0, ends][np.searchsorted(of, np.arange(n + 1))].tolist()
        return Chunks(order, whole, np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n), count,
                      a[la] << 32 | b[lb], [text[i:j] for i, j in zip(edge[:-1], edge[1:])])


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a: str, b: str) -> Aligner:
    """One per Python worker."""
    if (a, b) not in _ALIGNERS:
        _ALIGNERS[a, b] = Aligner(a, b)
    return _ALIGNERS[a, b]


ROWS = pa.schema([("shard", pa.int64()), ("part", pa.int32()), ("key", pa.binary()), ("n_a", pa.int64()), ("n_b", pa.int64()),
                  ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
                  ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64()), ("blob", pa.binary())])
_ROWS = ("shard long, part int, key binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
         "a int, b int, n long, blob binary")


def _rows(shard: int, **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.record_batch([pa.array([shard] * n) if f.name == "shard" else pa.array(columns[f.name], f.type) if f.name in columns
                            else pa.nulls(n, f.type) for f in ROWS], schema=ROWS)


def packed(**arrays: np.ndarray) -> bytes:
    """Arrays of numbers as one compressed value, by byte planes."""
    planes = {c: pa.array([np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()], pa.large_binary()) for c, x in arrays.items()}
    schema = pa.schema([pa.field(c, pa.large_binary(), metadata={"type": arrays[c].dtype.str}) for c in planes])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(pa.record_batch(list(planes.values()), schema=schema))
    return sink.getvalue().to_pybytes()


def unpacked(blob: bytes) -> dict[str, np.ndarray]:
    with pa.ipc.open_stream(blob) as stream:
        batch = stream.read_next_batch()
    out = {}
    for field, column in zip(batch.schema, batch.columns):
        kind = np.dtype(field.metadata[b"type"].decode())
        out[field.name] = np.ascontiguousarray(np.frombuffer(column[0].as_buffer(), np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()
    return out


def _sums(values: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Sums of values[edge[i]:edge[i + 1]]."""
    return np.diff(np.r_[0, np.cumsum(values)][edge])


def _shard(name: int, rows: list[tuple[bytes, int]], a: str, b: str) -> Iterator[pa.RecordBatch]:
    """Rows of one shard of distinct texts and their multiplicities."""
    tool = aligner(a, b)
    offsets = np.cumsum([0, *(len(t) + 1 for t, _ in rows)])
    data = np.frombuffer(b" " + b" ".join(t for t, _ in rows), np.uint8)
    space = _spaces(data)
    cut = np.zeros(len(data), bool)
    if tool.cuts:
        cut[1:-1] = (data[1:-1] == 32) & ~space[:-2] & ~space[2:]
    cut[offsets[:-1]] = True
    start = np.flatnonzero(cut)
    chunk = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.r_[start, len(data)].astype(np.int64)), pa.py_buffer(data)])
    chunk = chunk.dictionary_encode()
    known = tool.aligned(chunk.dictionary.to_pylist())
    number = np.empty(len(known.order), np.int32)
    number[known.order] = np.arange(len(number), dtype=np.int32)
    index = number[chunk.indices.to_numpy()]
    edge = np.searchsorted(start, offsets)
    whole = _sums(~known.whole[index], edge) == 0      # every chunk is restored
    n_a, n_b, n_links = (np.where(whole, _sums(x[index], edge), 0) for x in (known.n_a, known.n_b, known.count))
    said, order = known.said, index.tolist()
    digest = [hashlib.sha256(b"".join([said[i] for i in order[p:q]])[:-1]).hexdigest() if w else "" for p, q, w in zip(edge[:-1].tolist(), edge[1:].tolist(), whole.tolist())]
    yield _rows(name, part=np.arange(len(rows), dtype=np.int32), key=[hashlib.sha256(t).digest() for t, _ in rows],
                n_a=n_a, n_b=n_b, n_groups=n_links, n_links=n_links, groups_sha256=digest)
    # pairs of the shard, numbered, with their counts over all copies of its texts
    pair, local = np.unique(known.links, return_inverse=True)
    times = np.zeros(len(known.count), np.int64)
    np.add.at(times, index, np.repeat(np.where(whole, [m for _, m in rows], 0), np.diff(edge)))
    n = np.zeros(len(pair), np.int64)
    np.add.at(n, local, np.repeat(times, known.count))
    yield _rows(name, part=np.arange(len(pair), dtype=np.int32), a=(pair >> 32).astype(np.int32), b=(pair & 0xFFFFFFFF).astype(np.int32), n=n)
    yield _rows(name, blob=[packed(sequence=index, edge=edge.astype(np.int32), whole=whole.astype(np.int8),
                                   links=local.astype(np.int32), count=known.count.astype(np.int32))])


def shards(distinct: DataFrame, a: str, b: str) -> DataFrame:
    """(text, n) -> rows of shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, size, name = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for text, n in zip(batch.column("text").cast(pa.binary()), batch.column("n")):
                held.append((text.as_py(), n.as_py()))
                size += len(held[-1][0]) + 1
                if size >= SHARD:
                    yield from _shard(name, held, a, b)
                    held, size, name = [], 0, name + 1
        if held:
            yield from _shard(name, held, a, b)

    return distinct.mapInArrow(run, _ROWS)


def _measured(rows: pa.Table) -> pa.Table:
    """A shard's rows, its pairs with their figures -> measures of its texts."""
    kind = lambda name: rows.filter(rows.column(name).is_valid()).sort_by("part")
    got = unpacked(rows.column("blob").drop_null()[0].as_py())
    pairs, each = kind("a"), kind("key")
    edge, index = got["edge"].astype(np.int64), got["sequence"]
    links = np.cumsum([0, *got["count"]])
    out = []
    for column in ("best", "n"):
        of_link = pairs.column(column).to_numpy().astype(np.int64)[got["links"]] if len(pairs) else np.zeros(0, np.int64)
        out.append(np.where(got["whole"], _sums(_sums(of_link, links)[index], edge), 0))
    return pa.table([each.column(c) for c in ("key", "n_a", "n_b", "n_groups", "n_links")] + [pa.array(x) for x in out] + [each.column("groups_sha256")],
                    names=["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def pair_counts(rows: DataFrame) -> DataFrame:
    """Rows of shards -> a, b, n (links of all documents), best (1 if no other A
    id is linked with b more often)."""
    total = rows.filter("a is not null").groupBy("a", "b").agg(F.sum("n").alias("n"))
    most = total.groupBy("b").agg(F.max("n").alias("most"))
    return total.join(most, "b").select("a", "b", "n", F.when(F.col("n") == F.col("most"), 1).otherwise(0).alias("best"))


def aligned(documents: DataFrame, a: str = A, b: str = B) -> DataFrame:
    """-> doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256,
    one row per row of documents."""
    docs = texts(documents)
    with Scratch(documents.sparkSession) as scratch:
        distinct = docs.filter("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("n"))
        rows = scratch.keep(shards(distinct, a, b))
        totals = scratch.keep(pair_counts(rows))
        pairs = rows.filter("a is not null").select("shard", "part", "a", "b").join(totals, ["a", "b"]).withColumn("key", F.lit(None).cast("binary"))
        others = rows.filter("a is null").withColumn("best", F.lit(None).cast("int"))
        whole = others.unionByName(pairs, allowMissingColumns=True)
        schema = "key binary, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
        measures = scratch.release(scratch.keep(whole.groupBy("shard").applyInArrow(_measured, schema)))
    own = docs.select("doc_id", F.when(F.col("text") != "", F.unhex(F.sha2("text", 256))).alias("key")).join(measures, "key", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return own.select("doc_id", *zero, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))

"""Operator 2: near duplicates by one-permutation hashing.

One hash function over a document's 5-word shingles fills ``BINS`` bins with
their least values; an empty bin borrows from a bin drawn by a hash of its own
number (optimal densification), so that every bin agrees between two documents
with the probability of their Jaccard similarity.  ``ROWS`` bins make a band;
documents that agree in a band share a bucket.

Rows with the same shingle set are one class from the start.  A bucket of
classes gives star-shaped edges: its members to two centres, never all pairs.
Edges are confirmed on full shingle sets, and components are formed.  Buckets
that still hold several components are open:

1. The member with most confirmed links becomes a centre, in round after round as
   long as that links one member in ``FEW``; a large group of near copies grows together here.
2. Open buckets of at most ``SMALL`` members are compared pair by pair, which is
   at most ``SMALL`` pairs a member.
3. Members of larger open buckets are dealt anew by ``KEYS`` other bands each, and
   only those meet that agree in that band too.  Small ones of these buckets are
   compared pair by pair, larger ones have again centres as in 1, and what is then
   still open, documents that agree in eight bins and more, is compared completely.

Pairs of 2 and 3 are compared on full sets if two screens let them through.  The
first loses nothing: a document's odd sketch has a bit for each of ``ODD`` parts of
the hashes, set if an odd number of its shingles fall there, so two sketches differ
in at most as many bits as the sets differ in shingles, which at similarity 0.75 is a
seventh of both sizes together.  It tells apart what lies little below the threshold,
as in large groups of distant copies, up to some 1,800 shingles a document; for longer ones
there is the second: pairs must agree in ``AGREE`` bins, and at similarity 0.75 the
expected 120 of 160 fall that low with probability 2e-7.

Two documents at similarity 0.75 miss every bucket with probability 0.684^40 =
3e-7; that they meet in large buckets only and in none of the second deal has
probability (1 - 0.316 (1 - 0.684^4))^40 = 1e-5, less above.

Defined results: null, empty or blank text has an empty set and no link; fewer
than five words are one shingle; rows that share a doc_id are one document
(linked); a null doc_id is linked with nothing and kept.  Names of other
columns do not matter: only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, anti, kept, map_batches, semi, texts
from .components import components
from .textarrays import mix, slices, text_buffer, window_hashes, word_arrays

WORDS, PERCENT = 5, 75
BANDS, ROWS = 40, 4
BINS = BANDS * ROWS
SMALL = 32         # members of an open bucket that are compared pair by pair
FEW = 64           # rounds of centres go on while one links a member in so many
KEYS = 4           # bands by which members of a larger one are dealt anew
ODD = 1024         # bits of an odd sketch
AGREE = 92         # bins of ``BINS`` in which a pair must agree to be compared on full sets


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending within each row, and how many a row has."""
    n = len(offsets) - 1
    _, _, row, word = word_arrays(data, offsets)
    h, r = window_hashes(word, row, n, size)
    order = np.argsort(r, kind="stable")
    h, r = h[order], r[order]
    edge = np.searchsorted(r, np.arange(n + 1))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        h[a:b].sort()
    new = np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])][:len(h)]
    return h[new], np.bincount(r[new], minlength=n)


def sketch(h: np.ndarray, count: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One-permutation sketch of every row with shingles (others: zeros)."""
    n, row = len(count), np.repeat(np.arange(len(count)), count)
    bin_ = (((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)
    # hashes ascend within a row, and so do bins: the first of each bin is its least
    first = np.r_[True, (row[1:] != row[:-1]) | (bin_[1:] != bin_[:-1])][:len(h)]
    out, full = np.zeros((n, bins), np.uint64), np.zeros((n, bins), bool)
    out[row[first], bin_[first]], full[row[first], bin_[first]] = h[first], True
    r, i = np.nonzero(~full & (count > 0)[:, None])
    t = 0
    while len(r):
        t += 1
        draw = mix(np.arange(bins, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(t * 0xC2B2AE35 + 1))
        j = (draw % np.uint64(bins)).astype(np.int64)[i]
        hit = full[r, j]
        out[r[hit], i[hit]] = out[r[hit], j[hit]]
        r, i = r[~hit], i[~hit]
    return out


def band_hashes(sk: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(sk), bands))
        part = sk.reshape(len(sk), bands, rows)
        for k in range(rows):
            h = mix(h * np.uint64(0x5851F42D4C957F2D) + part[:, :, k])
    return h


def odd_sketch(h: np.ndarray, count: np.ndarray, bits: int = ODD) -> np.ndarray:
    """Words of 64 bits for every row: a bit tells whether an odd number of the row's shingles has that remainder."""
    at = np.repeat(np.arange(len(count)) * bits, count) + (h % np.uint64(bits)).astype(np.int64)
    odd = np.bincount(at, minlength=len(count) * bits).astype(np.uint8) & 1
    return np.packbits(odd.reshape(-1, bits), axis=1).view(np.int64)


def sketches(documents: DataFrame) -> DataFrame:
    """-> doc_id, n_shingles, k1 and k2 (identity of the set), bands, bins (a byte of each), odd."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_buffer(b.column("text"))
        out = []
        for i, j in slices(offsets):
            h, n = shingle_sets(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
            edge = np.r_[0, np.cumsum(n)]
            with np.errstate(over="ignore"):
                total = [np.r_[np.uint64(0), np.cumsum(mix(h + np.uint64(s)))] for s in (1, 2)]
                keys = [t[edge[1:]] - t[edge[:-1]] for t in total]
            sk = sketch(h, n)
            bands = band_hashes(sk).view(np.int64)
            bands = [x if k else [] for x, k in zip(bands, n)]
            out.append((n, *(k.view(np.int64) for k in keys), bands, list((sk >> np.uint64(20)).astype(np.uint8).view(np.int8)), list(odd_sketch(h, n))))
        n, k1, k2 = (np.concatenate([x[c] for x in out]) for c in range(3))
        return pa.record_batch([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(k1), pa.array(k2),
                                pa.array([x for o in out for x in o[3]], pa.list_(pa.int64())), pa.array([x for o in out for x in o[4]], pa.list_(pa.int8())),
                                pa.array([x for o in out for x in o[5]], pa.list_(pa.int64()))],
                               names=["doc_id", "n_shingles", "k1", "k2", "bands", "bins", "odd"])

    return map_batches(texts(documents), run, "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, bins array<tinyint>, odd array<long>")


def full_sets(documents: DataFrame) -> DataFrame:
    """-> doc_id, shingles (distinct hashes)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_buffer(b.column("text"))
        out = []
        for i, j in slices(offsets):
            h, n = shingle_sets(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
            out += np.split(h.view(np.int64), np.cumsum(n)[:-1])
        return pa.record_batch([b.column("doc_id"), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "shingles"])

    return map_batches(texts(documents), run, "doc_id long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""
    s = lambda x: sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"s{x}"))
    both = pairs.join(s("a"), "a").join(s("b"), "b")
    same = F.size(F.array_intersect("sa", "sb"))
    return (both.select("a", "b", same.alias("i"), (F.size("sa") + F.size("sb")).alias("n"))
            .filter(F.col("i") * 100 >= (F.col("n") - F.col("i")) * percent).select("a", "b"))


def stars(members: DataFrame, centres: DataFrame) -> DataFrame:
    """Edges of every bucket's members to its centres (array ``c`` of doc, comp)
    in other components."""
    e = members.join(centres, "bucket").select("doc", "comp", F.explode("c").alias("c")).filter("comp <> c.comp")
    return e.select(F.least("doc", "c.doc").alias("a"), F.greatest("doc", "c.doc").alias("b")).distinct()


def _described(members: DataFrame, traits: DataFrame) -> DataFrame:
    """Members of buckets (bucket, doc, more) with the ``traits`` of their documents; a
    document meets its traits once, whatever the number of its buckets (``BANDS`` and their second deal at most)."""
    more = [c for c in members.columns if c not in ("bucket", "doc")]
    own = members.groupBy("doc").agg(F.collect_list("bucket").alias("buckets"), *[F.first(c).alias(c) for c in more])
    return own.join(traits, "doc").withColumn("bucket", F.explode("buckets")).drop("buckets")


def _held(members: DataFrame) -> DataFrame:
    """(bucket, doc) -> doc, buckets: at most ``BANDS`` of a document, or those of their second deal."""
    return members.groupBy("doc").agg(F.collect_list("bucket").alias("buckets"))


def _dealt(members: DataFrame, bands: DataFrame) -> DataFrame:
    """Members of buckets (bucket, doc) dealt anew by ``KEYS`` other bands (bands: doc, bands) -> doc, buckets."""

    def anew(bucket):
        # the number of another band, and of the next one where that is the bucket's own
        key = lambda t: F.pmod(F.xxhash64(bucket, t), F.lit(BANDS)).cast("int")
        other = lambda j: F.when(F.get("bands", j) == bucket, F.get("bands", F.pmod(j + 1, F.lit(BANDS)))).otherwise(F.get("bands", j))
        return F.transform(F.transform(F.sequence(F.lit(1), F.lit(KEYS)), key), lambda j: F.xxhash64(bucket, j, other(j)))

    return _held(members).join(bands, "doc").select("doc", F.array_distinct(F.flatten(F.transform("buckets", anew))).alias("buckets"))


def _pairs(members: DataFrame, traits: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs of a bucket's members (bucket, doc, comp) in different components
    whose sketches (traits: doc, n_shingles, bins, odd) may be those of similar sets."""
    members = _described(members.select("bucket", "doc", "comp"), traits)
    other = members.select("bucket", *[F.col(c).alias(f"{c}2") for c in ("doc", "comp", "n_shingles", "bins", "odd")])
    apart = sum((F.bit_count(F.get("odd", F.lit(k)).bitwiseXOR(F.get("odd2", F.lit(k)))) for k in range(ODD // 64)), F.lit(0))
    near = apart * (100 + percent) <= (F.col("n_shingles") + F.col("n_shingles2")) * (100 - percent)
    same = F.size(F.filter(F.zip_with("bins", "bins2", lambda x, y: x == y), lambda z: z))
    on = (members["bucket"] == other["bucket"]) & (F.col("doc") < F.col("doc2")) & (F.col("comp") != F.col("comp2")) & near & (same >= AGREE)
    met = members.join(other, on)
    return met.select(F.col("doc").alias("a"), F.col("doc2").alias("b")).distinct()


class _Search:
    """Confirmed links and components while a corpus is searched; spent tables go."""

    def __init__(self, scratch: Scratch, sets: DataFrame, links: DataFrame):
        self.scratch, self.sets, self.links = scratch, sets, scratch.keep(links)
        self.comp = components(self.links, scratch)
        self.tried: DataFrame | None = None

    def open_(self, held: DataFrame) -> DataFrame:
        """(doc, buckets) -> bucket, doc, comp, size, c (the member with most links) of
        the buckets that hold several components.  A document meets its component and
        its links once, whatever the number of its buckets."""
        degree = self.links.select(F.explode(F.array("a", "b")).alias("doc")).groupBy("doc").agg(F.count(F.lit(1)).alias("links"))
        own = (held.join(self.comp.withColumnRenamed("node", "doc"), "doc", "left").join(degree, "doc", "left")
               .select("doc", F.coalesce("component", "doc").alias("comp"), F.coalesce("links", F.lit(0)).alias("links"), "buckets"))
        at = self.scratch.keep(own.select(F.explode("buckets").alias("bucket"), "doc", "comp", "links"))
        most = F.max(F.struct("links", F.xxhash64("doc").alias("o"), F.struct("doc", "comp").alias("w")))["w"]
        several = (at.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("size"), most.alias("m"))
                   .filter("x <> y").select("bucket", "size", F.array("m").alias("c")))
        out = self.scratch.keep(at.drop("links").join(several, "bucket"))
        self.scratch.drop(at)
        return out

    def look(self, edges: DataFrame) -> int:
        """Confirm edges (a, b) that were not looked at before; how many new links there are."""
        if self.tried is not None:
            edges = edges.join(self.tried, ["a", "b"], "left_anti")
        new = self.scratch.keep(edges)
        fresh = self.scratch.keep(confirmed(new, self.sets).distinct())
        tried = self.scratch.keep(new if self.tried is None else self.tried.unionByName(new))
        self.scratch.drop(new, *([] if self.tried is None else [self.tried]))
        self.tried = tried
        found = fresh.count()
        if found:
            # components of components
            name = self.comp.select(F.col("node").alias("n"), F.col("component").alias("c"))
            pair = (fresh.join(name.toDF("a", "ca"), "a", "left").join(name.toDF("b", "cb"), "b", "left")
                    .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
            up = components(pair, self.scratch)
            every = self.comp.unionByName(up.select("node", F.col("node").alias("component"))).distinct()
            joined = every.join(up.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left")
            links, comp = self.scratch.keep(self.links.unionByName(fresh)), self.scratch.keep(joined.select("node", F.coalesce("top", "component").alias("component")).distinct())
            self.scratch.drop(self.links, self.comp, up)
            self.links, self.comp = links, comp
        self.scratch.drop(fresh)
        return found

    def centred(self, at: DataFrame) -> DataFrame:
        """Rounds of centres over open buckets (of ``open_``); -> what stays open.  Rounds
        end once few links come of one: pairs are compared after them in any case, and each
        takes up all members again."""
        while self.look(stars(at.select("bucket", "doc", "comp"), at.select("bucket", "c").distinct())) * FEW >= at.select("doc").distinct().count() > 0:
            rest = self.open_(_held(at))     # a closed bucket stays closed
            self.scratch.drop(at)
            at = rest
        return at


def near_duplicates(documents: DataFrame) -> DataFrame:
    """-> doc_id, n_shingles, component_id, kept; one row per row of documents."""
    with Scratch(documents.sparkSession) as scratch:
        sk = scratch.keep(sketches(documents))
        linked, key = sk.filter("doc_id is not null and n_shingles > 0"), ["k1", "k2", "n_shingles"]
        # a class is its first document; partial minima take care of large groups of copies
        classes = scratch.keep(linked.groupBy(*key).agg(F.min(F.struct("doc_id", "bands", "bins", "odd")).alias("r"))
                               .select(*key, F.col("r.doc_id").alias("rep"), "r.bands", "r.bins", "r.odd"))
        own = scratch.keep(linked.select("doc_id", *key).join(classes.select("rep", *key), key).select("doc_id", "rep").distinct())
        twice = (own.join(own.groupBy("doc_id").agg(F.min("rep").alias("m")), "doc_id").filter("rep <> m")
                 .select(F.col("m").alias("a"), F.col("rep").alias("b")))
        band = classes.select(F.explode("bands").alias("bucket"), F.col("rep").alias("doc"), F.col("rep").alias("comp"))
        # a bucket of one document is of no use; its two centres are the extremes of a hash
        order, who = F.xxhash64("doc"), F.struct("doc", "comp")
        ranked = F.struct(order.alias("o"), who.alias("w"))
        centres = scratch.keep(band.groupBy("bucket").agg(F.min(ranked)["w"].alias("x"), F.max(ranked)["w"].alias("y"))
                               .filter("x.doc <> y.doc").select("bucket", F.array("x", "y").alias("c")))
        buckets = scratch.keep(band.join(centres.select("bucket"), "bucket").select("bucket", "doc"))
        # of rows that share the id of a class any one whose set is the class's will do
        sets = scratch.keep(full_sets(semi(documents, buckets.select(F.col("doc").alias("doc_id")).distinct(), "doc_id")).filter(F.size("shingles") > 0))
        search = _Search(scratch, sets, twice)
        search.look(stars(buckets.withColumn("comp", F.col("doc")), centres))
        scratch.drop(centres)
        # components are those of the last round: a pair linked since is compared once more at worst
        traits = classes.select(F.col("rep").alias("doc"), "n_shingles", "bins", "odd")
        at = search.centred(search.open_(_held(buckets)))
        if not at.isEmpty():
            search.look(_pairs(at.filter(F.col("size") <= SMALL), traits))
            second = search.open_(_dealt(at.filter(F.col("size") > SMALL), classes.select(F.col("rep").alias("doc"), "bands")))
            scratch.drop(at)
            search.look(_pairs(second.filter(F.col("size") <= SMALL), traits))
            rest = search.centred(scratch.keep(second.filter(F.col("size") > SMALL)))
            scratch.drop(second)
            search.look(_pairs(rest, traits))
        comp = search.comp.select(F.col("node").alias("rep"), "component")
        named = (own.join(comp, "rep", "left").groupBy("doc_id")
                 .agg(F.min(F.coalesce("component", "rep")).alias("component_id")))
        out = sk.select("doc_id", "n_shingles").join(named, "doc_id", "left")
        out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
        out = scratch.keep(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
        return scratch.release(out)


def without_copies(documents: DataFrame) -> DataFrame:
    """``documents``, all columns, with one document of each group: the one
    with the smallest doc_id.  Of rows that share a doc_id one stays, whichever;
    rows without a doc_id all stay."""
    lost = kept(near_duplicates(documents).filter("not kept").select("doc_id").distinct())
    out = anti(documents, lost, "doc_id")
    twice = kept(out.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"))
    return anti(out, twice, "doc_id").unionByName(semi(out, twice, "doc_id").select(out.columns).dropDuplicates(["doc_id"]))

"""Corpus preparation: splits, duplicates, passages (WIN9, AGG2-AGG4, SET1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


RANK_BUCKETS = 1 << 16


def _ranked(df: DataFrame, key: str, seed: int, out: str, total: str | None = None) -> DataFrame:
    digits = F.md5(F.concat(F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    h = df.withColumn("_h", digits).withColumn("_b", F.conv(F.substring("_h", 1, 4), 16, 10).cast("int"))
    # at most RANK_BUCKETS rows, counted with partial aggregates
    counts = h.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    every = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offs = counts.select("_b", (F.sum("_c").over(Window.orderBy("_b")) - F.col("_c")).alias("_o"),
                         F.sum("_c").over(every).alias("_n"))
    local = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)) - 1
    r = (h.withColumn("_l", local).join(F.broadcast(offs), "_b")
         .withColumn(out, (F.col("_o") + F.col("_l")).cast("long")))
    if total is not None:
        r = r.withColumn(total, F.col("_n"))
    return r.drop("_h", "_b", "_l", "_o", "_n")


def rank_by_hash(df: DataFrame, key: str, seed: int = 123, out: str = "rank") -> DataFrame:
    """Global 0-based rank of every row in a seeded permutation.

    The permutation is the order of ``md5(seed || key)``.  Its leading digits
    give one of ``RANK_BUCKETS`` fixed buckets; bucket counts are prefix-summed
    (a bounded table) and rows are numbered inside their bucket.  Nothing
    depends on sampled range bounds or on the partition a row is in.
    """
    return _ranked(df, key, seed, out)


def split_corpus(docs: DataFrame, dev: bool = True, test: bool = True, seed: int = 123,
                 key: str = "doc_id") -> DataFrame:
    """WIN9: exact-size random split: rank < int(.8n) train, next int(.1n)
    dev, rest test; without test int(.9n) / rest; without both all train.
    n is the sum of the bucket counts, so the table is counted once."""
    r, n = _ranked(docs, key, seed, "_rank", "_total"), F.col("_total")
    part = lambda x: F.floor(F.lit(x) * n).cast("long")
    if dev and test:
        a, b = part(0.8), part(0.8) + part(0.1)
    elif dev or test:
        a, b = part(0.9), n
    else:
        a, b = n, n
    second = "dev" if dev else "test"
    return r.withColumn("split", F.when(F.col("_rank") < a, "train")
                        .when(F.col("_rank") < b, second).otherwise("test")).drop("_rank", "_total")


def unique_samples(docs: DataFrame, body: str = "body", key: str = "doc_id") -> DataFrame:
    """AGG2: keep the first document of every group of identical texts.

    Texts are grouped by a 256-bit digest and their length, so no text is
    shuffled as a key; the aggregate is partial (map-side), so a text copied
    millions of times collapses before the shuffle.
    """
    body_ = F.col(body).cast("binary")
    first = (docs.groupBy(F.sha2(body_, 256).alias("_d"), F.octet_length(body_).alias("_n")).agg(F.min(key).alias(key)))
    return docs.join(first.select(key), key, "left_semi")


def dedupe_spans(spans: DataFrame) -> DataFrame:
    """AGG3: at one offset, an annotation whose length equals the last kept
    one's is skipped; then the last kept annotation per offset wins.

    Kept rows are those whose previous annotation at the same offset has a
    different length; the winner is the kept row with the greatest ``ord``.
    """
    w = Window.partitionBy("doc_id", "start").orderBy("ord")
    kept = spans.withColumn("_pl", F.lag("len").over(w)).filter(
        F.col("_pl").isNull() | (F.col("_pl") != F.col("len")))
    best = kept.groupBy("doc_id", "start").agg(F.max_by(F.struct("ord", "len", "type"), "ord").alias("_b"))
    return best.select("doc_id", F.col("_b.ord").alias("ord"), "start", F.col("_b.len").alias("len"),
                       F.col("_b.type").alias("type"))


def pick_passages(passages: DataFrame, how: str = "last") -> DataFrame:
    """AGG4: one passage per document id: the last one (``last``), or every
    passage keyed by (id, passage index) (``all``)."""
    if how == "last":
        g = passages.groupBy("doc_key").agg(F.max_by(F.struct(*[c for c in passages.columns if c != "doc_key"]),
                                                     "passage_idx").alias("_p"))
        return g.select("doc_key", "_p.*")
    if how == "all":
        return passages
    raise ValueError(how)


def concat_corpora(frames: list[DataFrame]) -> DataFrame:
    """SET1: union many annotated corpora (by column name)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def union_corpora(corpora: dict[str, tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """SET1 with documents of their own identity: name -> (docs, spans), as read
    from files (``doc_id`` counts from 0 in each ``file``, if there is one).
    -> docs and spans with ``corpus``, ``file``, ``source_id`` (the old id) and a
    ``doc_id`` that is unique over all of them: corpora in the order of their
    names, their files by path, each behind the ids of those before.  The table of
    files, one row each, is all that is ordered."""
    def named(df: DataFrame, name: str) -> DataFrame:
        file = F.col("file") if "file" in df.columns else F.lit("")
        return df.withColumns({"corpus": F.lit(name), "file": file}).withColumnRenamed("doc_id", "source_id")

    def joined(k: int) -> DataFrame:
        return concat_corpora([named(pair[k], name) for name, pair in sorted(corpora.items())])

    docs, spans = joined(0), joined(1)
    sizes = docs.groupBy("corpus", "file").agg((F.max("source_id") + 1).alias("_n"))
    w = Window.orderBy("corpus", "file").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("corpus", "file", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    keyed = lambda df: df.join(before, ["corpus", "file"]).withColumn("doc_id", F.col("_before") + F.col("source_id")).drop("_before")
    return keyed(docs), keyed(spans)

"""Operator 11: document fingerprints by spot signatures.

A spot is an occurrence of a common word (``ANCHORS``; the beginning of a text
counts as one).  Its signature is the common word and the chain of the next
``CHAIN`` content words, common words skipped; a chain may be shorter at the end
of the text only.  A fingerprint is the sorted set of the signatures' hashes,
so equal texts have equal fingerprints.  Sets are compared by Jaccard.

``links`` is the similarity join: sets are dealt into partitions by their length
so that similar sets lie in one partition or in neighbours, and inside a
partition only sets meet that share one of their rarest signatures; pairs whose
lengths rule the similarity out are pruned before they are compared.

``edits`` holds every document against a copy whose end is overwritten by the
next document.  The next document is found without one global window: ids are
cut into blocks at quantiles that are ids themselves, the first row of a block
visits the block before it as a guest, and ``lead`` runs inside blocks.

Everything is DataFrame functions.  Defined results: null text is empty; a text
without content words has the empty fingerprint; two empty sets are alike (1.0),
an empty and another one not (0.0); null doc_ids come first; rows that share a
doc_id are ordered by text and lie in one block; the only row of a table is its
own next one; an empty table gives no row.  Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import texts

CHAIN = 3
PERCENT = 75
DIGITS = 12        # hex digits of a signature's hash
BLOCKS = 16384     # blocks of ids at most
BUCKET = 1000      # sets of a bucket that one task compares with all others of it

#: Common words of English, French, German and Spanish.
ANCHORS = (
    "a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the "
    "their there they this to was we were which will with would you "
    "au aux avec ce ces cette dans de des du elle en est et il ils la le les leur mais ne nous ou par pas plus pour que qui "
    "se son sont sur un une vous "
    "aber als am auch auf aus bei das dass dem den der die durch ein eine einem einen einer er es haben hat ich ihr im "
    "ist kann man mit nach nicht nur oder sich sie sind so und vom von vor war wie wird wurde zu zum zur "
    "al como con del el ella ellos era esta este ha hay las lo los más muy no o para pero por se ser si sin sobre su sus también una y ya"
).split()

_APART = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"   # after lower-casing: words are ASCII letters, digits and all beyond ASCII


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` computed once, whatever the optimizer inlines."""
    return F.transform(F.array(value), f)[0]


def signatures(text: Column) -> Column:
    """Sorted distinct signature hashes of a text."""
    mark = lambda w: (F.when(w == "", F.lit("")).when(w.isin(*sorted(set(ANCHORS))), F.concat(F.lit("\n"), w))
                      .otherwise(F.concat(F.lit(" "), w)))
    # one item for each content word, with the common words that follow it behind line feeds
    items = F.split(F.concat(F.lit("^\n^"), F.array_join(F.transform(F.split(F.lower(text), _APART), mark), "")), " ")
    both = lambda x, y: F.concat_ws(" ", x, y)

    def chains(c: Column) -> Column:
        after = lambda k: F.slice(c, k + 1, F.size(c))
        chain = after(1)
        for k in range(2, CHAIN + 1):
            chain = F.zip_with(chain, after(k), both)
        return chain

    def spots(item: Column, chain: Column) -> Column:
        hashed = lambda a: F.substring(F.md5(F.concat(a, F.lit(" "), chain)), 1, DIGITS)
        anchors = F.split(F.substring(item, F.instr(item, "\n") + 1, F.length(item)), "\n")
        return F.when((F.instr(item, "\n") > 0) & (F.coalesce(chain, F.lit("")) != ""), F.transform(anchors, hashed)).otherwise(F.array().cast("array<string>"))

    found = _let(items, lambda it: F.flatten(F.zip_with(it, chains(F.transform(it, lambda x: F.substring_index(x, "\n", 1))), spots)))
    return F.sort_array(F.array_distinct(found))


def likeness(a: Column, b: Column, percent: int = 0) -> Column:
    """Jaccard similarity of two sets; 0 without a comparison where their
    lengths alone rule out ``percent``."""
    common = F.size(F.array_intersect(a, b))
    exact = _let(common, lambda i: i / (F.size(a) + F.size(b) - i))
    return (F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
            .when(F.least(F.size(a), F.size(b)) * 100 < F.greatest(F.size(a), F.size(b)) * percent, F.lit(0.0)).otherwise(exact))


def fingerprints(documents: DataFrame) -> DataFrame:
    """-> doc_id, signatures (array), fingerprint (string)."""
    out = texts(documents).select("doc_id", signatures(F.col("text")).alias("signatures"))
    return out.withColumn("fingerprint", F.array_join("signatures", " "))


def _blocks(rows: DataFrame) -> list[int]:
    """Ids at which blocks begin: quantiles of ``key``, the least one first.  As
    many as four times the shuffle partitions, ``BLOCKS`` at most."""
    n = min(BLOCKS, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    got = rows.agg(F.min("key").alias("least"), F.percentile_approx("key", [i / n for i in range(n)], max(10_000, 8 * n)).alias("q")).first()
    return [] if got.least is None else sorted({got.least, *got.q})


def _order():
    return Window.partitionBy("block").orderBy("guest", "key", "text")


def with_next(documents: DataFrame) -> DataFrame:
    """-> doc_id, text, next (text of the next document), block, guest, key; also
    the guests, whose ``next`` means nothing: ``guest = 0`` are the documents.
    Rows are dealt by block and sorted by guest, key, text."""
    rows = texts(documents).withColumn("key", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    bounds = _blocks(rows) or [0]
    starts = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    # the last block that begins at or below the key, by halving
    block = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(starts, at + step) <= F.col("key"), at + step).otherwise(at))
    rows = rows.withColumn("own", block)
    before = F.pmod(F.col("own") - 1, F.lit(len(bounds)))
    place = lambda b, guest: F.struct(b.alias("block"), F.lit(guest).alias("guest"))
    places = F.when(F.get(starts, F.col("own")) == F.col("key"), F.array(place(F.col("own"), 0), place(before, 1))).otherwise(F.array(place(F.col("own"), 0)))
    rows = rows.select("doc_id", "key", "text", F.explode_outer(places).alias("p")).select("doc_id", "key", "text", "p.block", "p.guest")
    return rows.withColumn("next", F.lead("text").over(_order()))


def edits(documents: DataFrame) -> DataFrame:
    """-> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    rows = with_next(documents).withColumn("edited", F.concat(F.left("text", n - cut), F.left("next", cut)))
    rows = rows.select("*", signatures(F.col("text")).alias("a"), signatures(F.col("edited")).alias("b"))
    rows = rows.withColumn("c", F.lead("a").over(_order())).filter("guest = 0")
    return rows.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                       F.array_join("a", " ").alias("fingerprint"), F.array_join("b", " ").alias("edited_fingerprint"),
                       likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"))


def links(documents: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Similarity join: pairs (a, b, common, total) of classes whose sets have at
    least ``percent`` of their union in common, and members (doc_id, class).  A
    class is one non-empty fingerprint, named by its smallest doc_id; documents
    with the empty one, or without a doc_id, are linked with nothing."""
    prints = fingerprints(documents).filter(F.col("doc_id").isNotNull() & (F.size("signatures") > 0))
    classes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("class"))
    members = prints.join(classes, "fingerprint").select("doc_id", "class").distinct()
    sets = classes.select("class", F.split("fingerprint", " ").alias("s"))
    each = sets.select("class", F.explode("s").alias("g"))
    rarest = F.sort_array(F.collect_list(F.struct("n", "g")))   # a class holds one document's signatures
    ranked = (each.join(each.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "g").groupBy("class").agg(rarest.alias("s"))
              .withColumn("size", F.size("s")))
    # two sets that are alike share a signature among the rarest size - least common + 1
    prefix = F.slice("s", F.lit(1), (F.col("size") - F.ceil(F.col("size") * percent / 100) + 1).cast("int"))
    part = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(100 / percent))) if percent < 100 else F.col("size")
    near = ranked.select("class", "size", part.cast("long").alias("part"), F.explode(F.transform(prefix, lambda x: x["g"])).alias("g"))
    # the longer set meets sets of its own part and of the one below
    longer = near.select("g", "part", F.col("class").alias("x"), F.col("size").alias("nx"))
    shorter = near.select("g", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"), F.col("class").alias("y"), F.col("size").alias("ny"))
    salts = longer.groupBy("g", "part").agg(F.ceil(F.count(F.lit(1)) / BUCKET).alias("salts"))
    longer = longer.join(salts, ["g", "part"]).withColumn("salt", F.pmod(F.xxhash64("x"), F.col("salts")))
    shorter = shorter.join(salts, ["g", "part"]).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    met = (longer.join(shorter, ["g", "part", "salt"]).filter((F.col("ny") * 100 >= F.col("nx") * percent))
           .filter((F.col("ny") < F.col("nx")) | (F.col("ny") == F.col("nx")) & (F.col("x") < F.col("y")))
           .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    side = lambda c: sets.select(F.col("class").alias(c), F.col("s").alias(f"s{c}"))
    pairs = (met.join(side("a"), "a").join(side("b"), "b")
             .select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("common"), (F.size("sa") + F.size("sb")).alias("n")))
    pairs = pairs.select("a", "b", F.col("common").cast("long").alias("common"), (F.col("n") - F.col("common")).cast("long").alias("total"))
    return pairs.filter(F.col("common") * 100 >= F.col("total") * percent), members

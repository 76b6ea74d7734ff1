"""Tag schemes on per-sequence tag arrays (WIN1-WIN3, FN4, FN7, WIN7, AGG1).

A sequence is one row holding ``array<string>``; neighbours are read by
index inside ``transform`` so every rule is linear and shuffle-free.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _prefix(t) -> Column:
    return F.split_part(t, F.lit("-"), F.lit(1))


def tag_type(t) -> Column:
    """Type of a tag: the text after the first hyphen ('' when there is none)."""
    t = _c(t)
    return F.when(F.instr(t, "-") > 0,
                  F.substring(t, F.instr(t, "-") + 1, F.lit(1 << 30))).otherwise(F.lit(""))


def to_iobes(tags) -> Column:
    """WIN1: IOB -> IOBES. ``B`` followed by ``I`` (any type) stays, else
    ``S``; ``I`` followed by ``I`` stays, else ``E``; any other prefix
    raises."""
    t = _c(tags)
    nxt_is_i = lambda i: (i + 1 < F.size(t)) & (_prefix(t[i + 1]) == "I")
    return F.transform(t, lambda x, i: F.when(x == "O", x)
                       .when(_prefix(x) == "B", F.when(nxt_is_i(i), x).otherwise(
                           F.concat(F.lit("S-"), F.substring(x, 3, 1 << 30))))
                       .when(_prefix(x) == "I", F.when(nxt_is_i(i), x).otherwise(
                           F.concat(F.lit("E-"), F.substring(x, 3, 1 << 30))))
                       .otherwise(F.raise_error(F.concat(F.lit("Invalid IOB format: "), x))))


def to_iob(tags) -> Column:
    """FN4: IOBES -> IOB (``S-`` -> ``B-``, ``E-`` -> ``I-``), anchored."""
    return F.transform(_c(tags), lambda x: F.regexp_replace(F.regexp_replace(x, "^S-", "B-"), "^E-", "I-"))


def iob2_valid(tags) -> Column:
    """WIN2 validity: every tag is ``O`` or ``I-x`` / ``B-x`` with exactly one hyphen."""
    return F.forall(_c(tags), lambda x: x.rlike("^(O|[IB]-[^-]*)$"))


def to_iob2(tags) -> Column:
    """WIN2: IOB1 -> IOB2. ``I-x`` at the start, after ``O`` or after a
    different type becomes ``B-x`` (null when the sequence is invalid).

    Rewriting happens in place, so "previous" means the already rewritten
    tag; only the prefix changes, and the comparison looks at the
    text after the first character, so using the original neighbour is the
    same.
    """
    t = _c(tags)
    conv = F.transform(t, lambda x, i: F.when(
        (_prefix(x) == "I") & ((i == 0) | (t[i - 1] == "O") |
                               (F.substring(t[i - 1], 2, 1 << 30) != F.substring(x, 2, 1 << 30))),
        F.concat(F.lit("B"), F.substring(x, 2, 1 << 30))).otherwise(x))
    return F.when(iob2_valid(t), conv)


def _markers(t) -> Column:
    n = F.size(t)
    bnd = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (t[i] == "O") | t[i].startswith("B-"))
    return F.when(n > 0, bnd).otherwise(F.array().cast("array<int>"))


def with_spans(df: DataFrame, tags: str = "tags", out: str = "spans", stray: str = "error") -> DataFrame:
    """WIN3: IOB tags -> spans (gaps and islands inside the array).

    A span opens at ``B-x`` and runs until the next ``B-`` or ``O``; the type
    of ``I-`` tags is not checked.  A segment that starts with ``I-`` (at the
    start or after ``O``) is a stray: ``error`` raises, ``begin`` opens a span
    of the ``I-`` tag's type, ``ignore`` drops it.  Linear: the marker
    positions (``O`` / ``B-``) are materialised once, each segment ends at
    the next marker.
    """
    if stray not in ("error", "begin", "ignore"):
        raise ValueError(stray)
    t = F.col(tags)
    n = F.size(t)
    d = df.withColumn("_bnd", _markers(t))
    bnd = F.col("_bnd")
    nxt = lambda j: F.when(j + 1 < F.size(bnd), bnd[j + 1]).otherwise(n)
    typ = lambda x: F.substring(x, 3, 1 << 30)
    span = lambda s, e, ty, kind: F.struct(s.cast("int").alias("start"), (e - s).cast("int").alias("len"),
                                           ty.alias("type"), F.lit(kind).alias("kind"))
    first = F.when(F.size(bnd) > 0, bnd[0]).otherwise(n)
    lead = F.when((n > 0) & (first > 0), F.array(span(F.lit(0), first, typ(t[0]), "stray")))
    inner = F.transform(bnd, lambda b, j: F.when(
        t[b].startswith("B-"), span(b, nxt(j), typ(t[b]), "span"))
        .when(b + 1 < nxt(j), span(b + 1, nxt(j), typ(t[b + 1]), "stray")))
    allsp = F.filter(F.concat(F.coalesce(lead, F.array().cast(
        "array<struct<start:int,len:int,type:string,kind:string>>")), inner), lambda s: s.isNotNull())
    if stray == "ignore":
        allsp = F.filter(allsp, lambda s: s["kind"] == "span")
    elif stray == "error":
        allsp = F.transform(allsp, lambda s: F.when(s["kind"] == "span", s).otherwise(
            F.raise_error(F.concat(F.lit("stray I- tag at byte "), s["start"].cast("string")))))
    res = F.transform(allsp, lambda s: F.struct(s["start"].alias("start"), s["len"].alias("len"),
                                                s["type"].alias("type")))
    return d.withColumn(out, res).drop("_bnd")


# ---------------------------------------------------------------- vocabularies

def collect_tags(spans: DataFrame) -> DataFrame:
    """AGG1: distinct types in order of first appearance (doc_id, ord).

    Output ``type, idx`` (idx from 0).  The type set is small; the
    aggregate is partial (map-side) before its shuffle.
    """
    first = spans.groupBy("type").agg(F.min(F.struct("doc_id", "ord")).alias("_f"))
    w = Window.orderBy("_f")   # over distinct types only: bounded by the tag set
    return first.select("type", (F.row_number().over(w) - 1).alias("idx"))


def tag_vocab(types: DataFrame, prefixes: str = "BIES") -> DataFrame:
    """FN7: ``O``=0, then for each type (in ``idx`` order) B, I, E, S."""
    pre = list(prefixes)
    rows = types.select("type", "idx", F.posexplode(F.array(*[F.lit(x) for x in pre])).alias("k", "p")).select(
        F.concat(F.col("p"), F.lit("-"), F.col("type")).alias("tag"),
        (F.col("idx") * len(pre) + F.col("k") + 1).cast("int").alias("id"))
    o = types.sparkSession.createDataFrame([("O", 0)], "tag string, id int")
    return o.unionByName(rows)


def dense_ids(df: DataFrame, order_cols, start: int = 0, name: str = "id") -> DataFrame:
    """WIN7: dense ids in a stated order (for small vocabulary tables)."""
    w = Window.orderBy(*order_cols)
    return df.withColumn(name, (F.row_number().over(w) - 1 + start).cast("int"))


def lookup(df: DataFrame, vocab: DataFrame, col: str, key: str = "tag", value: str = "id", out: str = "id") -> DataFrame:
    """JN4: symbol -> id by a join with a vocabulary table; a symbol that the
    vocabulary lacks raises (in the column itself, so no projection drops it)."""
    v = vocab.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    j = df.join(v, df[col] == v["_k"], "left")
    missing = F.raise_error(F.concat(F.lit("not in the vocabulary: "), F.coalesce(F.col(col).cast("string"), F.lit("null"))))
    return j.withColumn(out, F.coalesce("_v", missing.cast(vocab.schema[value].dataType))).drop("_k", "_v")


def tag_ids(tags, vocab: dict) -> Column:
    """JN4 for tag sequences: tag -> id via a literal map; unknown raises."""
    m = F.create_map(*[x for k, v in vocab.items() for x in (F.lit(k), F.lit(v))])
    return F.transform(_c(tags), lambda x: F.coalesce(
        m[x], F.raise_error(F.concat(F.lit("unknown tag "), x)).cast("int")))

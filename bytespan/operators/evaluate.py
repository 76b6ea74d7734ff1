"""Chunk-level scoring (WIN4, JN11, AGG5-AGG9, SET2, SET3, SRT4).

Chunks follow the CoNLL scorer's start/end rules on (previous tag, tag,
previous type, type).  A chunk opens where the start rule fires and runs
until the next position where the end or start rule fires.  Correct chunks
are exact (doc, start, len, type) matches of the two sides, which equals the
scorer's running ``inCorrect`` state machine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The scorer's sentence boundary marker.
BOUNDARY = "-X-"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_tag(t):
    """(prefix, type): text before / after the first hyphen, or (tag, '')."""
    has = F.instr(t, "-") > 0
    pre = F.when(has, F.substring_index(t, "-", 1)).otherwise(t)
    typ = F.when(has, F.substring(t, F.instr(t, "-") + 1, F.lit(1 << 30))).otherwise(F.lit(""))
    return pre, typ


def normalize_tag(t, o_tag: str = "O", raw: bool = False) -> Column:
    """Scorer input options: alternative outside tag and raw tags (every
    non-O tag gets a ``B-`` prefix)."""
    t = _c(t)
    t = F.when(t == o_tag, F.lit("O")).otherwise(t)
    if raw:
        t = F.when(t == "O", t).otherwise(F.concat(F.lit("B-"), t))
    return t


def chunk_start(pp, p, pt, ty) -> Column:
    pairs = [("B", "B"), ("I", "B"), ("O", "B"), ("E", "E"), ("E", "I"), ("O", "E"), ("O", "I")]
    c = F.lit(False)
    for a, b in pairs:
        c = c | ((pp == a) & (p == b))
    c = c | ((p != "O") & (p != ".") & (pt != ty))
    return c | (p == "[") | (p == "]")


def chunk_end(pp, p, pt, ty) -> Column:
    pairs = [("B", "B"), ("B", "O"), ("I", "B"), ("I", "O"), ("E", "E"), ("E", "I"), ("E", "O")]
    c = F.lit(False)
    for a, b in pairs:
        c = c | ((pp == a) & (p == b))
    c = c | ((pp != "O") & (pp != ".") & (pt != ty))
    return c | (pp == "]") | (pp == "[")


def with_chunks(df: DataFrame, tags: str, out: str = "chunks") -> DataFrame:
    """WIN4 on one sequence per row: ``array<struct<start,len,type>>``.

    Neither rule can fire between two ``O`` tags, so the rules are evaluated
    only at candidate positions (a non-``O`` tag or the one after it) --
    usually a small fraction of the bytes.  Break positions (start or end
    rule fires) are materialised once; a chunk opened at a start runs to the
    next break.
    """
    t = F.col(tags)
    n = F.size(t)
    d = df.withColumn("_cand", F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: (i < n) & (
        (t[i] != "O") | ((i > 0) & (t[F.greatest(i - 1, F.lit(0))] != "O")))))

    def flags(i):
        prev = F.when(i > 0, t[F.greatest(i - 1, F.lit(0))]).otherwise(F.lit("O"))
        pp, pt = split_tag(prev)
        p, ty = split_tag(t[i])
        return chunk_start(pp, p, pt, ty), chunk_end(pp, p, pt, ty), ty

    def rules(i):   # both rules once per candidate
        s, e, ty = flags(i)
        return F.struct(i.alias("i"), s.alias("s"), e.alias("e"), ty.alias("ty"))

    d = d.withColumn("_br", F.filter(F.transform(F.col("_cand"), rules), lambda x: x["s"] | x["e"]))
    b_ = F.col("_br")
    nxt = lambda j: F.when(j + 1 < F.size(b_), b_[j + 1]["i"]).otherwise(n)
    out_c = F.transform(b_, lambda b, j: F.when(
        b["s"], F.struct(b["i"].cast("int").alias("start"), (nxt(j) - b["i"]).cast("int").alias("len"),
                         b["ty"].alias("type"))))
    return d.withColumn(out, F.filter(out_c, lambda s: s.isNotNull())).drop("_cand", "_br")


def chunk_rows(df: DataFrame, tags: str, keys=("doc_id",)) -> DataFrame:
    """Chunks of a tag-array column as long rows (keys..., start, len, type)."""
    return (with_chunks(df.select(*keys, tags), tags, "_ch")
            .select(*keys, F.explode_outer("_ch").alias("_c"))
            .filter(F.col("_c").isNotNull())
            .select(*keys, "_c.start", "_c.len", "_c.type"))


def match_chunks(gold: DataFrame, pred: DataFrame, keys=("doc_id",)) -> DataFrame:
    """JN11: per type the gold, predicted and correct chunk counts.

    ``gold``/``pred`` are long chunk rows (keys, start, len, type).  Correct
    = exact match, an equi-join on (keys, start, len, type); each side is
    pre-aggregated per type before the final (tiny) shuffle.
    """
    k = list(keys) + ["start", "len", "type"]
    g = gold.select(*k).withColumn("_g", F.lit(1))
    p = pred.select(*k).withColumn("_p", F.lit(1))
    j = g.join(p, k, "full_outer")
    return (j.groupBy("type").agg(
        F.count("_g").alias("n_gold"), F.count("_p").alias("n_pred"),
        F.count(F.when(F.col("_g").isNotNull() & F.col("_p").isNotNull(), 1)).alias("n_correct")))


def _prf(correct, found_pred, found_gold):
    prec = F.when(found_pred > 0, 100.0 * correct / found_pred).otherwise(F.lit(0.0))
    rec = F.when(found_gold > 0, 100.0 * correct / found_gold).otherwise(F.lit(0.0))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    return prec, rec, f1


def chunk_scores(counts: DataFrame, digits: int | None = None) -> DataFrame:
    """AGG5 + AGG6 as one ``rollup(type)``: per type and overall (type null)
    precision, recall and F1 (0 when undefined)."""
    r = counts.rollup("type").agg(F.sum("n_gold").alias("n_gold"), F.sum("n_pred").alias("n_pred"),
                                  F.sum("n_correct").alias("n_correct"))
    prec, rec, f1 = _prf(F.col("n_correct"), F.col("n_pred"), F.col("n_gold"))
    if digits is not None:
        prec, rec, f1 = F.round(prec, digits), F.round(rec, digits), F.round(f1, digits)
    return r.select("type", F.col("n_gold").cast("long").alias("n_gold"),
                    F.col("n_pred").cast("long").alias("n_pred"),
                    F.col("n_correct").cast("long").alias("n_correct"),
                    prec.alias("precision"), rec.alias("recall"), f1.alias("f1"))


def overall_scores(counts: DataFrame, digits: int | None = None) -> DataFrame:
    """AGG5: overall chunk precision / recall / F1."""
    return chunk_scores(counts, digits).filter(F.col("type").isNull()).drop("type")


def scores_by_type(counts: DataFrame, digits: int | None = None) -> DataFrame:
    """AGG6: per type; types = gold union predicted, sorted by name."""
    return chunk_scores(counts, digits).filter(F.col("type").isNotNull()).orderBy("type")


def join_gold_pred(gold: DataFrame, pred: DataFrame, keys=("doc_id", "pos"), tag: str = "tag") -> DataFrame:
    """JN8: position rows of two taggings side by side.  A position that one
    side lacks raises; rows without a tag stay boundaries on both sides."""
    g, p = gold.select(*keys, F.col(tag).alias("_g"), F.lit(True).alias("_in_g")), pred.select(*keys, F.col(tag).alias("_p"), F.lit(True).alias("_in_p"))
    j = g.join(p, list(keys), "full_outer")
    fail = F.raise_error(F.lit("gold and predicted positions differ")).cast("string")
    both = F.col("_in_g").isNotNull() & F.col("_in_p").isNotNull()
    return j.select(*keys, F.when(both, F.coalesce("_g", F.lit(BOUNDARY))).otherwise(fail).alias("gold"),
                    F.when(both, F.coalesce("_p", F.lit(BOUNDARY))).otherwise(fail).alias("pred"))


def join_gold_pred_docs(gold: DataFrame, pred: DataFrame, keys=("doc_id",), tags: str = "tags", pos: str = "pos", runs: str | None = None, n: str = "n_doc") -> DataFrame:
    """JN8 from a row of tags for each document: documents are joined, positions
    are made behind the join.  The rows, and what raises, are ``join_gold_pred``'s.
    ``runs``: the column that holds the tags as runs over ``n`` positions; tags are
    made of them behind the join as well, so a document is shuffled by its runs."""
    none = F.array().cast("array<string>")

    def side(df: DataFrame, t: str, size: str) -> DataFrame:
        if runs:
            own = F.when(F.size(runs) > 0, F.col(n)).otherwise(F.lit(0))
            d = df.select(*keys, F.col(runs).alias(t), F.coalesce(own, F.lit(0)).alias(f"{t}n"))
            return d.withColumn(size, F.max(f"{t}n").over(Window.partitionBy(*keys)))
        d = df.select(*keys, F.coalesce(F.col(tags), none).alias(t))
        return d.withColumn(size, F.max(F.size(t)).over(Window.partitionBy(*keys)))

    j = side(gold, "_g", "_n").join(side(pred, "_p", "_m"), list(keys), "full_outer")
    if runs:
        from .runs import to_tags
        # an outer join between the runs and their tags, so no tags are made below it
        j = j.select(*keys, "_n", "_m", to_tags("_g", "_gn").alias("_g"), to_tags("_p", "_pn").alias("_p"))
    checked = F.when(F.coalesce("_n", F.lit(0)) == F.coalesce("_m", F.lit(0)), F.coalesce("_g", none)).otherwise(
        F.raise_error(F.lit("gold and predicted positions differ")).cast("array<string>"))
    z = F.zip_with(checked, F.coalesce("_p", none), lambda g, p: F.struct(
        F.coalesce(g, F.lit(BOUNDARY)).alias("gold"), F.coalesce(p, F.lit(BOUNDARY)).alias("pred")))
    both = F.slice(z, F.lit(1), F.least(F.coalesce(F.size("_g"), F.lit(0)), F.coalesce(F.size("_p"), F.lit(0))))
    return (j.select(*keys, F.posexplode_outer(both).alias(pos, "_z")).filter(F.col("_z").isNotNull())
            .select(*keys, pos, "_z.gold", "_z.pred"))


def pair_segments(df: DataFrame, gold: str = "gold", pred: str = "pred", keys=("doc_id",)) -> DataFrame:
    """Runs of equal (gold, pred) of a row as rows with their length ``n``: what
    the token scores need, without a row per byte."""
    g, p = F.col(gold), F.col(pred)
    size = F.greatest(F.size(g), F.size(p))
    at = F.slice(F.sequence(F.lit(0), F.greatest(size, F.lit(1)) - 1), F.lit(1), size)
    same = lambda a, i: F.get(a, i).eqNullSafe(F.get(a, i - 1))
    heads = F.filter(at, lambda i: (i == 0) | ~(same(g, i) & same(p, i)))
    d = df.select(*keys, g.alias("_g"), p.alias("_p"), size.alias("_n"), heads.alias("_h"))
    h = F.col("_h")
    seg = F.transform(h, lambda i, k: F.struct(
        F.get(F.col("_g"), i).alias("gold"), F.get(F.col("_p"), i).alias("pred"),
        (F.coalesce(F.get(h, k + 1), F.col("_n")) - i).cast("long").alias("n")))
    return d.select(*keys, F.inline_outer(seg)).filter(F.col("n").isNotNull())


def position_pairs(df: DataFrame, gold: str = "gold", pred: str = "pred", keys=("doc_id",)) -> DataFrame:
    """Per-position (gold, pred) rows from two tag arrays of a row."""
    return (df.select(*keys, F.posexplode_outer(F.arrays_zip(F.col(gold).alias("g"), F.col(pred).alias("p")))
                      .alias("pos", "_z"))
            .filter(F.col("_z").isNotNull())
            .select(*keys, "pos", F.col("_z.g").alias("gold"), F.col("_z.p").alias("pred")))


def token_accuracy(pairs: DataFrame) -> DataFrame:
    """AGG7: fraction of positions whose tags are equal (boundaries excluded),
    from position pairs or segments."""
    n = _weight(pairs)
    total, equal = F.sum(n), F.sum(F.when(F.col("gold") == F.col("pred"), n).otherwise(0))
    return pairs.filter(F.col("gold") != BOUNDARY).agg(
        F.coalesce(total, F.lit(0)).cast("long").alias("n_tokens"), equal.cast("long").alias("n_equal"),
        (100.0 * equal / total).alias("accuracy"))


def _weight(pairs: DataFrame) -> Column:
    """Positions a row stands for: ``n`` of ``pair_segments``, else one."""
    return F.col("n") if "n" in pairs.columns else F.lit(1).cast("long")


def confusion(pairs: DataFrame, wide: bool = False, labels: list[str] | None = None) -> DataFrame:
    """AGG8: count[gold, pred] with row totals and row percent
    ``100 * diag / max(1, row)``; ``wide`` pivots pred into columns."""
    c = pairs.groupBy("gold", "pred").agg(F.sum(_weight(pairs)).alias("n"))
    if wide:
        return c.groupBy("gold").pivot("pred", labels).agg(F.sum("n")).na.fill(0)
    return c


def confusion_rows(counts: DataFrame) -> DataFrame:
    """Row totals and row percent of a long confusion table."""
    return counts.groupBy("gold").agg(
        F.sum("n").alias("row_total"),
        F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)).alias("diag")
    ).select("gold", F.col("row_total").cast("long").alias("row_total"),
             F.col("diag").cast("long").alias("diag"),
             (100.0 * F.col("diag") / F.greatest(F.lit(1), F.col("row_total"))).alias("row_pct"))


def global_accuracy(counts: DataFrame) -> DataFrame:
    """AGG9: trace / total of a confusion table."""
    return counts.agg((F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0))
                       / F.sum("n")).alias("accuracy"))


def all_types(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """SET2: union of gold and predicted type sets."""
    return gold.select("type").union(pred.select("type")).distinct()


def type_names(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """SRT4: type names ascending, duplicates removed."""
    return all_types(gold, pred).orderBy("type")


def chunk_diff(gold: DataFrame, pred: DataFrame, keys=("doc_id",)):
    """SET3: (correct, missed, spurious) chunk sets, all from one count of the
    chunks of either side, whose shuffle a query that uses several shares."""
    k = list(keys) + ["start", "len", "type"]
    one = lambda df, g, p: df.select(*k, F.lit(g).cast("long").alias("_g"), F.lit(p).cast("long").alias("_p"))
    n = one(gold, 1, 0).unionByName(one(pred, 0, 1)).groupBy(*k).agg(F.sum("_g").alias("_g"), F.sum("_p").alias("_p"))
    more = lambda a, b: (n.filter(F.col(a) > F.col(b))
                         .select(*k, F.explode(F.array_repeat(F.lit(0), (F.col(a) - F.col(b)).cast("int")))).select(*k))
    return n.filter((F.col("_g") > 0) & (F.col("_p") > 0)).select(*k), more("_g", "_p"), more("_p", "_g")

"""Tag sequences by their runs (TAG1, WIN1-WIN5, FN4, AGG7, AGG8 without a value per byte).

A sequence of ``n`` tags is ``array<struct<at:int,tag:string>>``: where each run
begins, from 0 on; a run ends where the next one begins, the last one at ``n``.
Neighbouring runs may have the same tag.  Rules look at runs and their borders,
so a document costs as much as it has spans, not bytes.  Every function takes
columns and is linear in the runs (``merged`` and ``segments`` sort them).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import evaluate as ev
from . import spans as sp
from . import windows as wn

RUNS = "array<struct<at:int,tag:string>>"
SPANS = "array<struct<start:int,len:int,type:string>>"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)``, with ``value`` computed once whatever the optimizer inlines."""
    return F.transform(F.array(value), f)[0]


def _run(at, tag) -> Column:
    return F.struct(_c(at).cast("int").alias("at"), _c(tag).alias("tag"))


def _end(runs: Column, i: Column, n: Column) -> Column:
    return F.coalesce(F.get(runs, i + 1)["at"], n)


def _is(tag: Column, *prefixes: str) -> Column:
    """The tag's text before its first hyphen is one of ``prefixes``."""
    return F.substring_index(tag, "-", 1).isin(*prefixes)


def _retag(prefix: str, tag: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(tag, 2, 1 << 30))


def _type(tag: Column) -> Column:
    return F.substring(tag, 3, 1 << 30)


def _none(kind: str = RUNS) -> Column:
    return F.array().cast(kind)


# ------------------------------------------------------------------ to and from other forms

def from_spans(spans, n) -> Column:
    """TAG1: sorted, disjoint spans -> runs of ``O``, ``B-x``, ``I-x`` over n
    positions; what lies past n is cut (``violations`` reports it)."""
    n = _c(n).cast("int")

    def made(s: Column) -> Column:
        before = lambda i: F.coalesce(F.get(s, i - 1)["start"] + F.get(s, i - 1)["len"], F.lit(0))
        own = lambda x, i: F.concat(
            F.when(before(i) < x["start"], F.array(_run(before(i), F.lit("O")))).otherwise(_none()),
            F.array(_run(x["start"], F.concat(F.lit("B-"), x["type"]))),
            F.when(x["len"] > 1, F.array(_run(x["start"] + 1, F.concat(F.lit("I-"), x["type"])))).otherwise(_none()))
        last = before(F.size(s))
        rest = F.when(last < n, F.array(_run(last, F.lit("O")))).otherwise(_none())
        return F.concat(F.flatten(F.transform(s, own)), rest)

    return F.filter(_let(F.coalesce(_c(spans), _none(SPANS)), made), lambda r: r["at"] < n)


def from_tags(tags) -> Column:
    """A tag for each position -> runs."""
    def made(t: Column) -> Column:
        heads = F.filter(F.transform(t, lambda x, i: F.when((i == 0) | (F.get(t, i - 1) != x), _run(i, x))), lambda r: r.isNotNull())
        return F.when(F.size(t) > 0, heads).otherwise(_none())

    return _let(_c(tags), made)


def to_tags(runs, n) -> Column:
    """Runs -> a tag for each position."""
    n = _c(n).cast("int")
    return _let(_c(runs), lambda r: F.flatten(F.transform(r, lambda x, i: F.array_repeat(x["tag"], _end(r, i, n) - x["at"]))))


def tag_ids(runs, n, vocab: dict[str, int]) -> Column:
    """``to_tags`` as ids by ``vocab``, made by batch; an unknown tag raises."""
    names, numbers = pa.array(list(vocab), pa.string()), np.array([*vocab.values(), -1], np.int32)

    @F.arrow_udf("array<int>")
    def ids(r: pa.Array, n: pa.Array) -> pa.Array:
        size = r.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, upto = r.flatten(), np.cumsum(size)
        at, tag = flat.field("at").to_numpy(zero_copy_only=False).astype(np.int64), flat.field("tag")
        which = pc.index_in(tag, value_set=names)
        if which.null_count:
            raise ValueError(f"unknown tag {tag.filter(which.is_null())[0]}")
        end = np.empty(len(at), np.int64)
        end[:-1] = at[1:]
        some = size > 0
        end[upto[some] - 1] = n.fill_null(0).to_numpy(zero_copy_only=False)[some]
        many = np.maximum(0, end - at)
        whole = np.r_[0, np.cumsum(many)]
        offsets = whole[np.r_[0, upto]].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.repeat(numbers[which.to_numpy(zero_copy_only=False)], many)))

    return ids(_c(runs), _c(n).cast("int"))


# ------------------------------------------------------------------ schemes

def to_iobes(runs, n) -> Column:
    """WIN1: ``B`` stays if an ``I`` follows, else ``S``; ``I`` stays if an ``I``
    follows, else ``E``; any other prefix raises."""
    n = _c(n).cast("int")

    def made(r: Column) -> Column:
        def own(x: Column, i: Column) -> Column:
            inside = F.coalesce(_is(F.get(r, i + 1)["tag"], "I"), F.lit(False))      # an I follows the run
            last = _end(r, i, n) - 1
            longer = last > x["at"]
            ends = lambda tag, first: F.when(longer, F.array(_run(x["at"], first), _run(last, tag))).otherwise(F.array(_run(x["at"], tag)))
            return (F.when(x["tag"] == "O", F.array(x))
                    .when(_is(x["tag"], "B"), F.when(inside, ends(x["tag"], _retag("S", x["tag"]))).otherwise(F.array(_run(x["at"], _retag("S", x["tag"])))))
                    .when(_is(x["tag"], "I"), F.when(inside, F.array(x)).otherwise(ends(_retag("E", x["tag"]), x["tag"])))
                    .otherwise(F.raise_error(F.concat(F.lit("Invalid IOB format: "), x["tag"])).cast(RUNS)))
        return F.flatten(F.transform(r, own))

    return _let(_c(runs), made)


def to_iob(runs) -> Column:
    """FN4: ``S-`` -> ``B-``, ``E-`` -> ``I-``."""
    return F.transform(_c(runs), lambda x: _run(x["at"], F.when(x["tag"].startswith("S-"), _retag("B", x["tag"]))
                                                .when(x["tag"].startswith("E-"), _retag("I", x["tag"])).otherwise(x["tag"])))


def to_iob2(runs, n) -> Column:
    """WIN2: ``I-x`` at the start, after ``O`` or after another type becomes
    ``B-x``; null where a tag is not ``O``, ``I-x`` or ``B-x`` with one hyphen."""
    n = _c(n).cast("int")

    def made(r: Column) -> Column:
        def own(x: Column, i: Column) -> Column:
            before = F.get(r, i - 1)["tag"]
            opens = _is(x["tag"], "I") & ((i == 0) | (before == "O") | (F.substring(before, 2, 1 << 30) != F.substring(x["tag"], 2, 1 << 30)))
            rest = F.when(_end(r, i, n) > x["at"] + 1, F.array(_run(x["at"] + 1, x["tag"]))).otherwise(_none())
            return F.when(opens, F.concat(F.array(_run(x["at"], _retag("B", x["tag"]))), rest)).otherwise(F.array(x))
        valid = F.forall(r, lambda x: x["tag"].rlike("^(O|[IB]-[^-]*)$"))
        return F.when(valid, F.flatten(F.transform(r, own)))

    return _let(_c(runs), made)


def to_spans(runs, n, stray: str = "error") -> Column:
    """WIN3: a span opens at each ``B-x`` and runs until the next ``B-`` or
    ``O``.  An ``I-`` run at the start or after ``O`` is a stray: ``error``
    raises, ``begin`` opens a span of its type, ``ignore`` drops it."""
    if stray not in ("error", "begin", "ignore"):
        raise ValueError(stray)
    n = _c(n).cast("int")

    def made(r: Column) -> Column:
        # runs that end a span: O and B; the ones between them are I
        marks = F.filter(F.transform(r, lambda x, i: F.when((x["tag"] == "O") | _is(x["tag"], "B"), i)), lambda i: i.isNotNull())

        def of(m: Column) -> Column:
            upto = lambda k: F.coalesce(F.get(r, F.get(m, k + 1))["at"], n)  # noqa: E731  where the next mark begins
            span = lambda start, end, tag: F.struct(start.cast("int").alias("start"), (end - start).cast("int").alias("len"), _type(tag).alias("type"))
            lost = lambda at: F.raise_error(F.concat(F.lit("stray I- tag at byte "), at.cast("string"))).cast(SPANS)

            def strays(i: Column, end: Column) -> Column:     # a run that nothing has opened
                x = F.get(r, i)
                got = {"begin": F.array(span(x["at"], end, x["tag"])), "ignore": _none(SPANS), "error": lost(x["at"])}[stray]
                return F.when(x["at"] < end, got).otherwise(_none(SPANS))

            def own(i: Column, k: Column) -> Column:
                x, end = F.get(r, i), _end(r, i, n)
                single = F.when(end - x["at"] > 1, F.transform(F.sequence(x["at"], F.greatest(end - 2, x["at"])), lambda p: span(p, p + 1, x["tag"]))).otherwise(_none(SPANS))
                return (F.when(x["tag"] == "O", strays(i + 1, upto(k)))
                        .otherwise(F.concat(single, F.array(span(end - 1, upto(k), x["tag"])))))

            first = F.coalesce(F.get(r, F.get(m, F.lit(0)))["at"], n)
            head = F.when((F.size(r) > 0) & (first > 0), strays(F.lit(0), first)).otherwise(_none(SPANS))
            return F.concat(head, F.flatten(F.transform(m, own)))

        return _let(marks, of)

    return _let(_c(runs), made)


def chunks(runs, n) -> Column:
    """WIN4: chunks ``array<struct<start,len,type>>`` by the scorer's rules.
    Inside a run they fire at each position (``B``, ``E``, brackets) or at none."""
    n = _c(n).cast("int")
    event = "array<struct<at:int,opens:boolean,type:string>>"

    def made(r: Column) -> Column:
        def own(x: Column, i: Column) -> Column:
            (was, old), (now, kind) = ev.split_tag(F.coalesce(F.get(r, i - 1)["tag"], F.lit("O"))), ev.split_tag(x["tag"])
            at = lambda p, opens: F.struct(p.cast("int").alias("at"), opens.alias("opens"), kind.alias("type"))
            opens = ev.chunk_start(was, now, old, kind)
            end = _end(r, i, n)
            first = F.when(opens | ev.chunk_end(was, now, old, kind), F.array(at(x["at"], opens))).otherwise(_none(event))
            rest = F.when((end - x["at"] > 1) & now.isin("B", "E", "[", "]"),
                          F.transform(F.sequence(F.least(x["at"] + 1, end - 1), end - 1), lambda p: at(p, F.lit(True)))).otherwise(_none(event))
            return F.concat(first, rest)

        chunk = lambda b: F.transform(b, lambda x, j: F.when(x["opens"], F.struct(
            x["at"].alias("start"), (F.coalesce(F.get(b, j + 1)["at"], n) - x["at"]).alias("len"), x["type"].alias("type"))))
        return F.filter(_let(F.flatten(F.transform(r, own)), chunk), lambda x: x.isNotNull())

    return _let(_c(runs), made)


# ------------------------------------------------------------------ windows

def part(runs, n, lo, hi) -> Column:
    """Runs of the positions lo .. hi - 1, counted from lo."""
    n, lo, hi = (_c(x).cast("int") for x in (n, lo, hi))
    def made(r):
        inside = F.transform(r, lambda x, i: F.when((x["at"] < hi) & (_end(r, i, n) > lo), _run(F.greatest(x["at"], lo) - lo, x["tag"])))
        return F.filter(inside, lambda x: x.isNotNull())

    return _let(_c(runs), made)


def cut_point(runs, win, n, W: int) -> Column:
    """Position of a window from which it owns its tags (``stitch.cut_point``)."""
    if W % 2:
        raise ValueError("stitching needs an even window length")
    H, n = W // 2, _c(n).cast("int")

    def made(r: Column) -> Column:
        at_half = F.element_at(F.filter(r, lambda x: x["at"] <= H), -1)["tag"]

        def back(t: Column) -> Column:
            same = lambda x: x["tag"].startswith("I-") & (F.split_part(x["tag"], F.lit("-"), F.lit(2)) == F.split_part(t, F.lit("-"), F.lit(2)))
            other = F.transform(r, lambda x, i: F.when((x["at"] < H) & ~same(x), F.least(_end(r, i, n), F.lit(H)) - 1))
            return (F.when(n <= H, F.lit(H)).when(~t.startswith("I-"), F.lit(H)).otherwise(F.coalesce(F.array_max(other), F.lit(0))))

        return F.when((F.size(r) == 0) | (n <= H), F.lit(H)).otherwise(_let(at_half, back))

    return F.when(_c(win) == 0, F.lit(0)).otherwise(_let(_c(runs), made)).cast("int")


def stitch(windows: DataFrame, W: int = 150, runs: str = "runs") -> DataFrame:
    """WIN5: windows (doc_id, win, start, n, runs) -> the part each one owns
    (doc_id, win, off, m, runs)."""
    base = windows.select("doc_id", "win", "start", "n", F.col(runs).alias("runs"), cut_point(runs, "win", "n", W).alias("cut"))
    j = base.withColumn("next_cut", F.lead("cut").over(Window.partitionBy("doc_id").orderBy("win")))
    end = F.coalesce(F.lit(W // 2) + F.col("next_cut"), F.col("n")).cast("int")
    return j.select("doc_id", "win", (F.col("start") + F.col("cut")).cast("int").alias("off"), (end - F.col("cut")).alias("m"),
                    part("runs", "n", "cut", end).alias("runs"))


def assemble(slices: DataFrame) -> DataFrame:
    """Owned parts -> one row per document: doc_id, n_doc, runs."""
    g = slices.groupBy("doc_id").agg(F.max(F.col("off") + F.col("m")).alias("n_doc"), F.sort_array(F.collect_list(F.struct("win", "off", "runs"))).alias("_s"))
    moved = F.flatten(F.transform("_s", lambda s: F.transform(s["runs"], lambda x: _run(x["at"] + s["off"], x["tag"]))))
    return g.select("doc_id", "n_doc", moved.alias("runs"))


# ------------------------------------------------------------------ counts

def lengths(runs, n) -> Column:
    """Runs -> ``array<struct<tag,n>>``: for counts by tag without a row per position."""
    n = _c(n).cast("int")
    return _let(_c(runs), lambda r: F.transform(r, lambda x, i: F.struct(x["tag"].alias("tag"), (_end(r, i, n) - x["at"]).cast("long").alias("n"))))


def bigrams(runs, n) -> Column:
    """``array<struct<prev,next,n>>`` of a sequence between ``<START>`` and ``<END>`` (AGG17)."""
    pair = lambda a, b, k: F.struct(a.alias("prev"), b.alias("next"), k.cast("long").alias("n"))
    n = _c(n).cast("int")

    def made(r: Column) -> Column:
        own = F.flatten(F.transform(r, lambda x, i: F.array(pair(F.coalesce(F.get(r, i - 1)["tag"], F.lit("<START>")), x["tag"], F.lit(1)),
                                                            pair(x["tag"], x["tag"], _end(r, i, n) - x["at"] - 1))))
        last = F.when(F.size(r) > 0, F.array(pair(F.element_at(r, -1)["tag"], F.lit("<END>"), F.lit(1)))).otherwise(_none("array<struct<prev:string,next:string,n:bigint>>"))
        return F.filter(F.concat(own, last), lambda x: x["n"] > 0)

    return _let(_c(runs), made)


def segments(gold, pred, n) -> Column:
    """Two run lists of one sequence -> ``array<struct<gold,pred,n>>``, a segment
    between any two borders (AGG7, AGG8)."""
    n = _c(n).cast("int")

    def made(g: Column) -> Column:
        def both(p: Column) -> Column:
            side = lambda r, k: F.transform(r, lambda x, i: F.struct(x["at"].alias("at"), F.lit(k).alias("side"), i.alias("i"), x["tag"].alias("tag")))
            borders = F.sort_array(F.concat(side(g, 0), side(p, 1)))

            def parts(b: Column) -> Column:
                # before the m-th border lie m - i borders of the other side: the last of them is in force
                other = lambda r, x, m: F.get(r, m - x["i"] - 1)["tag"]
                return F.transform(b, lambda x, m: F.struct(
                    F.when(x["side"] == 0, x["tag"]).otherwise(other(g, x, m)).alias("gold"),
                    F.when(x["side"] == 1, x["tag"]).otherwise(other(p, x, m)).alias("pred"),
                    (F.coalesce(F.get(b, m + 1)["at"], n) - x["at"]).cast("long").alias("n")))
            return F.filter(_let(borders, parts), lambda x: x["n"] > 0)
        return _let(_c(pred), both)

    return _let(_c(gold), made)


# ------------------------------------------------------------------ documents and windows with runs

def with_runs(df: DataFrame, spans: str = "spans", n: str = "n", out: str = "runs", conflict: str = "rightmost") -> DataFrame:
    """TAG1 after the conflict rule ``rightmost`` (SRT2) or ``leftmost`` (SRT3)."""
    return sp.resolve(df, spans, "_res", conflict).withColumn(out, from_spans("_res", n)).drop("_res")


def window_runs(docs: DataFrame, spans: DataFrame, W: int = 150, S: int = 75, conflict: str = "rightmost") -> DataFrame:
    """Windows with the runs of their clipped spans: doc_id, win, start, n, n_doc, runs."""
    win = wn.make_windows(docs, W, S).select("doc_id", "win", "start", "n", "n_doc")
    return with_runs(wn.clip_to_windows(win, spans, W, S), "spans", "n", "runs", conflict).drop("spans")


def doc_runs(docs: DataFrame, spans: DataFrame, conflict: str = "rightmost") -> DataFrame:
    """Documents with the runs of their spans: doc_id, n_doc, runs."""
    d = docs.select("doc_id", F.octet_length("body").cast("int").alias("n_doc"))
    return with_runs(d.join(sp.nest_spans(spans), "doc_id", "left"), "spans", "n_doc", "runs", conflict).select("doc_id", "n_doc", "runs")


def chunk_rows(df: DataFrame, runs: str = "runs", n: str = "n_doc", keys=("doc_id",)) -> DataFrame:
    """Chunks of a run column as long rows (keys, start, len, type)."""
    return (df.select(*keys, F.explode_outer(chunks(runs, n)).alias("_c")).filter(F.col("_c").isNotNull())
            .select(*keys, "_c.start", "_c.len", "_c.type"))


def span_rows(df: DataFrame, runs: str = "runs", n: str = "n_doc", stray: str = "error") -> DataFrame:
    """Spans of a run column as long rows (doc_id, ord, start, len, type)."""
    return (df.select("doc_id", F.posexplode_outer(to_spans(runs, n, stray)).alias("ord", "_s")).filter(F.col("_s").isNotNull())
            .select("doc_id", "ord", "_s.start", "_s.len", "_s.type"))


def pair_segments(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Two tables of documents with runs -> rows doc_id, gold, pred, n; a
    document that one side lacks, or of another length there, raises."""
    g, p = gold.select("doc_id", F.col("n_doc").alias("_n"), F.col("runs").alias("_g")), pred.select("doc_id", F.col("n_doc").alias("_m"), F.col("runs").alias("_p"))
    j = g.join(p, "doc_id", "full_outer")
    checked = F.when(F.col("_n") == F.col("_m"), F.col("_g")).otherwise(F.raise_error(F.lit("gold and predicted positions differ")).cast(RUNS))
    return (j.select("doc_id", F.explode_outer(segments(checked, "_p", "_n")).alias("_s")).filter(F.col("_s").isNotNull())
            .select("doc_id", "_s.gold", "_s.pred", "_s.n"))


def tag_counts(df: DataFrame, runs: str, n: str) -> DataFrame:
    """-> tag, n: positions by tag."""
    return (df.select(F.explode_outer(lengths(runs, n)).alias("_r")).filter(F.col("_r").isNotNull())
            .groupBy("_r.tag").agg(F.sum("_r.n").alias("n")))

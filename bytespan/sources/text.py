"""Line-numbered text input.

``spark.read.text`` with ``lineSep='\\n'`` keeps ``\\r`` and invalid UTF-8
bytes (cast the value to binary).  Line numbers without a single-task
window: ``monotonically_increasing_id`` encodes (split, row in split);
counts per block of a file are prefix-summed and added to the row's position
inside its block (its id less the least id of the block).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: File blocks whose offsets are broadcast; with more the join shuffles.
BROADCAST_BLOCKS = 100_000
#: Numbers ranked by one task.
RANGE = 1 << 20


def _blocks(spark: SparkSession, path: str, binary: bool, boundary=None) -> tuple[DataFrame, DataFrame]:
    """Lines with the block of the file they came from, and for each block the
    lines and boundary lines of the file before it."""
    value = F.col("value").cast("binary") if binary else F.col("value")
    raw = (spark.read.option("lineSep", "\n").text(path)
           .select(value.alias("line"), F.col("_metadata.file_path").alias("file"),
                   F.col("_metadata.file_block_start").alias("_blk"),
                   F.monotonically_increasing_id().alias("_m")))
    if boundary is not None:
        raw = raw.withColumn("_b", boundary(F.col("line")))
    # the rows of one block of a file are consecutive in their task, whatever
    # else the task reads
    ensure_checkpoint_dir(spark)
    ends = F.count(F.when(F.col("_b"), 1)) if boundary is not None else F.lit(0).cast("long")
    blocks = raw.groupBy("file", "_blk").agg(F.count(F.lit(1)).alias("_c"), F.min("_m").alias("_first"), ends.alias("_e"))
    w = Window.partitionBy("file").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0))
    offs = blocks.select("file", "_blk", (before("_c") - F.col("_first")).alias("_o"), before("_e").alias("_s")).checkpoint()
    return raw, F.broadcast(offs) if offs.count() <= BROADCAST_BLOCKS else offs


def read_lines(spark: SparkSession, path: str, binary: bool = False) -> DataFrame:
    """-> ``file, line_no (0-based per file), line`` (string, or binary)."""
    raw, offs = _blocks(spark, path, binary)
    return raw.join(offs, ["file", "_blk"]).select("file", (F.col("_o") + F.col("_m")).cast("long").alias("line_no"), "line")


def read_segments(spark: SparkSession, path: str, boundary, binary: bool = False) -> DataFrame:
    """-> ``file, sent, line_no, line``: lines that are no boundary (``boundary``
    of the line column is true), numbered with the boundaries of the file before
    them.  Boundaries are counted for each block, the counts of the blocks before
    are added, and only a block's own lines are counted in order: a file is
    numbered by as many tasks as it has blocks."""
    raw, offs = _blocks(spark, path, binary, boundary)
    own = F.count(F.when(F.col("_b"), 1)).over(Window.partitionBy("file", "_blk").orderBy("_m").rowsBetween(Window.unboundedPreceding, 0))
    rows = raw.withColumn("_n", own).filter(~F.col("_b"))
    return rows.join(offs, ["file", "_blk"]).select("file", (F.col("_s") + F.col("_n")).cast("long").alias("sent"),
                                                    (F.col("_o") + F.col("_m")).cast("long").alias("line_no"), "line")


def dense_ranks(df: DataFrame, key: str, out: str = "rank", width: int = RANGE) -> DataFrame:
    """``out``: how many rows have a smaller ``key`` (distinct numbers from 0 on).
    Keys are ranked inside ranges of ``width``, behind the rows of the ranges
    before; the ranges, one row each, are summed in one task."""
    part = F.floor(F.col(key) / width).cast("long")
    sizes = df.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_p", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1
    return df.withColumn("_p", part).withColumn("_own", own).join(before, "_p").withColumn(out, F.col("_before") + F.col("_own")).drop("_p", "_own", "_before")


def previous(df: DataFrame, keys: list[str], order: str, value: str, out: str, width: int = RANGE) -> DataFrame:
    """``out``: ``value`` of the row before in ``order`` (whole numbers from 0 on)
    among rows of the same ``keys``, null for the first.  Rows look back inside
    ranges of ``width``; the first of a range looks at the last of the range
    before, of which there is one row a range."""
    d = df.withColumn("_p", F.floor(F.col(order) / width).cast("long"))
    last = d.groupBy(*keys, "_p").agg(F.max_by(value, order).alias("_l"))
    carry = last.withColumn("_carry", F.lag("_l").over(Window.partitionBy(*keys).orderBy("_p"))).drop("_l")
    w = Window.partitionBy(*keys, "_p").orderBy(order)
    d = d.withColumn("_own", F.lag(value).over(w)).withColumn("_i", F.row_number().over(w))
    return d.join(carry, [*keys, "_p"]).withColumn(out, F.when(F.col("_i") > 1, F.col("_own")).otherwise(F.col("_carry"))).drop("_p", "_own", "_i", "_carry")

"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch  # noqa: F401
from ..session import ensure_checkpoint_dir

#: Rows handled together, and rows of an Arrow batch, for whole texts: 512 texts of 100 kB are 50 MB.
TEXT_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(documents: DataFrame, *more: str) -> DataFrame:
    """doc_id and text alone; null text is empty, rows without a doc_id stay."""
    return documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` with batches of at most ``TEXT_ROWS`` rows: the session's
    batch size is lowered to it, since a batch of the default 10,000 long texts
    weighs on an executor's memory on both sides."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= TEXT_ROWS:
        conf.set(key, str(TEXT_ROWS))
    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None], schema: str,
                rows: int = TEXT_ROWS) -> DataFrame:
    """``mapInArrow`` over slices of at most ``rows`` rows, so that one slice's
    Python objects stay small however many rows an Arrow batch brings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, rows):
                out = f(b.slice(i, rows))
                if out is None:
                    continue
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return map_arrow(df, run, schema)


def kept(df: DataFrame) -> DataFrame:
    """Written as Parquet to the shared checkpoint folder and read again:
    lineage ends here, so a lost executor costs no recomputation, and the rows
    are made once."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bits of the filter in ``semi``; its 4 MB are a fixed bound.
FILTER_BITS = 1 << 25


def _flagged(df: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` as ``row`` with their key ``k`` and ``near``, false only
    where the key is surely not in ``ids``; and ``ids`` as ``k``."""
    bit = F.pmod(F.xxhash64("k"), F.lit(FILTER_BITS)) + 1
    known = ids.select(F.col(key).alias("k"))
    maps = (known.select(F.bitmap_bucket_number(bit).alias("n"), F.bitmap_bit_position(bit).alias("p"))
            .groupBy("n").agg(F.bitmap_construct_agg("p").alias("bits")))
    near = F.expr("shiftright(cast(conv(hex(substring(bits, cast(p div 8 as int) + 1, 1)), 16, 10) as int), cast(p % 8 as int)) & 1 = 1")
    rows = (df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(key).alias("k"))
            .withColumn("n", F.bitmap_bucket_number(bit)).withColumn("p", F.bitmap_bit_position(bit))
            .join(F.broadcast(maps), "n", "left")   # 4 MB at most
            .select("row", "k", F.coalesce(near, F.lit(False)).alias("near")))
    return rows, known


def semi(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``ids``.  A bitmap of fixed size goes to
    all tasks first, so that rows without a partner are not shuffled."""
    rows, known = _flagged(df, ids, key)
    return rows.filter("near").join(known, "k", "left_semi").select("row.*")


def anti(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is not in ``ids`` (null: kept); only rows that
    the bitmap cannot clear are shuffled."""
    rows, known = _flagged(df, ids, key)
    return rows.filter("not near").select("row.*").unionByName(rows.filter("near").join(known, "k", "left_anti").select("row.*"))

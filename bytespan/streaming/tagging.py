"""Streaming ingestion of unannotated text.

Windowing and byte ids are stateless per document, so a ``readStream.text``
source feeds the same plan as the batch path.  Documents are keyed by a hash of
file and line: equal lines of one file are one document, by definition.  Every
micro-batch is written under its own number, and writing a number again
replaces it, so a repeated batch leaves no second copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import windows as wn


def stream_windows(spark: SparkSession, src_dir: str, W: int = 150, S: int = 75) -> DataFrame:
    """Text lines arriving in ``src_dir`` -> windows with padded byte ids."""
    lines = (spark.readStream.option("lineSep", "\n").text(src_dir)
             .select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("body")))
    docs = lines.select(F.xxhash64("file", "body").alias("doc_id"), "file", "body")
    w = wn.make_windows(docs, W, S, keep=["file"])
    return w.select("doc_id", "file", "win", "start", "n", wn.byte_ids("text", W).alias("ids"))


def start_window_sink(df: DataFrame, out_dir: str, checkpoint: str, once: bool = True):
    """Write every micro-batch of windows to parquet."""
    def write(batch: DataFrame, epoch: int):
        batch.write.mode("overwrite").parquet(f"{out_dir}/batch={epoch}")
    q = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    q = q.trigger(availableNow=True) if once else q
    return q.start()

"""Tables that an operator call writes, owns and drops."""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession

from .session import ensure_checkpoint_dir


class Scratch:
    """Managed tables of a database in the shared checkpoint folder, so that
    ``DROP TABLE`` takes their files away wherever that folder is.

    ``keep`` writes one and gives it back to be read: lineage ends there.
    ``drop`` ends spent ones; leaving the block drops the rest but those that
    ``release`` hands to a lazy result, which still reads them.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        place = f"{ensure_checkpoint_dir(spark).rstrip('/')}/scratch"
        self.database = f"bytespan_scratch_{zlib.crc32(place.encode()):08x}"
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.database} LOCATION '{place}'")
        self.tables: dict[int, tuple[DataFrame, str]] = {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*[df for df, _ in self.tables.values()])

    def keep(self, df: DataFrame, bucketed: str | None = None) -> DataFrame:
        """``bucketed``: a column by which later joins and groups of the table need
        no shuffle; as many buckets as the session has shuffle partitions."""
        name = f"{self.database}.t{uuid.uuid4().hex}"
        writer = df.write.format("parquet")
        if bucketed:
            writer = writer.bucketBy(int(self.spark.conf.get("spark.sql.shuffle.partitions")), bucketed)
        writer.saveAsTable(name)
        out = self.spark.table(name)
        self.tables[id(out)] = (out, name)
        return out

    def drop(self, *spent: DataFrame) -> None:
        for df in spent:
            _, name = self.tables.pop(id(df))
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def release(self, df: DataFrame) -> DataFrame:
        self.tables.pop(id(df))
        return df

"""SNK9: intermediates that are made once and known by what made them.

A store is a folder with a manifest (a table of rows that are only ever added)
and one data folder for each build.  A build is known by a fingerprint: its
parameters, the result's schema, the logical plan, and path, size and time of
every file it reads.  Data is written to a folder of its own and becomes valid by
its manifest row, so a failed or running build is never read; of builds with one
fingerprint (their rows are the same) the one published first, by the writers'
clocks, of the latest generation is read.  A forced rebuild starts a generation.  ``discard`` empties
the folders of builds that no longer count.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST = "fingerprint string, generation long, published long, folder string, params string, discarded boolean"


def fingerprint(df: DataFrame, params: dict | None = None) -> str:
    """SHA-256 over what makes the rows of ``df``."""
    files = sorted(df.inputFiles())
    seen = []
    if files:
        known = df.sparkSession.read.format("binaryFile").load(files)
        seen = sorted((r.path, r.length, str(r.modificationTime)) for r in known.select("path", "length", "modificationTime").collect())   # one row a file
    what = [json.dumps(params or {}, sort_keys=True, default=str), df.schema.json(), df.semanticHash(), seen]
    return hashlib.sha256(json.dumps(what).encode()).hexdigest()


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Builds of a store that count, each with ``current``: it is the one that is read."""
    try:
        rows = spark.read.schema(MANIFEST).json(f"{path}/manifest")
    except AnalysisException:
        rows = spark.createDataFrame([], MANIFEST)
    state = rows.groupBy("fingerprint", "generation", "folder").agg(F.min("published").alias("published"), F.max("params").alias("params"),
                                                                    F.max("discarded").alias("discarded"))
    first = Window.partitionBy("fingerprint").orderBy(F.desc("generation"), "published", "folder")
    live = state.filter(~F.col("discarded")).withColumn("current", F.row_number().over(first) == 1)
    return live.select("fingerprint", "generation", "published", "folder", "params", "current")


def _publish(spark: SparkSession, path: str, key: str, generation: int, folder: str, params: str, discarded: bool = False) -> None:
    row = (key, generation, time.time_ns(), folder, params, discarded)
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").json(f"{path}/manifest")


def _current(spark: SparkSession, path: str, key: str):
    return manifest(spark, path).filter((F.col("fingerprint") == key) & F.col("current")).first()


def materialize(df: DataFrame, path: str, params: dict | None = None, rebuild: bool = False) -> DataFrame:
    """The rows of ``df`` from the store, built if no build with its fingerprint
    counts, or if ``rebuild`` asks for it."""
    spark, key = df.sparkSession, fingerprint(df, params)
    known = _current(spark, path, key)
    if known is None or rebuild:
        folder = f"{path}/data-{uuid.uuid4().hex}"
        df.write.parquet(folder)
        generation = (known.generation if known else 0) + int(rebuild)
        _publish(spark, path, key, generation, folder, json.dumps(params or {}, sort_keys=True, default=str))
        known = _current(spark, path, key)      # another writer may have come first
    return spark.read.schema(df.schema).parquet(known.folder)


def discard(spark: SparkSession, path: str, keep: list[str]) -> list[str]:
    """Empty the folders of all builds but the current ones of the fingerprints
    ``keep``; -> those folders.  For the owner of the store, when nobody reads it."""
    rows = [r for r in manifest(spark, path).collect() if not (r.current and r.fingerprint in keep)]     # one row a build
    for r in rows:
        _publish(spark, path, r.fingerprint, r.generation, r.folder, r.params, discarded=True)
        spark.createDataFrame([], "gone boolean").write.mode("overwrite").parquet(r.folder)
    return [r.folder for r in rows]

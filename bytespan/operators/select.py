"""Model selection over per-epoch scores (AGG16, WIN6, ML10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_best(scores: DataFrame, epoch: str = "epoch", f1: str = "f1") -> DataFrame:
    """WIN6: best F1 before each epoch and whether this one improved
    (strictly greater; the first epoch always improves).  One row per
    epoch, so the global order is over a small table."""
    w = Window.orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    b = F.max(f1).over(w)
    return scores.select(epoch, f1, b.alias("best_before"),
                         F.coalesce(F.col(f1) > b, F.lit(True)).alias("improved"))


def best_model(scores: DataFrame, epoch: str = "epoch", f1: str = "f1") -> DataFrame:
    """AGG16: the first epoch with the highest F1."""
    return scores.agg(F.min_by(epoch, F.struct(-F.col(f1), F.col(epoch))).alias(epoch), F.max(f1).alias(f1))

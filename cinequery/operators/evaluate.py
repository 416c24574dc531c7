"""How good rankings are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEPTHS = (1, 5, 20, 50, 100)


def recall_at(rows: DataFrame, by: Sequence[str], depths: Sequence[int] = DEPTHS) -> DataFrame:
    """For each query, the best ``row_score`` within the first k rows, for each k, and the mean of these."""
    best = rows.groupBy(*by).agg(*(F.coalesce(F.max(F.when(F.col("row") <= k, F.col("row_score"))), F.lit(0.0)).alias(f"r{k}") for k in depths))
    total = F.lit(0.0)
    for k in depths:
        total = total + F.col(f"r{k}")
    return best.withColumn("mean", total / len(depths))


def chain_score(path: str, truth: str):
    """The share of events whose frame lies in its range ``truth[i].(low, high)``."""
    inside = F.zip_with(path, truth, lambda x, r: F.when(x.between(r["low"], r["high"]), 1.0).otherwise(0.0))
    return F.aggregate(inside, F.lit(0.0), lambda s, x: s + x) / F.size(truth)

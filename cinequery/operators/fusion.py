"""Reciprocal rank fusion of shot rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinequery.functions.numbers import rank_share
from cinequery.operators.hits import rank_rows


def fuse(rankings: Sequence[DataFrame] | DataFrame, by: Sequence[str], k: float | None, depth: int | None = None) -> DataFrame:
    """One ranking of shots a query. A list of rankings, or one DataFrame with a column ``lane_no``.

    Shares of equal rank multisets are added in the same order, so they tie exactly. A shot keeps
    the frame and spares of the lane that placed it best, of the earlier lane on a tie; then the
    order is by score, best rank, video and shot.
    """
    if k is None or k < 0:
        raise ValueError("fusion needs k of 0 or more; 60 is the published choice")
    if isinstance(rankings, DataFrame):
        every = rankings
    else:
        every = None
        for number, ranking in enumerate(rankings):
            part = ranking.withColumn("lane_no", F.lit(number))
            every = part if every is None else every.unionByName(part)
    kept = F.struct("rank", "lane_no", "keyframe_id", "frame_index", "time_ms", "others")
    fused = every.groupBy(*by, "video_id", "shot_id").agg(
        F.aggregate(F.array_sort(F.collect_list(rank_share(F.col("rank"), k))), F.lit(0.0), lambda s, x: s + x).alias("score"),
        F.min(kept).alias("_best"),
    )
    fused = fused.select(*by, "video_id", "shot_id", "_best.keyframe_id", "_best.frame_index", "_best.time_ms", "score", "_best.others", F.col("_best.rank").alias("_rank"))
    return rank_rows(fused, by, [F.col("score").desc(), F.col("_rank"), F.col("video_id"), F.col("shot_id")], depth).drop("_rank")

"""Rankings of frames and shots.

A ranking is a DataFrame with the key columns of its query (``by``), a frame (``FRAME`` columns) and
an order. All operators take many queries at once, one a key; nothing runs query by query.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cinequery.sources.tables import materialize

FRAME = ["video_id", "shot_id", "keyframe_id", "frame_index", "time_ms"]
#: Frames that a search returns at most.
MAX_LIMIT = 16_384


def rank_rows(rows: DataFrame, by: Sequence[str], order: Sequence[Column], limit: int | None = None, into: str = "rank", copies: bool = False) -> DataFrame:
    """Positions from 1 in a total order; with ``limit`` each task keeps its best before the exchange.

    With ``copies``, rows equal in the whole order are one record that was delivered more than once.
    One ranking over all rows (no ``by``) is for a limited number of rows only, as one task numbers them.
    """
    if not by:
        if limit is None or copies:
            raise ValueError("a ranking without key columns needs a limit and rows that come once")
        rows = rows.orderBy(*order).limit(limit)
    window = Window.partitionBy(*by).orderBy(*order)
    ranked = rows.withColumn(into, (F.dense_rank() if copies else F.row_number()).over(window))
    ranked = ranked if limit is None else ranked.where(F.col(into) <= limit)
    return ranked.dropDuplicates([*by, into]) if copies else ranked


def rank_all(rows: DataFrame, by: Sequence[str], order: Sequence[Column], into: str = "rank") -> DataFrame:
    """Positions from 1 of all rows, for groups of any size: rows are laid out by range, numbered in each range, and ranges counted."""
    placed = materialize(rows.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    here = placed.withColumn("_here", F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order)))
    counts = placed.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return here.join(counts.select(*by, "_range", before.alias("_before")), [*by, "_range"]).withColumn(into, F.col("_before") + F.col("_here")).drop("_range", "_here", "_before")


def group_by_shot(ranked: DataFrame, by: Sequence[str], depth: int | None = None) -> DataFrame:
    """Shots in the order of their first frame, which stands for the shot; ``others`` are the rest in rank order."""
    frame = F.struct("rank", "keyframe_id", "frame_index", "time_ms", "score")
    shots = (
        ranked.groupBy(*by, "video_id", "shot_id")
        .agg(F.array_sort(F.collect_list(frame)).alias("_frames"))
        .withColumn("_first", F.col("_frames")[0])
        .select(*by, "video_id", "shot_id", "_first.*", F.slice("_frames", 2, F.greatest(F.size("_frames") - 1, F.lit(0))).alias("others"))
        .withColumnRenamed("rank", "_rank")
    )
    return rank_rows(shots, by, [F.col("_rank")], depth).drop("_rank")


def widened(ranked: DataFrame, by: Sequence[str], depth: int, cap: int = MAX_LIMIT) -> DataFrame:
    """The frames that a search sees which doubles its limit from ``depth`` until it covers ``depth`` shots.

    In one pass: with r the rank where the depth-th distinct shot first appears, the limit is the
    smallest depth * 2^i that reaches r, at most ``cap``; without such r it is ``cap``.
    """
    # The windows share the ranking's partitioning, so there is neither a join nor another exchange.
    query = Window.partitionBy(*by)
    first = F.row_number().over(Window.partitionBy(*by, "video_id", "shot_id").orderBy("rank")) == 1
    marked = ranked.where(F.col("rank") <= cap).withColumn("_new", first)
    marked = marked.withColumn("_shots", F.sum(F.col("_new").cast("int")).over(query.orderBy("rank")))
    marked = marked.withColumn("_reach", F.min(F.when(F.col("_new") & (F.col("_shots") == depth), F.col("rank"))).over(query))
    steps = [min(depth * 2**i, cap) for i in range(64) if i == 0 or depth * 2 ** (i - 1) < cap]
    limit = F.lit(cap)
    for step in reversed(steps):
        limit = F.when(F.col("_reach") <= step, F.lit(step)).otherwise(limit)
    return marked.where(F.col("rank") <= limit).drop("_new", "_shots", "_reach")


def frame_lane(frames: DataFrame, by: Sequence[str], depth: int, order: Sequence[Column] | None = None, cap: int = MAX_LIMIT) -> DataFrame:
    """Up to ``depth`` shots of each query out of scored frames: rank, widen, group, cut."""
    order = order or [F.col("score").desc(), F.col("keyframe_id")]
    frames = frames.where(F.col("score").isNotNull() & ~F.isnan("score"))
    if depth < 1:
        frames, depth = frames.where(F.lit(False)), 1
    ranked = rank_rows(frames, by, order, cap, copies=True).select(*by, *FRAME, "score", "rank")
    return group_by_shot(widened(ranked, by, depth, cap), by, depth)


def video_spread(rows: DataFrame, by: Sequence[str], keep_top: int, per_video: int, into: str = "place") -> DataFrame:
    """New places: the first ``keep_top`` as ranked, then ``per_video`` rows of each video in turn, videos as first seen."""
    if keep_top < 0 or per_video < 1:
        raise ValueError(f"cannot keep the first {keep_top} rows and then take {per_video} of each video")
    tail = F.col("rank") > keep_top
    video = Window.partitionBy(*by, tail, "video_id")
    turn = F.floor((F.row_number().over(video.orderBy("rank")) - 1) / per_video)
    marked = rows.withColumn("_turn", F.when(tail, turn).otherwise(-1)).withColumn("_seen", F.when(tail, F.min("rank").over(video)).otherwise(0))
    return rank_rows(marked, by, [F.col("_turn"), F.col("_seen"), F.col("rank")], into=into).drop("_turn", "_seen")


def shape(shots: DataFrame, by: Sequence[str], rows: int = 100, spread: tuple[int, int] | None = None) -> DataFrame:
    """Result rows: one a shot, then the shots' spare frames in order, cut at ``rows``. Only shot rows are spread."""
    if rows < 1:
        raise ValueError(f"{rows} rows asked for")
    frame = ["keyframe_id", "frame_index", "time_ms"]
    placed = video_spread(shots, by, *spread) if spread else shots.withColumn("place", F.col("rank"))
    # A shot's own row and its spares come out of one pass: (0, place, 0) and (1, rank, 1..).
    entry = lambda part, a, b, of: F.struct(F.lit(part).alias("_part"), a.cast("int").alias("_a"), b.cast("int").alias("_b"), *(of(c).alias(c) for c in frame))
    head = entry(0, F.col("place"), F.lit(0), F.col)
    spares = F.transform("others", lambda x, i: entry(1, F.col("rank"), i + 1, lambda c: x[c]))
    both = placed.select(*by, "video_id", "shot_id", F.explode(F.concat(F.array(head), spares)).alias("_e")).select(*by, "video_id", "shot_id", "_e.*")
    return rank_rows(both, by, [F.col("_part"), F.col("_a"), F.col("_b")], rows, "row").select(*by, "row", "video_id", "shot_id", *frame)

"""From detected scenes to shots, keyframe slots, the quality gate and near-duplicate groups."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cinequery.functions.numbers import frame_time_ms, hamming
from cinequery.operators.hits import rank_rows


def cover(scenes: DataFrame, video: str, frames: str) -> DataFrame:
    """Shots that tile each video: gaps split at their middle, the ends stretched; overlap is an error.

    ``scenes`` has ``video, frames, start, end``; a row with null start stands for a video without scenes.
    """
    n = F.col(frames)
    inside = (F.col("start") <= F.col("end")) & (F.col("start") < n) & (F.col("end") >= 0)
    clipped = scenes.where(inside & (n > 0)).select(video, frames, F.greatest("start", F.lit(0)).alias("start"), F.least(F.col("end"), n - 1).alias("end"))
    line = Window.partitionBy(video).orderBy("start", "end")
    following = F.lead("start").over(line)
    overlap = F.when(following <= F.col("end"), F.raise_error(F.concat(F.lit("scenes overlap in "), F.col(video).cast("string"))).cast("long"))
    cut = F.coalesce(overlap, F.floor((F.col("end") + following) / 2), n - 1)
    cuts = clipped.withColumn("end_frame", cut).withColumn("start_frame", F.coalesce(F.lag("end_frame").over(line) + 1, F.lit(0)))
    tiled = cuts.withColumn("shot_id", F.row_number().over(line) - 1).select(video, "shot_id", "start_frame", "end_frame")
    bare = scenes.where(n > 0).groupBy(video, frames).agg(F.count_if(F.coalesce(inside, F.lit(False))).alias("_n")).where("_n = 0")
    whole = bare.select(video, F.lit(0).alias("shot_id"), F.lit(0).cast("long").alias("start_frame"), (n - 1).cast("long").alias("end_frame"))
    return tiled.select(video, "shot_id", F.col("start_frame").cast("long"), F.col("end_frame").cast("long")).unionByName(whole)


def shot_times(shots: DataFrame, fps: Column) -> DataFrame:
    """``start_ms`` of each shot's first frame; ``end_ms`` where the next shot starts, or after the last frame. ``fps``: "25" or "13219/500"."""
    line = Window.partitionBy("video_id").orderBy("shot_id")
    none = F.lit(None).cast("long")
    at = lambda frame: frame_time_ms(none, F.lit(None).cast("string"), frame, fps.cast("string"))
    return shots.withColumn("start_ms", at(F.col("start_frame"))).withColumn("end_ms", F.coalesce(F.lead("start_ms").over(line), at(F.col("end_frame") + 1)))


def middle_slots(shots: DataFrame) -> DataFrame:
    middle = F.expr("(start_frame + end_frame) div 2")
    return shots.select("video_id", "shot_id", F.lit(0).cast("long").alias("slot_no"), middle.alias("low"), middle.alias("high"))


def dense_slots(shots: DataFrame, gap: int, radius: int) -> DataFrame:
    """A slot every ``gap`` frames, centred in the shot, with the frames within ``radius`` to pick from."""
    if gap < 1 or radius < 0 or 2 * radius >= gap:
        raise ValueError("dense slots need gap >= 1 and 2 * radius < gap")
    length = F.col("end_frame") - F.col("start_frame") + 1
    sized = shots.withColumn("_n", F.greatest(F.lit(1), F.floor(length / gap))).withColumn("_first", F.col("start_frame") + F.floor((length - (F.col("_n") - 1) * gap) / 2))
    each = sized.withColumn("slot_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    at = F.col("_first") + F.col("slot_no") * gap
    return each.select("video_id", "shot_id", "slot_no", F.greatest(F.col("start_frame"), at - radius).alias("low"), F.least(F.col("end_frame"), at + radius).alias("high"))


def sharpest(frames: DataFrame, shots: DataFrame, gap: int, radius: int) -> DataFrame:
    """The sharpest measured frame of each dense slot, the first on a tie.

    A frame's slot follows from its number by arithmetic: shots join by key, not by range.
    """
    length = F.col("end_frame") - F.col("start_frame") + 1
    sized = shots.select("video_id", "shot_id", "start_frame", "end_frame", F.greatest(F.lit(1), F.floor(length / gap)).alias("_n"))
    sized = sized.withColumn("_first", F.col("start_frame") + F.floor((length - (F.col("_n") - 1) * gap) / 2))
    near = F.floor((F.col("frame_index") - F.col("_first") + radius) / gap)
    placed = frames.join(sized, ["video_id", "shot_id"]).withColumn("slot_no", F.greatest(F.lit(0), F.least(near, F.col("_n") - 1)))
    inside = F.abs(F.col("frame_index") - F.col("_first") - F.col("slot_no") * gap) <= radius
    inside &= F.col("frame_index").between(F.col("start_frame"), F.col("end_frame"))
    order = [F.col("sharpness").desc(), F.col("frame_index"), F.col("keyframe_id")]
    return rank_rows(placed.where(inside), ["video_id", "shot_id", "slot_no"], order, 1, "_r").select("video_id", "shot_id", "slot_no", "keyframe_id", "frame_index", "sharpness")


# In this order: the reason, its measure, its setting and the side on which a frame fails.
_CHECKS = (("blur", "sharpness", "min_sharpness", -1), ("dark", "brightness", "min_brightness", -1), ("bright", "brightness", "max_brightness", 1), ("flat", "entropy", "min_entropy", -1))


def rejection(limits: Mapping[str, float | None] | None) -> Column:
    """The first failing check's name, or null. Limits that are unset aren't checked; None keeps all frames."""
    if limits is None:
        return F.lit(None).cast("string")
    known = [(reason, F.col(measure), limits[name], side) for reason, measure, name, side in _CHECKS if limits.get(name) is not None]
    if not known:
        raise ValueError("quality is enabled but no threshold is set")
    cases = [F.when(value < limit if side < 0 else value > limit, F.lit(reason)) for reason, value, limit, side in known]
    return F.coalesce(*cases, F.lit(None).cast("string"))


def _numbered(kept: DataFrame, inside: str) -> DataFrame:
    """``group_no``: ``inside``, a number within the shot, plus the groups of the video's earlier shots.

    Only counts a shot go through the video's window, so a video of any length is spread over its shots.
    """
    counts = kept.groupBy("video_id", "shot_id").agg((F.max(inside) + 1).alias("_n"))
    line = Window.partitionBy("video_id").orderBy("shot_id").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("video_id", "shot_id", F.coalesce(F.sum("_n").over(line), F.lit(0)).alias("_before"))
    return kept.join(before, ["video_id", "shot_id"]).withColumn("group_no", (F.col("_before") + F.col(inside)).cast("long")).drop("_before", inside)


def _rejected(keyframes: DataFrame) -> DataFrame:
    return keyframes.where("rejected is not null").withColumn("group_no", F.lit(None).cast("long")).withColumn("indexed", F.lit(False))


def near_duplicates(keyframes: DataFrame, max_distance: int) -> DataFrame:
    """``group_no`` and ``indexed`` anew: kept keyframes in a row, each near the one before it, form a group
    with its sharpest member indexed; groups are numbered through the video; rejected frames have none.
    A kept frame without a hash is near no other: a group of its own, and the next one starts a new group."""
    shot = Window.partitionBy("video_id", "shot_id").orderBy("frame_index")
    fresh = F.when(hamming(F.lag("dhash").over(shot), F.col("dhash")) <= max_distance, 0).otherwise(1)
    kept = keyframes.where("rejected is null").drop("group_no", "indexed").withColumn("_new", fresh).withColumn("_g", F.sum("_new").over(shot) - 1)
    best = Window.partitionBy("video_id", "shot_id", "_g").orderBy(F.col("sharpness").desc(), F.col("frame_index"))
    grouped = _numbered(kept.withColumn("indexed", F.row_number().over(best) == 1), "_g")
    return grouped.select(*keyframes.columns).unionByName(_rejected(keyframes).select(*keyframes.columns))


def each_alone(keyframes: DataFrame) -> DataFrame:
    """Every kept keyframe a group of its own, numbered through the video."""
    shot = Window.partitionBy("video_id", "shot_id").orderBy("frame_index")
    kept = keyframes.where("rejected is null").drop("group_no").withColumn("_g", F.row_number().over(shot) - 1).withColumn("indexed", F.lit(True))
    return _numbered(kept, "_g").select(*keyframes.columns).unionByName(_rejected(keyframes).select(*keyframes.columns))


def reselect(keyframes: DataFrame, limits: Mapping[str, float | None] | None, max_distance: int | None) -> DataFrame:
    """Selection anew from stored measurements, without decoding anything."""
    judged = keyframes.withColumn("rejected", rejection(limits))
    return each_alone(judged) if max_distance is None else near_duplicates(judged, max_distance)

"""What is done, what is stale, and summaries a video."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def currency(indexed: DataFrame, evidence: DataFrame) -> DataFrame:
    """(video_id, is_current): whether the evidence's keyframes are exactly the indexed ones."""
    one = indexed.select("video_id", "keyframe_id").distinct().withColumn("_i", F.lit(1))
    two = evidence.select("video_id", "keyframe_id").distinct().withColumn("_e", F.lit(1))
    both = one.join(two, ["video_id", "keyframe_id"], "full_outer")
    return both.groupBy("video_id").agg((F.count_if(F.col("_i").isNull() | F.col("_e").isNull()) == 0).alias("is_current"))


def todo(listed: DataFrame, done: DataFrame, force: bool = False) -> DataFrame:
    """Videos without output; all of them with ``force``."""
    videos = listed.select("video_id").distinct()
    return videos if force else videos.join(done.select("video_id"), "video_id", "left_anti")


def summary(shots: DataFrame, keyframes: DataFrame) -> DataFrame:
    """Counts of shots, keyframes and indexed keyframes of each video that has a shot or keyframe."""
    a = shots.groupBy("video_id").agg(F.count(F.lit(1)).alias("shots"))
    b = keyframes.groupBy("video_id").agg(F.count(F.lit(1)).alias("keyframes"), F.count_if("indexed").alias("indexed"))
    zero = F.lit(0).cast("long")
    return a.join(b, "video_id", "full_outer").select("video_id", *(F.coalesce(c, zero).alias(c) for c in ("shots", "keyframes", "indexed")))


def frame_mismatch(counts: DataFrame, listed: DataFrame) -> DataFrame:
    """(video_id, message) where a listed video has another number of frames than counted."""
    both = counts.join(listed.select("video_id", F.col("frames").alias("_listed")), "video_id", "left")
    text = F.format_string("%s: %d frames, the list has %d", "video_id", "frames", "_listed")
    return both.where(F.col("_listed").isNotNull() & (F.col("frames") != F.col("_listed"))).select("video_id", text.alias("message"))


def same_frames(decoded: DataFrame, detected: DataFrame) -> DataFrame:
    """``decoded(video_id, frames)``, an error where the shot detector saw another number of frames, or none were decoded."""
    both = decoded.join(detected.select("video_id", F.col("frames").alias("_seen")), "video_id")
    said = F.format_string("%s: %d frames decoded, %d seen by the detector", "video_id", "frames", "_seen")
    sound = (F.col("frames") == F.col("_seen")) & (F.col("frames") > 0)
    return both.select("video_id", F.when(sound, F.col("frames")).otherwise(F.raise_error(said).cast("long")).alias("frames"))

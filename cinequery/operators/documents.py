"""Per-shot lines from what was read, heard and seen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cinequery.functions.numbers import clamp
from cinequery.functions.text import contains_phrase, tidy, tokens
from cinequery.operators.hits import rank_rows

LINE = ["video_id", "shot_id", "keyframe_id", "frame_index", "time_ms", "text"]


def _standing(lines: DataFrame, keyframes: DataFrame) -> DataFrame:
    """Lines on indexed keyframes only, with the place the keyframe map gives."""
    places = keyframes.where("indexed").select("video_id", "keyframe_id", "shot_id", "frame_index", "time_ms")
    return lines.drop("shot_id", "frame_index", "time_ms").join(places, ["video_id", "keyframe_id"])


def ocr_lines(readings: DataFrame, keyframes: DataFrame) -> DataFrame:
    """Distinct lines of a shot: of readings with the same folded words the highest score stays, then the first."""
    keyed = _standing(readings, keyframes).withColumn("_key", F.array_join(tokens(F.col("text")), " ")).where("_key <> ''")
    order = [F.col("score").desc_nulls_last(), F.col("frame_index"), F.col("line_no"), F.col("line_id")]
    return rank_rows(keyed, ["video_id", "shot_id", "_key"], order, 1, "_r").select(*LINE, "score", "line_no")


def object_lines(labels: DataFrame, keyframes: DataFrame) -> DataFrame:
    """(.., label, count): the most of a label that one keyframe of the shot shows, on the earliest such keyframe."""
    counted = _standing(labels, keyframes).groupBy("video_id", "shot_id", "keyframe_id", "frame_index", "time_ms", F.col("text").alias("label")).agg(F.count(F.lit(1)).alias("count"))
    order = [F.col("count").desc(), F.col("frame_index"), F.col("keyframe_id")]
    return rank_rows(counted.where("label is not null"), ["video_id", "shot_id", "label"], order, 1, "_r").drop("_r")


def repeated(objects: DataFrame) -> DataFrame:
    """Each label as often as it was counted: the object lane's lines."""
    return objects.withColumn("text", F.explode(F.array_repeat("label", F.col("count").cast("int")))).select(*LINE)


def kept_segments(segments: DataFrame, phrases: list[str]) -> DataFrame:
    """Segments with text and without stock phrases."""
    text = tidy(F.col("text"))
    return segments.withColumn("text", text).where((F.col("text") != "") & ~contains_phrase(F.col("text"), phrases))


#: Width of the time cells by which segments and shots meet; about a shot's length.
CELL_MS = 60_000


def overlapping(segments: DataFrame, shots: DataFrame, padding_ms: int = 0, cell_ms: int = CELL_MS) -> DataFrame:
    """Pairs of a segment and a shot of one video that share time: ``[start, end)`` against the padded segment.

    The two sides meet by (video, time cell), so a video that holds a third of the rows is spread
    over its cells, and a pair is kept in the first cell that both touch. A segment has no cells before its
    video's first shot or after its last, however wrong its times are.
    """
    start, end = F.col("start_ms") - padding_ms, F.col("end_ms") + padding_ms
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / cell_ms), F.floor(b / cell_ms)))
    # A padded segment that ends before it starts can still meet a shot: the two tests are separate.
    left = segments.where("start_ms is not null and end_ms is not null").withColumn("_from", start).withColumn("_to", end)
    extent = shots.groupBy("video_id").agg(F.min("start_ms").alias("_first"), F.max(F.greatest("start_ms", "end_ms")).alias("_last"))
    left = left.join(extent, "video_id").withColumn("_low", F.greatest("_first", F.least("_from", "_to"))).withColumn("_high", F.least("_last", F.greatest("_from", "_to"))).where("_low <= _high").drop("_first", "_last")
    left = left.withColumn("_cell", cells(F.col("_low"), F.col("_high"))).withColumnsRenamed({"start_ms": "segment_start", "end_ms": "segment_end"})
    right = shots.select("video_id", "shot_id", F.col("start_ms").alias("shot_start"), F.col("end_ms").alias("shot_end"))
    right = right.withColumn("_cell", cells(F.col("shot_start"), F.greatest(F.col("shot_end"), F.col("shot_start"))))
    first = F.greatest(F.floor(F.col("_low") / cell_ms), F.floor(F.col("shot_start") / cell_ms))
    pairs = left.join(right, ["video_id", "_cell"]).where((F.col("shot_start") < F.col("_to")) & (F.col("shot_end") > F.col("_from")) & (F.col("_cell") == first))
    return pairs.drop("_from", "_to", "_low", "_high", "_cell")


def speech_lines(segments: DataFrame, shots: DataFrame, keyframes: DataFrame, padding_ms: int = 0) -> DataFrame:
    """Each segment in every shot it touches, on the indexed keyframe nearest to when it is heard there.

    Pairs and keyframes of a shot are merged by time: the last keyframe before and the first after come
    from two running windows over one exchange, so no pair of segment and keyframe is made and no
    shot's keyframes are gathered. Of two equally near, the earlier keyframe.
    """
    shot = ["video_id", "shot_id"]
    frame = F.struct("time_ms", "frame_index", "keyframe_id")
    none = keyframes.select(frame.alias("f")).schema["f"].dataType
    places = keyframes.where("indexed").select(*shot, F.col("time_ms").alias("heard"), F.col("frame_index").alias("_order"), frame.alias("_frame"), F.lit(None).cast("string").alias("segment_id"), F.lit(None).cast("string").alias("text"))
    kind = segments.schema["segment_id"].dataType
    pairs = overlapping(segments, shots, padding_ms)
    heard = clamp(F.col("segment_start"), F.col("shot_start"), F.col("shot_end"))
    asked = pairs.select(*shot, heard.alias("heard"), F.lit(None).cast("bigint").alias("_order"), F.lit(None).cast(none).alias("_frame"), F.col("segment_id").cast("string").alias("segment_id"), "text")
    both = places.unionByName(asked)
    # At one time keyframes stand before pairs, the lowest frame index last of them.
    up = Window.partitionBy(*shot).orderBy("heard", F.col("_order").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*shot).orderBy(F.col("heard").desc(), F.col("_order").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_before", F.last("_frame", ignorenulls=True).over(up)).withColumn("_after", F.last("_frame", ignorenulls=True).over(down))
    near = lambda f: F.when(F.col(f).isNotNull(), F.struct(F.abs(F.col(f)["time_ms"] - F.col("heard")).alias("gap"), F.col(f)["frame_index"].alias("frame_index"), F.col(f)["keyframe_id"].alias("keyframe_id"), F.col(f)["time_ms"].alias("time_ms")))
    chosen = seen.where("segment_id is not null").withColumn("_near", F.least(near("_before"), near("_after"))).where("_near is not null")
    return chosen.select(F.col("segment_id").cast(kind).alias("segment_id"), *shot, "heard", "_near.keyframe_id", "_near.frame_index", "_near.time_ms", "text")

"""Offline jobs: from measured frames and evidence to tables, for the videos that need it."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinequery.models import embed
from cinequery.operators import bm25, documents, incremental, preprocess
from cinequery.sources.tables import materialize
from cinequery.sources.vector_store import VectorStore


@dataclass(frozen=True)
class Selection:
    """How keyframes are chosen: ``gap`` None takes the middle frame of each shot."""

    gap: int | None = None
    radius: int = 0
    limits: Mapping[str, float | None] | None = None
    max_distance: int | None = None


def select_keyframes(shots: DataFrame, frames: DataFrame, how: Selection) -> DataFrame:
    """Keyframes of measured frames: the slots' picks, the quality gate, groups and what is indexed."""
    if how.gap is None:
        slots = preprocess.middle_slots(shots).select("video_id", "shot_id", F.col("low").alias("frame_index"))
        picked = frames.join(slots, ["video_id", "shot_id", "frame_index"], "left_semi")
    else:
        chosen = preprocess.sharpest(frames, shots, how.gap, how.radius).select("video_id", "keyframe_id")
        picked = frames.join(chosen, ["video_id", "keyframe_id"], "left_semi")
    empty = picked.withColumn("rejected", F.lit(None).cast("string")).withColumn("group_no", F.lit(None).cast("long")).withColumn("indexed", F.lit(True))
    return preprocess.reselect(empty, how.limits, how.max_distance)


def build_visual(keyframes: DataFrame, pictures: DataFrame, store: VectorStore, encoder: str, batch_size: int = 16, force: bool = False) -> DataFrame:
    """Embed the indexed keyframes of the videos whose stored vectors differ from them; returns the failures.

    A video with a failing picture keeps its old vectors; the others are replaced.
    """
    indexed = keyframes.where("indexed")
    state = incremental.currency(indexed, store.rows())
    videos = indexed.select("video_id").distinct() if force else state.where("not is_current").select("video_id")
    wanted = indexed.join(videos, "video_id", "left_semi").select("video_id", "shot_id", "keyframe_id", "frame_index", "time_ms")
    done = materialize(embed(wanted.join(pictures, "keyframe_id"), "content", encoder, batch_size).drop("content"), "embedded")
    failed = done.where("error is not null").select("video_id", "keyframe_id", "error")
    good = done.join(failed.select("video_id").distinct(), "video_id", "left_anti")
    store.replace_videos(good.drop("error"), videos.join(failed.select("video_id").distinct(), "video_id", "left_anti"))
    return failed


def build_keywords(ocr: DataFrame, segments: DataFrame, labels: DataFrame, shots: DataFrame, keyframes: DataFrame, padding_ms: int = 0, k1: float = 1.2, b: float = 0.75) -> bm25.KeywordIndex:
    """The index of all three keyword lanes, from evidence rows."""
    columns = ["lane", "video_id", "shot_id", "text", "keyframe_id", "frame_index", "time_ms"]
    read = documents.ocr_lines(ocr, keyframes).withColumn("lane", F.lit("ocr"))
    said = documents.speech_lines(segments, shots, keyframes, padding_ms).withColumn("lane", F.lit("asr"))
    seen = documents.repeated(documents.object_lines(labels, keyframes)).withColumn("lane", F.lit("objects"))
    return bm25.build(read.select(*columns).unionByName(said.select(*columns)).unionByName(seen.select(*columns)), k1, b)


def stale_report(keyframes: DataFrame, evidence: DataFrame, shown: int = 5) -> str | None:
    """A warning that names the first videos whose evidence is not that of their indexed keyframes."""
    stale = incremental.currency(keyframes.where("indexed"), evidence).where("not is_current").select("video_id")
    first = [r.video_id for r in stale.orderBy("video_id").limit(shown).collect()]
    return f"stale evidence in {stale.count()} videos: {', '.join(first)} ..." if first else None


def explode_readings(readings: DataFrame) -> DataFrame:
    """Nested readings of keyframes as lines: (video_id, keyframe_id, line_no, line_id, text, score), empty texts dropped."""
    each = readings.select("video_id", "keyframe_id", F.posexplode(F.filter("lines", lambda x: F.trim(x["text"]) != "")).alias("line_no", "_l"))
    return each.select("video_id", "keyframe_id", F.col("line_no").cast("long"), F.xxhash64("keyframe_id", "line_no").alias("line_id"), "_l.text", "_l.score")

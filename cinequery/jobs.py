"""Offline jobs over a data folder: videos to shots and keyframes, keyframes to evidence and indexes.

Tables are Parquet folders partitioned by video; a job overwrites the partitions of the videos it did and
no others. Keyframes are written last, so a video that has some is done. A video or picture that fails
is reported and keeps what it had; the others go on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinequery import schemas
from cinequery.config import Settings
from cinequery.functions.numbers import box_share, segment_ms
from cinequery.functions.pictures import difference_hash, encode_picture, measure
from cinequery.models import MODELS, Frame, in_batches, load_encoder
from cinequery.operators import incremental, preprocess as shots_and_slots
from cinequery.plans import build
from cinequery.sources.files import video_files, write_pictures
from cinequery.sources.tables import hadoop, materialize, table
from cinequery.sources.vector_store import VectorStore


def _exists(spark: SparkSession, data: str, name: str) -> bool:
    system, path = hadoop(spark, f"{data}/{name}.parquet")
    return system.exists(path)


def _stored(spark: SparkSession, data: str, name: str, schema: str) -> DataFrame:
    return table(spark, data, name).to(spark.createDataFrame([], schema).schema) if _exists(spark, data, name) else spark.createDataFrame([], schema)


def _put(rows: DataFrame, data: str, name: str) -> None:
    """Replace the partitions of the rows' videos."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("video_id").parquet(f"{data}/{name}.parquet")


def _said(failed: DataFrame, what: str, key: str = "video_id") -> list[str]:
    return [f"{what} {r[0]}: {r[1]}" for r in failed.select(key, "error").orderBy(key).toLocalIterator()]


# -- videos


def _a_video(run: Callable[[Any, str, Any], list[dict[str, Any]]], columns: Sequence[str]):
    """Applies ``run`` to each video of a task; one that fails gives a row with the error."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                try:
                    found = run(row, row.path, None)
                except Exception as failed:
                    found = [{"error": f"{type(failed).__name__}: {failed}"}]
                if found:
                    yield pd.DataFrame([{c: x.get(c) for c in columns} | {"video_id": row.video_id, "error": x.get("error")} for x in found], dtype=object)

    return each


def detect_scenes(videos: DataFrame) -> DataFrame:
    """(video_id, frames, start, end, rate, error): scenes as the shot detector sees them, of a video without any one row without a start."""
    decoder, detector = MODELS["decoder"], MODELS["shots"]

    def run(row: Any, path: str, _: Any) -> list[dict[str, Any]]:
        source = decoder()
        scenes, n = detector().detect(source.frames(path))
        if n < 1:
            raise ValueError("no frame could be decoded")
        return [{"frames": n, "start": a, "end": b, "rate": str(source.rate)} for a, b in scenes or [(None, None)]]

    columns = ["frames", "start", "end", "rate"]
    return videos.select("video_id", "path").mapInPandas(_a_video(run, columns), "video_id string, frames bigint, start bigint, end bigint, rate string, error string")


_MEASURED = "shot_id bigint, frame_index bigint, time_ms bigint, pts bigint, time_base string, time_source string, sharpness double, brightness double, entropy double, dhash string, content binary"


def pick_frames(videos: DataFrame, slots: DataFrame, frames: DataFrame) -> DataFrame:
    """One decoding pass a video: of each slot's frames the sharpest, the first on a tie, with its measures and picture.

    Slots of a video follow one another, so a pass holds one frame a slot. Another number of frames than the detector saw is an error.
    """
    decoder = MODELS["decoder"]
    wanted = slots.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("low", "high", "shot_id"))).alias("slots"))  # the slots of one video
    todo = videos.select("video_id", "path").join(wanted, "video_id").join(frames.select("video_id", F.col("frames").alias("seen")), "video_id")

    def run(row: Any, path: str, _: Any) -> list[dict[str, Any]]:
        asked = [(int(s["low"]), int(s["high"]), int(s["shot_id"])) for s in row.slots]
        best: dict[int, tuple[float, Frame, dict[str, float]]] = {}
        at = n = 0
        for frame in decoder().frames(path):
            n += 1
            while at < len(asked) and asked[at][1] < frame.index:
                at += 1
            if at < len(asked) and asked[at][0] <= frame.index:
                found = measure(frame.grey)
                if at not in best or found["sharpness"] > best[at][0]:
                    best[at] = (found["sharpness"], frame, found)
        if n != row.seen:
            raise ValueError(f"{n} frames decoded, {row.seen} seen by the detector")
        return [
            {
                "shot_id": asked[k][2], "frame_index": f.index, "time_ms": f.time_ms, "pts": f.pts, "time_base": None if f.pts is None else str(f.time_base),
                "time_source": "fps" if f.pts is None else "pts", **found, "dhash": difference_hash(f.grey), "content": encode_picture(f.grey),
            }
            for k, (_, f, found) in sorted(best.items())
        ]

    columns = [c.split()[0] for c in _MEASURED.split(", ")]
    return todo.mapInPandas(_a_video(run, columns), f"video_id string, {_MEASURED}, error string")


def preprocess(spark: SparkSession, data: str, folder: str, settings: Settings, force: bool = False) -> list[str]:
    """Shots, keyframes and pictures of the videos below ``folder`` that have none yet; what failed."""
    pattern = settings.get("videos.pattern", "*.mp4")
    listed = video_files(spark, folder, pattern)
    done = _stored(spark, data, "keyframes", schemas.KEYFRAMES)
    videos = listed.join(incremental.todo(listed, done, force), "video_id", "left_semi")
    scenes = materialize(detect_scenes(videos), "scenes")
    failures = _said(scenes.where("error is not null"), "video")
    good = scenes.where("error is null")
    rates = good.select("video_id", "frames", "rate").distinct()
    shots = shots_and_slots.cover(good, "video_id", "frames").join(rates, "video_id")
    timed = shots_and_slots.shot_times(shots, F.col("rate")).select(*(c.split()[0] for c in schemas.SHOTS.split(", ")))
    gap = settings.get("keyframes.gap")
    slots = shots_and_slots.middle_slots(timed) if gap is None else shots_and_slots.dense_slots(timed, gap, settings.get("keyframes.radius", 0))
    picked = materialize(pick_frames(videos, slots, rates), "picked")
    failures += _said(picked.where("error is not null"), "video")
    sound = picked.where("error is null").drop("error")
    name = F.format_string("%s_%06d", "video_id", "frame_index")
    named = sound.withColumn("keyframe_id", name).withColumn("image", F.concat("video_id", F.lit("/"), name, F.lit(".jpg")))
    empty = named.drop("content").withColumn("rejected", F.lit(None).cast("string")).withColumn("group_no", F.lit(None).cast("long")).withColumn("indexed", F.lit(True))
    limits = settings.get("quality")
    keyframes = shots_and_slots.reselect(empty, limits, settings.get("grouping.max_distance")).select(*(c.split()[0] for c in schemas.KEYFRAMES.split(", ")))
    write_pictures(named.select(F.col("image").alias("name"), "content"), f"{data}/frames")
    _put(timed.join(sound.select("video_id").distinct(), "video_id", "left_semi"), data, "shots")
    _put(keyframes, data, "keyframes")
    return failures


def reselect(spark: SparkSession, data: str, settings: Settings) -> None:
    """The quality gate and the groups anew for all videos, from what was measured."""
    rows = table(spark, data, "keyframes").withColumn("indexed", F.lit(True))
    again = shots_and_slots.reselect(rows, settings.get("quality"), settings.get("grouping.max_distance"))
    _put(materialize(again, "reselected"), data, "keyframes")


# -- evidence


def _pictures(spark: SparkSession, data: str, keyframes: DataFrame) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{data}/frames").select(F.regexp_extract("path", r"([^/]+)\.[^.]*$", 1).alias("keyframe_id"), "content")
    return keyframes.join(files, "keyframe_id", "left")


def _keyframes(spark: SparkSession, data: str) -> DataFrame:
    return _stored(spark, data, "keyframes", schemas.KEYFRAMES)


def visual(spark: SparkSession, data: str, settings: Settings, force: bool) -> list[str]:
    encoder = settings.get("search.encoder", "hash")
    store = VectorStore(spark, f"{data}/vectors", encoder)
    if not store.exists():
        store.create(load_encoder(encoder).dim)
    frames = _keyframes(spark, data)
    pictures = _pictures(spark, data, frames.where("indexed").select("keyframe_id"))
    return _said(build.build_visual(frames, pictures, store, encoder, int(settings.get("visual.batch_size", 16)), force), "keyframe", "keyframe_id")


def _read_pictures(role: str, name: str, field: str) -> Callable[[SparkSession, str, Settings, bool], list[str]]:
    kind = f"array<struct<{field}: string, score: double, box: array<double>>>"

    def step(spark: SparkSession, data: str, settings: Settings, force: bool) -> list[str]:
        indexed = _keyframes(spark, data).where("indexed")
        held = _stored(spark, data, name, f"video_id string, keyframe_id string, {name} {kind}")
        state = incremental.currency(indexed, held)
        videos = indexed.select("video_id").distinct() if force else state.where("not is_current").select("video_id")
        wanted = _pictures(spark, data, indexed.join(videos, "video_id", "left_semi").select("video_id", "keyframe_id"))
        given = settings.get(role, {})
        factory = MODELS[role]
        done = materialize(in_batches(wanted, "content", lambda: factory(**given).read, name, kind, int(settings.get(f"{role}_batch_size", 16))).drop("content"), name)
        failed = done.where("error is not null")
        _put(done.drop("error").join(failed.select("video_id").distinct(), "video_id", "left_anti"), data, name)
        return _said(failed, "keyframe", "keyframe_id")

    return step


def speech(spark: SparkSession, data: str, settings: Settings, force: bool) -> list[str]:
    """Speech depends on the video alone: it is done once."""
    videos = video_files(spark, settings.get("videos.folder", f"{data}/videos"), settings.get("videos.pattern", "*.mp4"))
    todo = videos.join(incremental.todo(videos, _stored(spark, data, "speech", "video_id string"), force), "video_id", "left_semi")
    factory, given = MODELS["asr"], settings.get("asr", {})

    def run(row: Any, path: str, _: Any) -> list[dict[str, Any]]:
        found = factory(**given).transcribe(path)
        return [{"seq": i, "start": a, "end": b, "text": t} for i, (a, b, t) in enumerate(found)] or [{"seq": None}]

    heard = materialize(todo.select("video_id", "path").mapInPandas(_a_video(run, ["seq", "start", "end", "text"]), "video_id string, seq bigint, start double, end double, text string, error string"), "speech")
    rows = heard.where("error is null").select("video_id", "seq", segment_ms(F.col("start"), F.lit(0)).alias("start_ms"), segment_ms(F.col("end"), F.lit(0)).alias("end_ms"), "text")
    _put(rows, data, "speech")
    return _said(heard.where("error is not null"), "video")


def keywords(spark: SparkSession, data: str, settings: Settings, force: bool) -> list[str]:
    """The whole keyword index, from all evidence that is there; evidence of other keyframes than the indexed is reported."""
    frames = _keyframes(spark, data)
    line = "video_id string, keyframe_id string, lines array<struct<text: string, score: double, box: array<double>>>"
    seen = "video_id string, keyframe_id string, objects array<struct<label: string, score: double, box: array<double>>>"
    ocr, objects = _stored(spark, data, "lines", line), _stored(spark, data, "objects", seen)
    heard = _stored(spark, data, "speech", "video_id string, seq bigint, start_ms bigint, end_ms bigint, text string").where("seq is not null")
    labels = objects.select("video_id", "keyframe_id", F.explode("objects").alias("_o")).select("video_id", "keyframe_id", F.col("_o.label").alias("text"))
    texts, nowhere = build.explode_readings(ocr), {c: F.lit(None).cast("bigint") for c in ("shot_id", "frame_index", "time_ms")}
    segments = heard.select(F.xxhash64("video_id", "seq").alias("segment_id"), "video_id", "start_ms", "end_ms", "text")
    index = build.build_keywords(texts.withColumns(nowhere), segments, labels.withColumns(nowhere), table(spark, data, "shots"), frames, int(settings.get("asr_padding_ms", 0)))
    index.save(f"{data}/keywords")
    stale = [build.stale_report(frames, rows) for rows in (ocr, objects)]
    return [f"{name}: {report}" for name, report in zip(("ocr", "objects"), stale) if report]


STEPS: dict[str, Callable[[SparkSession, str, Settings, bool], list[str]]] = {
    "visual": visual,
    "ocr": _read_pictures("ocr", "lines", "text"),
    "asr": speech,
    "objects": _read_pictures("objects", "objects", "label"),
    "keywords": keywords,
}


def build_index(spark: SparkSession, data: str, settings: Settings, steps: Sequence[str] | None = None, force: bool = False) -> list[str]:
    """Run the steps, all of them if none is named, in their order; a step that fails as a whole does not stop the others."""
    if odd := sorted(set(steps or ()) - set(STEPS)):
        raise ValueError(f"no step {', '.join(odd)}; there are {', '.join(STEPS)}")
    failures: list[str] = []
    for name, step in STEPS.items():
        if steps is None or name in steps:
            try:
                failures += step(spark, data, settings, force)
            except Exception as failed:
                failures.append(f"step {name}: {type(failed).__name__}: {str(failed).splitlines()[0] if str(failed) else ''}")
    return failures


def boxes_as_shares(readings: DataFrame, column: str, width: Column, height: Column) -> DataFrame:
    """Boxes (left, top, right, bottom) in pixels as shares of the picture, to 4 digits."""
    share = lambda b: F.transform(b, lambda x, i: box_share(x, F.when(i % 2 == 0, width).otherwise(height)))
    return readings.withColumn(column, F.transform(column, lambda x: x.withField("box", share(x["box"]))))


def demo_video(path: str, scenes: Sequence[int], frames: int = 20, size: int = 24, seed: int = 1) -> None:
    """Write a made-up video for ``ArrayDecoder``: scenes of noise around the given grey levels."""
    rng = np.random.default_rng(seed)
    parts = [np.clip(rng.normal(level, 12, (frames, size, size)), 0, 255) for level in scenes]
    np.save(path, np.concatenate(parts).astype(np.uint8))

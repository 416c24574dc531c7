"""Answers of the three tasks, their forms, and the states of what was sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinequery.functions.text import tidy

#: Rows that a submission file may have.
MAX_ROWS = 100


def violations(answers: DataFrame, task: str) -> DataFrame:
    """Rows that cannot be sent, with the ``problem``."""
    video = F.trim(F.coalesce("video_id", F.lit(""))) == ""
    checks: list[tuple[Column, str]] = [(video, "an answer needs a video id")]
    if task == "trake":
        path = F.col("path")
        checks.append((F.exists(path, lambda x: x < 0), "frame indexes and times cannot be negative"))
        order = F.exists(F.zip_with(F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0))), F.slice(path, 2, F.size(path)), lambda a, b: b < a), lambda x: F.coalesce(x, F.lit(False)))
        checks.append(((F.size(path) < 2) | order, "a chain needs two or more frames in time order"))
    else:
        checks.append(((F.col("frame_index") < 0) | (F.col("time_ms") < 0), "frame indexes and times cannot be negative"))
        if task == "qa":
            checks.append((F.coalesce(tidy(F.col("answer")), F.lit("")) == "", "a Q&A row needs an answer"))
            checks.append((F.contains(tidy(F.col("answer")), F.lit("-")), "a Q&A answer that is sent cannot contain '-'"))
    problem = F.coalesce(*(F.when(bad, F.lit(why)) for bad, why in checks))
    return answers.withColumn("problem", problem).where("problem is not null")


def kis(rows: DataFrame, base: int = 0) -> DataFrame:
    """The file row and the JSON that is sent, of each frame."""
    sent = F.to_json(F.struct(F.col("video_id").alias("mediaItemName"), F.col("time_ms").alias("start"), F.col("time_ms").alias("end")))
    return rows.select("row", "video_id", (F.col("frame_index") + base).alias("frame"), sent.alias("sent"))


def qa(rows: DataFrame, answer: Column, base: int = 0) -> DataFrame:
    clean = tidy(answer)
    text = F.concat(F.lit("QA-"), clean, F.lit("-"), F.col("video_id"), F.lit("-"), F.col("time_ms").cast("string"))
    return rows.select("row", "video_id", (F.col("frame_index") + base).alias("frame"), clean.alias("answer"), text.alias("sent"))


def trake(chains: DataFrame, base: int = 0) -> DataFrame:
    frames = F.array_join(F.transform("path", lambda x: (x + base).cast("string")), ",")
    return chains.select(F.col("rank").alias("row"), "video_id", frames.alias("frames"), F.concat(F.lit("TR-"), F.col("video_id"), F.lit("-"), frames).alias("sent"))


def states(log: DataFrame) -> DataFrame:
    """The latest verdict of each (evaluation, task, answer), and whether it counts as sent: an error frees it."""
    last = log.groupBy("evaluation", "task", "answer").agg(F.max_by("verdict", "line_no").alias("verdict"))
    return last.withColumn("sent", ~F.startswith("verdict", F.lit("ERROR")))

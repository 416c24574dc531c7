"""The test tables as records: a row that was delivered again counts once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinequery.sources.tables import table

KEYFRAME = "video_id keyframe_id shot_id frame_index time_ms pts time_base time_source image sharpness brightness entropy dhash rejected group_no indexed".split()
LINE = "line_id lane video_id shot_id line_no text keyframe_id frame_index time_ms score".split()
SEGMENT = "segment_id video_id seq start_ms end_ms text".split()
HIT = "hit_id query_id lane video_id shot_id keyframe_id frame_index time_ms score".split()

#: Rankings of these lanes are fused, in this order.
LANES = ("visual", "ocr", "asr")

# Settings of the queries.
QUALITY = {"min_sharpness": 60.0, "min_brightness": 40.0, "max_brightness": 220.0, "min_entropy": 2.5}
PHRASES = ["Cảm ơn các bạn đã xem", "Nhớ bấm theo dõi kênh", "(tiếng nhạc)"]
KEYWORDS = {1: "đèo Mây thịt kho", 2: "the wooden bridge", 3: "GIÁ gạo nếp TĂNG tăng"}
K1, B, RRF_K, DEPTH, ROWS = 1.2, 0.75, 60.0, 100, 100


def keyframes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "keyframes").select(*KEYFRAME).dropDuplicates(["keyframe_id"])


def lines(spark: SparkSession, folder: str, *lanes: str) -> DataFrame:
    rows = table(spark, folder, "shot_lines").select(*LINE).where("text is not null")
    return (rows.where(F.col("lane").isin(*lanes)) if lanes else rows).dropDuplicates(["line_id"])


def segments(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "asr").select(*SEGMENT).where("video_id is not null and start_ms is not null and end_ms is not null and text is not null").dropDuplicates(["segment_id"])


def hits(spark: SparkSession, folder: str) -> DataFrame:
    """Scored hits. Copies tie in every order, so the rankings themselves count them once."""
    return table(spark, folder, "shot_hits").select(*HIT).where("video_id is not null and score is not null and not isnan(score)")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Stored vectors; the searches themselves leave out zero ones and count copies once."""
    return table(spark, folder, "milvus_index").where("vector is not null")


# The same in SQL.

_COLUMNS = {"kf": (KEYFRAME, "keyframes"), "ln": (LINE, "shot_lines"), "sg": (SEGMENT, "asr"), "ht": (HIT, "shot_hits")}


def sql_view(name: str) -> str:
    """A common table expression."""
    if name == "ix":
        return "ix as (select distinct on (keyframe_id) id, keyframe_id, video_id, shot_id, frame_index, time_ms, vector::double[] as v from milvus_index where list_max(list_transform(vector, lambda x: abs(x))) > 0 order by keyframe_id, id)"
    columns, source = _COLUMNS[name]
    where = {
        "kf": "true",
        "ln": "text is not null",
        "sg": "video_id is not null and start_ms is not null and end_ms is not null and text is not null",
        "ht": "video_id is not null and score is not null and not isnan(score)",
    }[name]
    return f"{name} as (select distinct {', '.join(columns)} from {source} where {where})"


def sql_words(text: str) -> str:
    # strip_accents would drop spacing marks too, which stand between words here.
    return f"regexp_extract_all(strip_accents(replace(replace(regexp_replace(lower({text}), '\\p{{Mc}}', ' ', 'g'), 'ß', 'ss'), 'đ', 'd')), '[\\p{{L}}\\p{{N}}_]+')"


def sql_tidy(text: str) -> str:
    return f"trim(regexp_replace(nfc_normalize({text}), '[\\s\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g'))"

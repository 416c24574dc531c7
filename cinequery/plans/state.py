"""Queries of what is current, done and sent, and of summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinequery.functions.numbers import cosine, norm, unit
from cinequery.operators import incremental, submission
from cinequery.plans import views
from cinequery.plans.retrieval import Query
from cinequery.plans.views import sql_view
from cinequery.sources.tables import table


def is_current(s: SparkSession, d: str) -> DataFrame:
    """Videos whose vectors cover exactly their indexed keyframes."""
    return incremental.currency(table(s, d, "keyframes").where("indexed"), table(s, d, "milvus_index"))


def todo_videos(s: SparkSession, d: str) -> DataFrame:
    return incremental.todo(table(s, d, "videos"), table(s, d, "keyframes"))


def video_catalog(s: SparkSession, d: str) -> DataFrame:
    """Videos that have a keyframe map."""
    return table(s, d, "keyframes").select("video_id").distinct()


def video_summary(s: SparkSession, d: str) -> DataFrame:
    return incremental.summary(table(s, d, "shots"), views.keyframes(s, d))


def frame_mismatch(s: SparkSession, d: str) -> DataFrame:
    counts = table(s, d, "shots").groupBy("video_id").agg((F.max("end_frame") + 1).alias("frames"))
    return incremental.frame_mismatch(counts, table(s, d, "videos"))


def _log(s: SparkSession, d: str) -> DataFrame:
    """Events as a submission log."""
    verdict = F.when(F.col("value") < 20, "SENDING").when(F.col("value") < 60, "CORRECT").when(F.col("value") < 80, "WRONG").otherwise("ERROR 503")
    return table(s, d, "events").select(F.lit("E1").alias("evaluation"), F.col("event_type").alias("task"), F.col("user_id").cast("string").alias("answer"), verdict.alias("verdict"), F.col("event_id").alias("line_no"))


def submission_status(s: SparkSession, d: str) -> DataFrame:
    return submission.states(_log(s, d))


def answer_check(s: SparkSession, d: str) -> DataFrame:
    """Q&A answers taken from the speech segments that cannot be sent, and why."""
    rows = table(s, d, "asr").select("segment_id", "video_id", F.lit(1).cast("long").alias("frame_index"), F.col("start_ms").alias("time_ms"), F.col("text").alias("answer"))
    return submission.violations(rows.dropDuplicates(["segment_id"]), "qa").select("segment_id", "problem")


def vector_norms(s: SparkSession, d: str) -> DataFrame:
    """Lengths of the stored vectors, before and after they are normalised, and the cosine of both."""
    rows = table(s, d, "milvus_index").where("vector is not null")
    v = F.col("vector")
    return rows.select("id", F.round(norm(v), 5).alias("length"), F.round(norm(unit(v)), 5).alias("after"), F.round(cosine(v, unit(v)), 5).alias("same"))


QUERIES: dict[str, Query] = {
    "is_current": is_current,
    "todo_videos": todo_videos,
    "video_catalog": video_catalog,
    "video_summary": video_summary,
    "frame_mismatch": frame_mismatch,
    "submission_status": submission_status,
    "answer_check": answer_check,
    "vector_norms": vector_norms,
}

SQL: dict[str, str] = {
    "is_current": """with a as (select distinct video_id, keyframe_id from keyframes where indexed), b as (select distinct video_id, keyframe_id from milvus_index)
        select video_id, bool_and(x is not null and y is not null) as is_current
        from (select *, 1 as x from a) full join (select *, 1 as y from b) using (video_id, keyframe_id) group by video_id""",
    "todo_videos": "select distinct video_id from videos where video_id not in (select video_id from keyframes where video_id is not null)",
    "video_catalog": "select distinct video_id from keyframes",
    "video_summary": f"""with {sql_view('kf')}, a as (select video_id, count(*) as shots from shots group by 1), b as (select video_id, count(*) as keyframes, count(*) filter (indexed) as indexed from kf group by 1)
        select video_id, coalesce(shots, 0) as shots, coalesce(keyframes, 0) as keyframes, coalesce(indexed, 0) as indexed from a full join b using (video_id)""",
    "frame_mismatch": """select video_id, printf('%s: %d frames, the list has %d', video_id, n, frames) as message
        from videos join (select video_id, max(end_frame) + 1 as n from shots group by 1) using (video_id) where n <> frames""",
    "submission_status": """select 'E1' as evaluation, event_type as task, user_id::varchar as answer, v as verdict, not starts_with(v, 'ERROR') as sent from (
            select event_type, user_id, case when value < 20 then 'SENDING' when value < 60 then 'CORRECT' when value < 80 then 'WRONG' else 'ERROR 503' end as v from events
            qualify row_number() over (partition by event_type, user_id order by event_id desc) = 1
        )""",
    "answer_check": f"""with t as (select distinct segment_id, video_id, start_ms, {views.sql_tidy('text')} as answer from asr), p as (
            select segment_id, case when trim(coalesce(video_id, '')) = '' then 'an answer needs a video id' when start_ms < 0 then 'frame indexes and times cannot be negative'
                when coalesce(answer, '') = '' then 'a Q&A row needs an answer' when contains(answer, '-') then 'a Q&A answer that is sent cannot contain ''-''' end as problem from t
        ) select * from p where problem is not null""",
    "vector_norms": """with n as (select id, vector::double[] as v, sqrt(list_dot_product(vector::double[], vector::double[])) as length from milvus_index where vector is not null)
        select id, round(length, 5) as length, case when length > 0 then 1.0::double else 0.0::double end as after, case when length > 0 then 1.0::double end as same from n""",
}

"""Queries of shots, keyframe slots, the quality gate and near-duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinequery.functions.numbers import entropy_bits, frame_time_ms, keyframe_id
from cinequery.operators import preprocess
from cinequery.plans import views
from cinequery.plans.retrieval import Query
from cinequery.plans.views import QUALITY, sql_view
from cinequery.sources.tables import table

GAP, RADIUS, DISTANCE = 100, 40, 6


def kf_indexed(s: SparkSession, d: str) -> DataFrame:
    """Indexed keyframes, the filter pushed to the scan."""
    return table(s, d, "keyframes").where("indexed").select("video_id", "keyframe_id", "frame_index", "time_ms").dropDuplicates(["keyframe_id"])


def kf_middle(s: SparkSession, d: str) -> DataFrame:
    slots = preprocess.middle_slots(table(s, d, "shots"))
    return slots.select("video_id", "shot_id", F.col("low").alias("frame_index"), keyframe_id(F.col("video_id"), F.col("low")).alias("keyframe_id"))


def kf_dense(s: SparkSession, d: str) -> DataFrame:
    return preprocess.dense_slots(table(s, d, "shots"), GAP, RADIUS)


def kf_sharpest(s: SparkSession, d: str) -> DataFrame:
    """Of the measured frames, the sharpest of each slot."""
    return preprocess.sharpest(views.keyframes(s, d), table(s, d, "shots"), GAP, RADIUS)


def kf_times(s: SparkSession, d: str) -> DataFrame:
    """Exact times from pts and time base, else from the frame number and the video's rate."""
    rates = table(s, d, "videos").select("video_id", "fps")
    rows = views.keyframes(s, d).join(rates, "video_id", "left")
    time = frame_time_ms(F.col("pts"), F.col("time_base"), F.col("frame_index"), F.col("fps"))
    return rows.select("keyframe_id", time.alias("time_ms"), F.when(F.col("pts").isNull(), "fps").otherwise("pts").alias("time_source"))


def quality_gate(s: SparkSession, d: str) -> DataFrame:
    return views.keyframes(s, d).select("keyframe_id", preprocess.rejection(QUALITY).alias("reason"))


def near_dup(s: SparkSession, d: str) -> DataFrame:
    """Groups of near-duplicates over all keyframes, also those without a hash."""
    return preprocess.near_duplicates(views.keyframes(s, d), DISTANCE).select("keyframe_id", "group_no", "indexed")


def each_alone(s: SparkSession, d: str) -> DataFrame:
    return preprocess.each_alone(views.keyframes(s, d)).select("keyframe_id", "group_no", "indexed")


def reselect(s: SparkSession, d: str) -> DataFrame:
    """The gate and the groups anew, from the stored measurements of all keyframes."""
    return preprocess.reselect(views.keyframes(s, d), QUALITY, DISTANCE).select("keyframe_id", "rejected", "group_no", "indexed")


def shot_cover(s: SparkSession, d: str) -> DataFrame:
    """All shots, without their first and last frames, as scenes with gaps that are tiled again."""
    shots = table(s, d, "shots")
    frames = shots.groupBy("video_id").agg((F.max("end_frame") + 10).alias("frames"))
    scenes = frames.join(shots.select("video_id", (F.col("start_frame") + 3).alias("start"), (F.col("end_frame") - 2).alias("end")), "video_id", "left")
    return preprocess.cover(scenes, "video_id", "frames").select("video_id", F.col("shot_id").cast("long"), "start_frame", "end_frame")


def shot_times(s: SparkSession, d: str) -> DataFrame:
    """By each video's own rate."""
    shots = table(s, d, "shots").select("video_id", "shot_id", "start_frame", "end_frame")
    rates = table(s, d, "videos").select("video_id", "fps")
    return preprocess.shot_times(shots.join(rates, "video_id", "left"), F.col("fps")).drop("fps")


def entropy(s: SparkSession, d: str) -> DataFrame:
    """Entropy in bits of the histogram of brightness (16 bins) of each video's keyframes."""
    bins = views.keyframes(s, d).groupBy("video_id", F.floor(F.col("brightness") / 16).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = bins.groupBy("video_id").agg(F.sum("n").alias("all"))
    return bins.join(total, "video_id").groupBy("video_id").agg((F.round(F.sum(entropy_bits(F.col("n") / F.col("all"))), 4) + 0.0).alias("bits"))


QUERIES: dict[str, Query] = {
    "kf_indexed": kf_indexed,
    "kf_middle": kf_middle,
    "kf_dense": kf_dense,
    "kf_sharpest": kf_sharpest,
    "kf_times": kf_times,
    "quality_gate": quality_gate,
    "near_dup": near_dup,
    "each_alone": each_alone,
    "reselect": reselect,
    "shot_cover": shot_cover,
    "shot_times": shot_times,
    "entropy": entropy,
}

_GATE = f"""case when sharpness < {QUALITY['min_sharpness']} then 'blur' when brightness < {QUALITY['min_brightness']} then 'dark'
    when brightness > {QUALITY['max_brightness']} then 'bright' when entropy < {QUALITY['min_entropy']} then 'flat' end"""
_SLOTS = f"""slots as (
    select video_id, shot_id, i as slot_no, greatest(start_frame, first + i * {GAP} - {RADIUS}) as low, least(end_frame, first + i * {GAP} + {RADIUS}) as high
    from (
        select *, start_frame + (end_frame - start_frame + 1 - (n - 1) * {GAP}) // 2 as first from (select *, greatest(1, (end_frame - start_frame + 1) // {GAP}) as n from shots)
    ), unnest(range(n)) as t(i)
)"""


def _groups(gate: str) -> str:
    return f"""with {sql_view('kf')}, judged as (select * exclude (rejected, group_no, indexed), {gate} as rejected from kf),
    kept as (select *, ('0x' || lpad(lower(dhash), 16, '0'))::ubigint as h from judged where rejected is null),
    flagged as (select *, case when bit_count(xor(h, lag(h) over (partition by video_id, shot_id order by frame_index))) <= {DISTANCE} then 0 else 1 end as fresh from kept),
    numbered as (select *, sum(fresh) over (partition by video_id order by shot_id, frame_index) - 1 as g from flagged),
    chosen as (select *, row_number() over (partition by video_id, g order by sharpness desc, frame_index) = 1 as best from numbered)
    select j.keyframe_id, j.rejected, c.g::bigint as group_no, coalesce(c.best, false) as indexed from judged j left join chosen c using (keyframe_id)"""


SQL: dict[str, str] = {
    "kf_indexed": "select distinct video_id, keyframe_id, frame_index, time_ms from keyframes where indexed",
    "kf_middle": "select video_id, shot_id, (start_frame + end_frame) // 2 as frame_index, printf('%s_%06d', video_id, (start_frame + end_frame) // 2) as keyframe_id from shots",
    "kf_dense": f"with {_SLOTS} select * from slots",
    "kf_sharpest": f"""with {sql_view('kf')}, {_SLOTS} select video_id, shot_id, slot_no, keyframe_id, frame_index, sharpness
        from slots join kf using (video_id, shot_id) where frame_index between low and high
        qualify row_number() over (partition by video_id, shot_id, slot_no order by sharpness desc, frame_index, keyframe_id) = 1""",
    "kf_times": f"""with {sql_view('kf')}, rated as (
            select kf.*, split_part(fps, '/', 1)::bigint as num, coalesce(nullif(split_part(fps, '/', 2), ''), '1')::bigint as den,
                split_part(time_base, '/', 1)::bigint as tn, split_part(time_base, '/', 2)::bigint as td
            from kf left join videos using (video_id)
        ), parts as (select *, case when pts is not null then pts * tn * 1000 else frame_index * den * 1000 end as a, case when pts is not null then td else num end as b from rated)
        select keyframe_id, case when (a % b) * 2 > b or ((a % b) * 2 = b and (a // b) % 2 = 1) then a // b + 1 else a // b end as time_ms,
            case when pts is null then 'fps' else 'pts' end as time_source from parts""",
    "quality_gate": f"with {sql_view('kf')} select keyframe_id, {_GATE} as reason from kf",
    "near_dup": f"select keyframe_id, group_no, indexed from ({_groups('rejected')})",
    "each_alone": f"""with {sql_view('kf')}, kept as (select keyframe_id, row_number() over (partition by video_id order by shot_id, frame_index) - 1 as g from kf where rejected is null)
        select keyframe_id, g as group_no, g is not null as indexed from kf left join kept using (keyframe_id)""",
    "reselect": _groups(_GATE),
    "shot_cover": """with scenes as (select video_id, start_frame + 3 as s, end_frame - 2 as e from shots), n as (select video_id, max(end_frame) + 10 as frames from shots group by video_id),
        clipped as (select video_id, frames, greatest(s, 0) as s, least(e, frames - 1) as e from scenes join n using (video_id) where s <= e and s < frames and e >= 0),
        cuts as (select *, row_number() over w as k, lead(s) over w as next_s, lag(e) over w as last_e from clipped window w as (partition by video_id order by s, e))
        select video_id, k - 1 as shot_id, case when k = 1 then 0 else (last_e + s) // 2 + 1 end as start_frame, coalesce((e + next_s) // 2, frames - 1) as end_frame from cuts
        union all select video_id, 0, 0, frames - 1 from n anti join clipped using (video_id)""",
    "shot_times": """with rated as (
            select shots.*, split_part(fps, '/', 1)::bigint as n, coalesce(nullif(split_part(fps, '/', 2), ''), '1')::bigint as d from shots left join videos using (video_id)
        ), timed as (
            select *, start_frame * d * 1000 as a, (end_frame + 1) * d * 1000 as z from rated
        ), rounded as (
            select *, case when (a % n) * 2 > n or ((a % n) * 2 = n and (a // n) % 2 = 1) then a // n + 1 else a // n end as start_at,
                case when (z % n) * 2 > n or ((z % n) * 2 = n and (z // n) % 2 = 1) then z // n + 1 else z // n end as end_at from timed
        )
        select video_id, shot_id, start_frame, end_frame, start_at as start_ms, coalesce(lead(start_at) over (partition by video_id order by shot_id), end_at) as end_ms from rounded""",
    "entropy": f"""with {sql_view('kf')}, bins as (select video_id, floor(brightness / 16) as bin, count(*) as n from kf group by all)
        select video_id, round(-sum(p * log2(p)), 4) + 0.0::double as bits from (select video_id, n / sum(n) over (partition by video_id) as p from bins) group by video_id""",
}

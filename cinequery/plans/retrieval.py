"""Queries of vector search, rankings, fusion, shaping and event chains."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinequery.operators import evaluate, fusion, hits, submission, trake, vector_search
from cinequery.plans import views
from cinequery.plans.views import DEPTH, LANES, ROWS, RRF_K, sql_view
from cinequery.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
_ORDER = lambda: [F.col("score").desc(), F.col("frame_index"), F.col("hit_id")]
_IDS = lambda: F.array_join(F.transform("others", lambda x: x["keyframe_id"]), ",").alias("others")


def _example(s: SparkSession, d: str, count: int = 1) -> DataFrame:
    return vector_search.examples(table(s, d, "milvus_index"), count)


def vec_topk(s: SparkSession, d: str) -> DataFrame:
    """The 50 frames nearest to each row whose id is divisible by 100, out of all."""
    found = vector_search.search(views.vectors(s, d), vector_search.every_hundredth(table(s, d, "milvus_index")), 50)
    return found.select("query_id", "rank", "keyframe_id", F.round("score", 6).alias("score"))


def vec_in_video(s: SparkSession, d: str) -> DataFrame:
    found = vector_search.search(views.vectors(s, d), _example(s, d), 50, "L21_V001")
    return found.select("query_id", "rank", "keyframe_id", F.round("score", 6).alias("score"))


def _visual(s: SparkSession, d: str, count: int = 1) -> DataFrame:
    scored = vector_search.scored_frames(views.vectors(s, d), _example(s, d, count), keep=hits.MAX_LIMIT)
    return hits.frame_lane(scored, ["query_id"], DEPTH, [F.round("score", 12).desc(), F.col("keyframe_id")])


def visual_lane(s: SparkSession, d: str) -> DataFrame:
    return _visual(s, d, 3).select("query_id", "rank", "video_id", "shot_id", "keyframe_id", F.round("score", 6).alias("score"), _IDS())


def kis_visual(s: SparkSession, d: str) -> DataFrame:
    """Known-item search by example: result rows of one visual query."""
    return hits.shape(_visual(s, d), ["query_id"], ROWS).select("row", "video_id", "shot_id", "keyframe_id", "frame_index", "time_ms")


def group_by_shot(s: SparkSession, d: str) -> DataFrame:
    """Every hit of every query and lane, collapsed to shots in the order of their best hit; a hit delivered again counts once."""
    best = F.min(F.struct((-F.col("score")).alias("down"), "frame_index", "hit_id", "keyframe_id", "score")).alias("_b")
    shots = views.hits(s, d).groupBy("query_id", "lane", "video_id", "shot_id").agg(best, (F.count_distinct("hit_id") - 1).alias("spares"))
    ranked = hits.rank_all(shots.select("query_id", "lane", "video_id", "shot_id", "_b.*", "spares"), ["query_id", "lane"], [F.col("down"), F.col("frame_index"), F.col("hit_id")])
    return ranked.select("query_id", "lane", "rank", "video_id", "shot_id", "keyframe_id", "score", "spares")


def _lanes(s: SparkSession, d: str, lanes: tuple[str, ...]) -> DataFrame:
    rows = views.hits(s, d).where(F.col("lane").isin(*lanes))
    ranked = hits.frame_lane(rows, ["query_id", "lane"], DEPTH, _ORDER())
    number = F.coalesce(*(F.when(F.col("lane") == lane, F.lit(i)) for i, lane in enumerate(lanes)))
    return ranked.withColumn("lane_no", number)


def _rrf(lanes: tuple[str, ...]) -> Query:
    def query(s: SparkSession, d: str) -> DataFrame:
        fused = fusion.fuse(_lanes(s, d, lanes), ["query_id"], RRF_K)
        return fused.select("query_id", "rank", "video_id", "shot_id", "keyframe_id", F.round("score", 12).alias("score"), _IDS())

    return query


def result_shape(s: SparkSession, d: str) -> DataFrame:
    """Fused result rows of every query at once."""
    fused = fusion.fuse(_lanes(s, d, LANES), ["query_id"], RRF_K)
    return hits.shape(fused, ["query_id"], ROWS).select("query_id", "row", "video_id", "shot_id", "keyframe_id")


def video_spread(s: SparkSession, d: str) -> DataFrame:
    fused = fusion.fuse(_lanes(s, d, LANES), ["query_id"], RRF_K)
    return hits.video_spread(fused, ["query_id"], 5, 2).select("query_id", F.col("place").alias("row"), "video_id", "shot_id")


def kis_spread(s: SparkSession, d: str) -> DataFrame:
    """Result rows with the tail spread over the videos, spares last."""
    fused = fusion.fuse(_lanes(s, d, LANES), ["query_id"], RRF_K)
    return hits.shape(fused, ["query_id"], ROWS, (5, 2)).select("query_id", "row", "video_id", "shot_id", "keyframe_id")


def recall_at_k(s: SparkSession, d: str) -> DataFrame:
    """How far each query's shaped rows find what its own visual lane put first."""
    best = _lanes(s, d, LANES).where("lane_no = 0 and rank = 1").select("query_id", F.col("video_id").alias("_v"), F.col("shot_id").alias("_s"))
    rows = result_shape(s, d).join(best, "query_id").withColumn("row_score", F.when((F.col("video_id") == F.col("_v")) & (F.col("shot_id") == F.col("_s")), 1.0).otherwise(0.0))
    return evaluate.recall_at(rows, ["query_id"]).select("query_id", "r1", "r5", "r20", "r50", "r100", F.round("mean", 6).alias("mean"))


# -- event chains

EVENTS = 3


def _chain_scores(s: SparkSession, d: str) -> DataFrame:
    index, events = views.vectors(s, d), _example(s, d, EVENTS)
    videos = trake.candidate_videos(index, events, DEPTH, ROWS).select("video_id")
    return trake.event_scores(index.join(F.broadcast(videos), "video_id", "left_semi"), events, EVENTS)


def trake_videos(s: SparkSession, d: str) -> DataFrame:
    found = trake.candidate_videos(views.vectors(s, d), _example(s, d, EVENTS), DEPTH, ROWS)
    return found.select("rank", "video_id", F.round("total", 6).alias("total"))


def _chains(steps: trake.Steps) -> Query:
    def query(s: SparkSession, d: str) -> DataFrame:
        found = trake.chains(_chain_scores(s, d), EVENTS, steps)
        return found.select("video_id", "first_frame", F.round("score", 6).alias("score"), F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))

    return query


def _search(spread: bool) -> Query:
    def query(s: SparkSession, d: str) -> DataFrame:
        found = trake.trake(views.vectors(s, d), _example(s, d, EVENTS), EVENTS, trake.Steps(), DEPTH, ROWS, spread)
        return found.select("rank", "video_id", "first_frame", F.round("score", 6).alias("score"), F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))

    return query


# -- answers


def answer_kis(s: SparkSession, d: str) -> DataFrame:
    return submission.kis(kis_visual(s, d), 1)


def answer_qa(s: SparkSession, d: str) -> DataFrame:
    return submission.qa(kis_visual(s, d), F.lit("  Hà Nội,   Việt Nam "), 1)


def answer_trake(s: SparkSession, d: str) -> DataFrame:
    found = trake.trake(views.vectors(s, d), _example(s, d, EVENTS), EVENTS, trake.Steps(), DEPTH, ROWS)
    return submission.trake(found, 1)


QUERIES: dict[str, Query] = {
    "vec_topk": vec_topk,
    "vec_in_video": vec_in_video,
    "visual_lane": visual_lane,
    "kis_visual": kis_visual,
    "group_by_shot": group_by_shot,
    "rrf_two": _rrf(LANES[:2]),
    "rrf_three": _rrf(LANES),
    "result_shape": result_shape,
    "video_spread": video_spread,
    "kis_spread": kis_spread,
    "recall_at_k": recall_at_k,
    "trake_videos": trake_videos,
    "trake_chains": _chains(trake.Steps()),
    "trake_gap": _chains(trake.Steps.of("strict", 2_000, 30_000)),
    "trake_loose": _chains(trake.Steps.of("loose")),
    "trake_topk": _search(False),
    "trake_spread": _search(True),
    "answer_kis": answer_kis,
    "answer_qa": answer_qa,
    "answer_trake": answer_trake,
}


# -- SQL

_QUERY = "qv as (select row_number() over (order by id) as query_id, v as q from (select * from ix order by id limit {n}))"
_SCORED = """scored as (
    select query_id, keyframe_id, video_id, shot_id, frame_index, time_ms,
        list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))) as score
    from ix, qv
)"""
_STEPS = sorted({min(DEPTH * 2**i, hits.MAX_LIMIT) for i in range(16)})


def _lane_sql(source: str, by: str, order: str, name: str = "shots") -> str:
    """Common table expressions that end in the lane's ranked shots."""
    limit = " ".join(f"when reach <= {x} then {x}" for x in _STEPS)
    return f"""
    {name}_r as (select *, row_number() over (partition by {by} order by {order}) as r from {source}),
    {name}_f as (select {by}, video_id, shot_id, min(r) as f from {name}_r where r <= {hits.MAX_LIMIT} group by all),
    {name}_l as (
        select {by}, case {limit} else {hits.MAX_LIMIT} end as upto
        from (select {by}, (list_sort(list(f)))[{DEPTH}] as reach from {name}_f group by {by})
    ),
    {name}_k as (select a.* from {name}_r a join {name}_l b using ({by}) where r <= upto),
    {name}_g as (
        select {by}, video_id, shot_id, min(r) as f, arg_min(keyframe_id, r) as keyframe_id, arg_min(frame_index, r) as frame_index,
            arg_min(time_ms, r) as time_ms, arg_min(score, r) as score, list(keyframe_id order by r)[2:] as other_ids,
            list(frame_index order by r)[2:] as other_frames, list(time_ms order by r)[2:] as other_times
        from {name}_k group by {by}, video_id, shot_id
    ),
    {name} as (
        select * from (select *, row_number() over (partition by {by} order by f) as rank from {name}_g) where rank <= {DEPTH}
    )"""


def _visual_sql(n: int) -> str:
    return f"with {sql_view('ix')}, {_QUERY.format(n=n)}, {_SCORED}, {_lane_sql('scored', 'query_id', 'round(score, 12) desc, keyframe_id')}"


_OTHERS = "coalesce(array_to_string(other_ids, ','), '') as others"


def _fused_sql(lanes: tuple[str, ...]) -> str:
    number = " ".join(f"when '{lane}' then {i}" for i, lane in enumerate(lanes))
    chosen = ", ".join(f"'{lane}'" for lane in lanes)
    return f"""with {sql_view('ht')}, wanted as (select * from ht where lane in ({chosen})),
    {_lane_sql('wanted', 'query_id, lane', 'score desc, frame_index, hit_id')},
    numbered as (select *, case lane {number} end as lane_no from shots),
    summed as (
        select query_id, video_id, shot_id, list_sum(list_sort(list(1.0::double / ({RRF_K}::double + rank)))) as total, min(rank) as best
        from numbered group by query_id, video_id, shot_id
    ),
    kept as (select * from numbered qualify row_number() over (partition by query_id, video_id, shot_id order by rank, lane_no) = 1),
    fused as (
        select k.* exclude (rank, score), total as score, best,
            row_number() over (partition by query_id order by total desc, best, video_id, shot_id) as rank
        from summed join kept k using (query_id, video_id, shot_id)
    )"""


def _shape_sql(fused: str = "fused", place: str = "rank") -> str:
    return f"""
    parts as (
        select query_id, video_id, shot_id, keyframe_id, frame_index, time_ms, 0 as part, {place} as a, 0 as b from {fused}
        union all
        select query_id, video_id, shot_id, other_ids[i], other_frames[i], other_times[i], 1, rank, i from {fused}, unnest(range(1, len(other_ids) + 1)) as t(i)
    ),
    shaped as (select * from (select *, row_number() over (partition by query_id order by part, a, b) as row from parts) where row <= {ROWS})"""


_SPREAD = """
    spread as (
        select *, row_number() over (partition by query_id order by turn, seen, rank) as place from (
            select *, case when rank > 5 then (row_number() over (partition by query_id, rank > 5, video_id order by rank) - 1) // 2 else -1 end as turn,
                case when rank > 5 then min(rank) over (partition by query_id, rank > 5, video_id) else 0 end as seen
            from fused
        )
    )"""

_FUSED = _fused_sql(LANES)

_TRAKE = f"""with {sql_view('ix')}, {_QUERY.format(n=EVENTS)}, {_SCORED},
    near as (select * from scored qualify row_number() over (partition by query_id order by round(score, 12) desc, keyframe_id) <= {DEPTH}),
    totals as (select video_id, sum(best) as total from (select query_id, video_id, max(score) as best from near group by all) group by video_id),
    videos as (select * from (select *, row_number() over (order by round(total, 12) desc, video_id) as rank from totals) where rank <= {ROWS}),
    dots as (select query_id, video_id, frame_index, time_ms, list_dot_product(v, q) as s from ix semi join videos using (video_id), qv),
    e1 as (select * from dots where query_id = 1), e2 as (select * from dots where query_id = 2), e3 as (select * from dots where query_id = 3)"""


def _chains_sql(allowed: str) -> str:
    """Best chains by joining each event with all that may follow it."""
    return f"""{_TRAKE},
    tail as (
        select a.video_id, a.frame_index, a.time_ms, a.s + b.s as total, a.frame_index || ',' || b.frame_index as path
        from e2 a join e3 b on a.video_id = b.video_id and {allowed}
        qualify row_number() over (partition by a.video_id, a.frame_index order by b.s desc, b.frame_index) = 1
    ),
    chains as (
        select a.video_id, a.frame_index as first_frame, a.s + b.total as score, a.frame_index || ',' || b.path as path
        from e1 a join tail b on a.video_id = b.video_id and {allowed}
        qualify row_number() over (partition by a.video_id, a.frame_index order by b.total desc, b.frame_index) = 1
    )"""


_STRICT = "b.time_ms > a.time_ms"
_TURNS = f"""turns as (
        select *, row_number() over (partition by video_id order by round(score, 12) desc, first_frame) as turn, max(round(score, 12)) over (partition by video_id) as best from chains
    )"""


def _ranked_sql(order: str) -> str:
    return f"""{_chains_sql(_STRICT)}, {_TURNS}, ranked as (
        select * from (select row_number() over (order by {order}) as rank, * from turns where turn <= {ROWS}) where rank <= {ROWS}
    )"""


_TOPK = _ranked_sql("round(score, 12) desc, video_id, first_frame")
_KIS = f"{_visual_sql(1)}, {_shape_sql('shots')}"

SQL: dict[str, str] = {
    "vec_topk": f"""with {sql_view('ix')}, qv as (
            select distinct on (id) id as query_id, vector::double[] as q from milvus_index where id % 100 = 0 and list_max(list_transform(vector, lambda x: abs(x))) > 0
        ), {_SCORED}
        select query_id, row_number() over (partition by query_id order by round(score, 12) desc, keyframe_id) as rank, keyframe_id, round(score, 6) as score from scored qualify rank <= 50""",
    "vec_in_video": f"""with {sql_view('ix')}, {_QUERY.format(n=1)}, {_SCORED}
        select query_id, row_number() over (partition by query_id order by round(score, 12) desc, keyframe_id) as rank, keyframe_id, round(score, 6) as score
        from scored where video_id = 'L21_V001' qualify rank <= 50""",
    "visual_lane": f"{_visual_sql(3)} select query_id, rank, video_id, shot_id, keyframe_id, round(score, 6) as score, {_OTHERS} from shots",
    "kis_visual": f"{_KIS} select row, video_id, shot_id, keyframe_id, frame_index, time_ms from shaped",
    "group_by_shot": f"""with {sql_view('ht')}, r as (select *, row_number() over (partition by query_id, lane order by score desc, frame_index, hit_id) as r from ht),
        g as (select query_id, lane, video_id, shot_id, min(r) as f, arg_min(keyframe_id, r) as keyframe_id, arg_min(score, r) as score, count(*) - 1 as spares from r group by all)
        select query_id, lane, row_number() over (partition by query_id, lane order by f) as rank, video_id, shot_id, keyframe_id, score, spares from g""",
    "rrf_two": f"{_fused_sql(LANES[:2])} select query_id, rank, video_id, shot_id, keyframe_id, round(score, 12) as score, {_OTHERS} from fused",
    "rrf_three": f"{_FUSED} select query_id, rank, video_id, shot_id, keyframe_id, round(score, 12) as score, {_OTHERS} from fused",
    "result_shape": f"{_FUSED}, {_shape_sql()} select query_id, row, video_id, shot_id, keyframe_id from shaped",
    "video_spread": f"{_FUSED}, {_SPREAD} select query_id, place as row, video_id, shot_id from spread",
    "kis_spread": f"{_FUSED}, {_SPREAD}, {_shape_sql('spread', 'place')} select query_id, row, video_id, shot_id, keyframe_id from shaped",
    "recall_at_k": f"""{_FUSED}, {_shape_sql()}, first as (select query_id, video_id as v, shot_id as s from numbered where lane_no = 0 and rank = 1),
        judged as (select query_id, row, case when video_id = v and shot_id = s then 1.0::double else 0.0::double end as x from shaped join first using (query_id)),
        best as (
            select query_id, {', '.join(f'coalesce(max(case when row <= {k} then x end), 0.0::double) as r{k}' for k in evaluate.DEPTHS)} from judged group by query_id
        )
        select *, round((r1 + r5 + r20 + r50 + r100) / 5, 6) as mean from best""",
    "trake_videos": f"{_TRAKE} select rank, video_id, round(total, 6) as total from videos",
    "trake_chains": f"{_chains_sql(_STRICT)} select video_id, first_frame, round(score, 6) as score, path from chains",
    "trake_gap": f"{_chains_sql('b.time_ms >= a.time_ms + 2000 and b.time_ms <= a.time_ms + 30000')} select video_id, first_frame, round(score, 6) as score, path from chains",
    "trake_loose": f"{_chains_sql('b.time_ms >= a.time_ms')} select video_id, first_frame, round(score, 6) as score, path from chains",
    "trake_topk": f"{_TOPK} select rank, video_id, first_frame, round(score, 6) as score, path from ranked",
    "trake_spread": f"{_ranked_sql('turn, best desc, video_id')} select rank, video_id, first_frame, round(score, 6) as score, path from ranked",
    "answer_kis": f"""{_KIS} select row, video_id, frame_index + 1 as frame,
        '{{"mediaItemName":"' || video_id || '","start":' || time_ms || ',"end":' || time_ms || '}}' as sent from shaped""",
    "answer_qa": f"{_KIS} select row, video_id, frame_index + 1 as frame, 'Hà Nội, Việt Nam' as answer, 'QA-Hà Nội, Việt Nam-' || video_id || '-' || time_ms as sent from shaped",
    "answer_trake": f"""{_TOPK}, moved as (select rank, video_id, array_to_string(list_transform(string_split(path, ','), lambda x: (x::bigint + 1)::varchar), ',') as frames from ranked)
        select rank as row, video_id, frames, 'TR-' || video_id || '-' || frames as sent from moved""",
}

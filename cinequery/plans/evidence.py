"""Queries of keyword search and of the lines read, heard and seen."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinequery.functions.text import tokens
from cinequery.operators import bm25, documents, hits, vector_search
from cinequery.operators.engine import SearchEngine, box_frame, example_lane, keyword_lane, query_frame
from cinequery.plans import retrieval, views
from cinequery.plans.views import B, DEPTH, K1, KEYWORDS, PHRASES, ROWS, RRF_K, sql_tidy, sql_view, sql_words
from cinequery.sources.files import parse_query_text
from cinequery.sources.tables import fingerprint, keep_until_exit, shared_folder, table

PADDING_MS = 500


_STANDING: dict[tuple[int, str], str] = {}


def _index(s: SparkSession, d: str) -> bm25.KeywordIndex:
    """The index of the lines of ``d``: built once a session and state of the table, then read from the shared folder."""
    key = (id(s.sparkContext), fingerprint(s, d, "shot_lines"))
    if key not in _STANDING:
        path = f"{shared_folder(s)}/keywords-{uuid.uuid4().hex}"
        bm25.build(views.lines(s, d, "ocr", "asr"), K1, B).save(path)
        keep_until_exit(s, path)
        _STANDING[key] = path
    return bm25.KeywordIndex.load(s, _STANDING[key], K1, B)


def bm25_postings(s: SparkSession, d: str) -> DataFrame:
    return bm25.build(views.lines(s, d, "ocr", "asr"), K1, B).postings.drop("length")


def bm25_stats(s: SparkSession, d: str) -> DataFrame:
    """Documents, average length and each term's documents, a lane."""
    index = _index(s, d)
    return bm25.frequencies(index).join(F.broadcast(index.stats), "lane").select("lane", "term", "holding", "documents", F.round("average", 6).alias("average"))


def bm25_topk(s: SparkSession, d: str) -> DataFrame:
    scored = bm25.score(_index(s, d), query_frame(s, KEYWORDS))
    best = hits.rank_rows(scored, ["query_id", "lane"], [F.round("score", 12).desc(), F.col("video_id"), F.col("shot_id")], DEPTH)
    return best.select(F.col("query_id").cast("long"), "lane", "rank", "video_id", "shot_id", F.round("score", 6).alias("score"))


def bm25_frame(s: SparkSession, d: str) -> DataFrame:
    """Keyword lanes: ranked shots on the keyframe where the words stand."""
    found = bm25.search(_index(s, d), query_frame(s, KEYWORDS), DEPTH)
    return found.select(F.col("query_id").cast("long"), "lane", "rank", "video_id", "shot_id", "keyframe_id", "frame_index", "matches")


def _engine(s: SparkSession, d: str) -> SearchEngine:
    index, frames = _index(s, d), views.vectors(s, d)
    return SearchEngine({"example": example_lane(frames), "ocr": keyword_lane(index, "ocr"), "asr": keyword_lane(index, "asr")}, RRF_K, DEPTH, ROWS)


def kis_fused(s: SparkSession, d: str) -> DataFrame:
    """A visual box (a known keyframe as the example) and an OCR box, fused and shaped."""
    first = vector_search.usable_vectors(table(s, d, "milvus_index")).orderBy("id").select("keyframe_id").first()
    found = _engine(s, d).search(box_frame(s, {1: {"example": first.keyframe_id if first else "", "ocr": KEYWORDS[1]}}))
    return found.select("row", "video_id", "shot_id", "keyframe_id")


def kis_engine(s: SparkSession, d: str) -> DataFrame:
    """A batch of queries through the engine: every evaluation item's text in the OCR and in the speech box."""
    boxes = table(s, d, "eval_items").select(F.col("item_id").alias("query_id"), F.explode(F.array(F.lit("ocr"), F.lit("asr"))).alias("lane"), "text")
    return _engine(s, d).search(boxes).select("query_id", "row", "video_id", "shot_id", "keyframe_id")


def text_fold(s: SparkSession, d: str) -> DataFrame:
    """Folded words of every document."""
    return table(s, d, "documents").select("doc_id", F.array_join(tokens(F.col("text")), " ").alias("words"))


def asr_drop(s: SparkSession, d: str) -> DataFrame:
    return documents.kept_segments(views.segments(s, d), PHRASES).select("segment_id", "text")


def asr_overlap(s: SparkSession, d: str) -> DataFrame:
    """Segments and the shots with an indexed keyframe that they touch."""
    shots = table(s, d, "shots").join(table(s, d, "keyframes").where("indexed").select("video_id", "shot_id").distinct(), ["video_id", "shot_id"], "left_semi")
    return documents.overlapping(views.segments(s, d), shots).select("segment_id", "video_id", "shot_id")


def asr_docs(s: SparkSession, d: str) -> DataFrame:
    found = documents.speech_lines(views.segments(s, d), table(s, d, "shots"), views.keyframes(s, d), PADDING_MS)
    return found.select("segment_id", "video_id", "shot_id", "heard", "keyframe_id", "frame_index")


def ocr_docs(s: SparkSession, d: str) -> DataFrame:
    return documents.ocr_lines(views.lines(s, d, "ocr"), views.keyframes(s, d)).select("video_id", "shot_id", "keyframe_id", "frame_index", "line_no", "text")


def object_docs(s: SparkSession, d: str) -> DataFrame:
    found = documents.object_lines(views.lines(s, d, "objects"), views.keyframes(s, d))
    return found.select("video_id", "shot_id", "label", "count", "keyframe_id", "frame_index")


def query_file(s: SparkSession, d: str) -> DataFrame:
    """Query files made of the evaluation items, read back: task from the name, events from the marked lines."""
    text = F.concat(F.lit("﻿E1: "), "text", F.lit("\n a note\n\tCảnh 2. "), "lang", F.lit("\ne3) "), "task", F.lit("\n"))
    files = table(s, d, "eval_items").select("item_id", F.concat(F.lit("query-"), "item_id", F.lit("-"), "task").alias("name"), text.alias("content"))
    parsed = parse_query_text(files, "name", "content")
    return parsed.select("item_id", "found_task", F.size("events").cast("long").alias("events"), F.array_join("events", "|").alias("joined"))


QUERIES: dict[str, retrieval.Query] = {
    "bm25_postings": bm25_postings,
    "bm25_stats": bm25_stats,
    "bm25_topk": bm25_topk,
    "bm25_frame": bm25_frame,
    "kis_fused": kis_fused,
    "kis_engine": kis_engine,
    "text_fold": text_fold,
    "asr_drop": asr_drop,
    "asr_overlap": asr_overlap,
    "asr_docs": asr_docs,
    "ocr_docs": ocr_docs,
    "object_docs": object_docs,
    "query_file": query_file,
}


_KEYWORDS = f"(values {', '.join(f'({i}::bigint, {chr(39)}{text}{chr(39)})' for i, text in KEYWORDS.items())}) as q(query_id, text)"


def _bm25(lanes: str, asked: str = _KEYWORDS) -> str:
    return f"""with {sql_view('ln')}, worded as (select lane, video_id, shot_id, keyframe_id, frame_index, {sql_words('text')} as w from ln where lane in ({lanes})),
    postings as (select lane, video_id, shot_id, term, count(*) as tf from (select lane, video_id, shot_id, unnest(w) as term from worded) group by all),
    lengths as (select lane, video_id, shot_id, sum(len(w)) as length from worded group by all),
    stats as (select lane, count(*) as documents, avg(length) as average from lengths group by lane),
    holding as (select lane, term, count(*) as holding from postings group by all),
    asked as (select query_id, list_distinct({sql_words('text')}) as w from {asked}),
    terms as (select query_id, unnest(w) as term from asked),
    weighed as (
        select query_id, lane, video_id, shot_id,
            sum(ln(1 + (documents - holding + 0.5::double) / (holding + 0.5::double)) * (tf * {K1 + 1}::double / (tf + {K1}::double * ({1 - B}::double + {B}::double * length / average)))) as score
        from terms join postings using (term) join holding using (lane, term) join lengths using (lane, video_id, shot_id) join stats using (lane) group by all
    ),
    best as (select * from (select *, row_number() over (partition by query_id, lane order by round(score, 12) desc, video_id, shot_id) as rank from weighed) where rank <= {DEPTH}),
    stood as (
        select query_id, lane, video_id, shot_id, rank, score, keyframe_id, min(frame_index) as frame_index, sum(len(list_intersect(list_distinct(worded.w), asked.w))) as matches
        from best join worded using (lane, video_id, shot_id) join asked using (query_id) group by all
    ),
    framed as (select * from stood qualify row_number() over (partition by query_id, lane, video_id, shot_id order by matches desc, frame_index, keyframe_id) = 1)"""


_BOTH = _bm25("'ocr', 'asr'")
_PAIRS = f"""with {sql_view('sg')}, {sql_view('kf')}, pairs as (
    select segment_id, video_id, shot_id, least(greatest(g.start_ms, h.start_ms), h.end_ms) as heard
    from sg g join shots h using (video_id) where h.start_ms < g.end_ms + {{pad}} and h.end_ms > g.start_ms - {{pad}}
)"""
_PLACED = "placed as (select l.* exclude (shot_id, frame_index, time_ms), k.shot_id, k.frame_index from ln l join kf k using (video_id, keyframe_id) where k.indexed and lane = '{lane}')"

SQL: dict[str, str] = {
    "bm25_postings": f"{_BOTH} select * from postings",
    "bm25_stats": f"{_BOTH} select lane, term, holding, documents, round(average, 6) as average from holding join stats using (lane)",
    "bm25_topk": f"{_BOTH} select query_id, lane, rank, video_id, shot_id, round(score, 6) as score from best",
    "bm25_frame": f"{_BOTH} select query_id, lane, rank, video_id, shot_id, keyframe_id, frame_index, matches::bigint as matches from framed",
    "kis_fused": f"""{_bm25("'ocr'")}, {retrieval._visual_sql(1).removeprefix('with ')},
        both_lanes as (
            select 0 as lane_no, rank, video_id, shot_id, keyframe_id, other_ids from shots
            union all select 1, rank, video_id, shot_id, keyframe_id, null from framed where query_id = 1
        ),
        summed as (select video_id, shot_id, list_sum(list_sort(list(1.0::double / ({RRF_K}::double + rank)))) as total, min(rank) as top from both_lanes group by all),
        kept as (select * from both_lanes qualify row_number() over (partition by video_id, shot_id order by rank, lane_no) = 1),
        fused as (select k.* exclude (rank), row_number() over (order by total desc, top, video_id, shot_id) as rank from summed join kept k using (video_id, shot_id)),
        parts as (
            select video_id, shot_id, keyframe_id, 0 as part, rank as a, 0 as b from fused
            union all select video_id, shot_id, other_ids[i], 1, rank, i from fused, unnest(range(1, coalesce(len(other_ids), 0) + 1)) as t(i)
        )
        select * from (select row_number() over (order by part, a, b) as row, video_id, shot_id, keyframe_id from parts) where row <= {ROWS}""",
    "kis_engine": f"""{_bm25("'ocr', 'asr'", '(select item_id as query_id, text from eval_items)')},
        summed as (select query_id, video_id, shot_id, list_sum(list_sort(list(1.0::double / ({RRF_K}::double + rank)))) as total, min(rank) as top from framed group by all),
        kept as (select * from framed qualify row_number() over (partition by query_id, video_id, shot_id order by rank, lane desc) = 1)
        select * from (
            select query_id, row_number() over (partition by query_id order by total desc, top, video_id, shot_id) as row, video_id, shot_id, keyframe_id
            from summed join kept using (query_id, video_id, shot_id)
        ) where row <= {ROWS}""",
    "text_fold": f"select doc_id, array_to_string({sql_words('text')}, ' ') as words from documents",
    "asr_drop": f"""with {sql_view('sg')}, t as (select segment_id, {sql_tidy('text')} as text from sg)
        select * from t where text <> '' and not ({' or '.join(f"contains(lower(text), '{p.lower()}')" for p in PHRASES)})""",
    "asr_overlap": f"{_PAIRS.format(pad=0)} select segment_id, video_id, shot_id from pairs semi join (select video_id, shot_id from kf where indexed) using (video_id, shot_id)",
    "asr_docs": f"""{_PAIRS.format(pad=PADDING_MS)} select segment_id, video_id, shot_id, heard, keyframe_id, frame_index
        from pairs join (select * from kf where indexed) using (video_id, shot_id)
        qualify row_number() over (partition by segment_id, shot_id order by abs(time_ms - heard), frame_index) = 1""",
    "ocr_docs": f"""with {sql_view('ln')}, {sql_view('kf')}, {_PLACED.format(lane='ocr')}, keyed as (select *, array_to_string({sql_words('text')}, ' ') as key from placed)
        select video_id, shot_id, keyframe_id, frame_index, line_no, text from keyed where key <> ''
        qualify row_number() over (partition by video_id, shot_id, key order by score desc nulls last, frame_index, line_no, line_id) = 1""",
    "object_docs": f"""with {sql_view('ln')}, {sql_view('kf')}, {_PLACED.format(lane='objects')},
        counted as (select video_id, shot_id, keyframe_id, frame_index, text as label, count(*) as count from placed group by all)
        select * from counted qualify row_number() over (partition by video_id, shot_id, label order by count desc, frame_index, keyframe_id) = 1""",
    "query_file": r"""with files as (
            select item_id, 'query-' || item_id || '-' || task as name, 'E1: ' || text || chr(10) || ' a note' || chr(10) || chr(9) || 'Cảnh 2. ' || lang || chr(10) || 'e3) ' || task as content from eval_items
        ), parsed as (
            select item_id, lower(regexp_extract(name, '-(kis|qa|trake)$', 1, 'i')) as found_task,
                list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(regexp_extract(x, '^\s*(?:E|Cảnh\s*)\d+\s*[:.)\-–]?\s*(\S.*)$', 1, 'i'))), lambda x: x <> '') as events
            from files
        )
        select item_id, found_task, len(events) as events, array_to_string(events, '|') as joined from parsed""",
}

"""The search engine: a table of filled boxes to the result rows of all its queries, as one plan.

``boxes(query_id, lane, text)`` has a row for each box; lanes answer all queries at once. What is wrong
with a query is itself a table (``problems``), so a batch can be judged before anything is searched.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinequery.models import Encoder, embed_texts
from cinequery.operators import bm25, hits, vector_search
from cinequery.operators.fusion import fuse

RANKING = ["query_id", "rank", "video_id", "shot_id", "keyframe_id", "frame_index", "time_ms", "score", "others"]
#: Lanes answer ``asked(query_id, text)`` with a ranking of shots for each query, at most ``depth`` shots.
Lane = Callable[[DataFrame, int], DataFrame]


def _filled():
    return F.trim(F.coalesce("text", F.lit(""))) != ""


class Refused(ValueError):
    """Queries that cannot be answered as they stand."""


def vector_lane(index: DataFrame, vectors: Callable[[DataFrame], DataFrame]) -> Lane:
    """Shots of the frames nearest to a query's vector. ``vectors``: (query_id, text) to (query_id, query_vector)."""

    def search(asked: DataFrame, depth: int) -> DataFrame:
        scored = vector_search.scored_frames(index, vectors(asked), keep=hits.MAX_LIMIT)
        return hits.frame_lane(scored, ["query_id"], depth, [F.round("score", 12).desc(), F.col("keyframe_id")]).select(*RANKING)

    return search


def visual_lane(index: DataFrame, encoder: Callable[[], Encoder], translate: Callable[[str], str] | None = None) -> Lane:
    """Descriptions, translated where there is a translator, and encoded."""
    return vector_lane(index, lambda asked: embed_texts(asked, "text", encoder, translate).select("query_id", F.col("vector").alias("query_vector")))


def example_lane(index: DataFrame) -> Lane:
    """The box holds the id of a keyframe that is like the wanted one."""
    known = vector_search.usable_vectors(index).groupBy("keyframe_id").agg(F.min_by("vector", "id").alias("query_vector"))
    return vector_lane(index, lambda asked: asked.join(known, asked["text"] == known["keyframe_id"]).select("query_id", "query_vector"))


def keyword_lane(index: bm25.KeywordIndex, lane: str) -> Lane:
    return lambda asked, depth: bm25.search(index.of(lane), asked, depth).select(*RANKING)


def problems(boxes: DataFrame, lanes: Mapping[str, Lane], rrf_k: float | None) -> DataFrame:
    """(query_id, problem): queries that fill no box, fill an unknown one, or several without a fusion constant."""
    filled = boxes.withColumn("_lane", F.when(_filled(), F.col("lane")))
    seen = filled.groupBy("query_id").agg(
        F.count_distinct("_lane").alias("_n"), F.min(F.when(~F.col("_lane").isin(*lanes), F.col("_lane"))).alias("_odd")
    )
    why = F.when(F.col("_n") == 0, "no box is filled").when(F.col("_odd").isNotNull(), F.concat(F.lit("nothing answers the box "), "_odd"))
    if rrf_k is None:
        why = why.when(F.col("_n") > 1, "several boxes need the fusion constant fusion.rrf_k (60 where it was published)")
    return seen.withColumn("problem", why).where("problem is not null").select("query_id", "problem")


@dataclass(frozen=True)
class SearchEngine:
    lanes: Mapping[str, Lane]
    rrf_k: float | None = None
    depth: int = 100
    rows: int = 100
    spread: tuple[int, int] | None = None

    def rankings(self, boxes: DataFrame) -> DataFrame:
        """What each filled box finds, with the lane's place in the order of lanes. A box filled twice is searched as one text."""
        parts = boxes.where(_filled()).groupBy("query_id", "lane").agg(F.array_join(F.array_sort(F.collect_set("text")), " ").alias("text"))
        found: DataFrame | None = None
        for number, (name, search) in enumerate(self.lanes.items()):
            one = search(parts.where(F.col("lane") == name).select("query_id", "text"), self.depth).withColumn("lane_no", F.lit(number))
            found = one if found is None else found.unionByName(one)
        if found is None:
            raise Refused("the engine has no lanes")
        return found

    def search(self, boxes: DataFrame) -> DataFrame:
        """(query_id, row, frame columns). One box answers alone, in its own order; several are fused. All queries are judged first."""
        wrong = problems(boxes, self.lanes, self.rrf_k).orderBy("query_id").limit(5).collect()
        if wrong:
            raise Refused("; ".join(f"query {w.query_id}: {w.problem}" for w in wrong))
        # Fused with itself alone a ranking keeps its order, whatever the constant: shares fall with the rank.
        fused = fuse(self.rankings(boxes), ["query_id"], 60.0 if self.rrf_k is None else self.rrf_k)
        return hits.shape(fused, ["query_id"], self.rows, self.spread)


def query_frame(spark: SparkSession, texts: Mapping[int, str]) -> DataFrame:
    return spark.createDataFrame(list(texts.items()), "query_id int, text string")


def box_frame(spark: SparkSession, queries: Mapping[int, Mapping[str, str | None]]) -> DataFrame:
    """Boxes of a few queries: ``{query_id: {lane: text}}``."""
    rows = [(q, lane, text) for q, boxes in queries.items() for lane, text in (boxes or {"": None}).items()]
    return spark.createDataFrame(rows, "query_id int, lane string, text string")

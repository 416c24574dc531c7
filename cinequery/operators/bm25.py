"""Keyword search: one document a shot and lane, scored by BM25.

Lines come with ``lane, video_id, shot_id, line_no, text, keyframe_id, frame_index, time_ms``; the
index is three tables, so a search reads the postings of its own terms only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinequery.functions.numbers import inverse_frequency, term_weight
from cinequery.functions.text import tokens
from cinequery.operators.hits import rank_rows

DOCUMENT = ["lane", "video_id", "shot_id"]
#: Distinct query terms up to which their tables are broadcast, and up to which they are named to the scan.
BROADCAST_TERMS, PUSHED_TERMS = 100_000, 1_000
#: Chosen documents up to which their list is broadcast to the scan of their lines.
BROADCAST_DOCUMENTS = 200_000
#: Lanes are kinds of evidence, such as read, heard and seen.
MOST_LANES = 8


@dataclass
class KeywordIndex:
    """``postings(lane, video_id, shot_id, term, tf, length)``, ``stats(lane, documents, average)`` and the lines' words.

    A posting carries its document's length, so that a search reads the postings of its terms and nothing else.
    """

    postings: DataFrame
    stats: DataFrame
    lines: DataFrame
    k1: float
    b: float

    def save(self, folder: str) -> None:
        self.stats.write.mode("overwrite").parquet(f"{folder}/stats")
        self.lines.write.mode("overwrite").partitionBy("lane").parquet(f"{folder}/lines")
        # Sorted by term: a search for a few terms skips row groups by their minimum and maximum.
        self.postings.repartitionByRange("lane", "term").sortWithinPartitions("lane", "term").write.mode("overwrite").partitionBy("lane").parquet(f"{folder}/postings")

    @classmethod
    def load(cls, spark: SparkSession, folder: str, k1: float, b: float) -> KeywordIndex:
        return cls(*(spark.read.parquet(f"{folder}/{n}") for n in ("postings", "stats", "lines")), k1, b)

    def of(self, *lanes: str) -> KeywordIndex:
        """The index of some lanes."""
        return KeywordIndex(*(getattr(self, t).where(F.col("lane").isin(*lanes)) for t in ("postings", "stats", "lines")), self.k1, self.b)


def build(lines: DataFrame, k1: float = 1.2, b: float = 0.75) -> KeywordIndex:
    """Index of all lanes in ``lines``. A line without words still makes its shot a document."""
    worded = lines.select(*DOCUMENT, "keyframe_id", "frame_index", "time_ms", F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")).alias("words"))
    lengths = worded.groupBy(*DOCUMENT).agg(F.sum(F.size("words")).alias("length"))
    counted = worded.select(*DOCUMENT, F.explode("words").alias("term")).groupBy(*DOCUMENT, "term").agg(F.count(F.lit(1)).alias("tf"))
    stats = lengths.groupBy("lane").agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.nullif(F.avg("length"), F.lit(0.0)), F.lit(1.0)).alias("average"))
    return KeywordIndex(counted.join(lengths, DOCUMENT), stats, worded, k1, b)


def frequencies(index: KeywordIndex) -> DataFrame:
    """(lane, term, holding): documents that hold each term."""
    return index.postings.groupBy("lane", "term").agg(F.count(F.lit(1)).alias("holding"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term) for each distinct word of ``queries(query_id, text)``."""
    return queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))


def score(index: KeywordIndex, queries: DataFrame) -> DataFrame:
    """(query_id, lane, video_id, shot_id, score) of every document that holds a query word."""
    terms = query_terms(queries)
    wanted = terms.select("term").distinct()
    named = [r.term for r in wanted.limit(PUSHED_TERMS + 1).collect()]
    few = len(named) <= PUSHED_TERMS or terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    small = F.broadcast if few else lambda df: df
    if len(named) <= PUSHED_TERMS:
        found = index.postings.where(F.col("term").isin(named) if named else F.lit(False))
    else:
        found = index.postings.join(small(wanted), "term", "left_semi")
    holding = small(found.groupBy("lane", "term").agg(F.count(F.lit(1)).alias("holding")))  # a row a query term and lane
    weighed = (
        found.join(holding, ["lane", "term"])
        .join(F.broadcast(index.stats), "lane")  # one row a lane
        .select(
            *DOCUMENT,
            "term",
            (inverse_frequency(F.col("documents"), F.col("holding")) * term_weight(F.col("tf"), F.col("length"), F.col("average"), index.k1, index.b)).alias("weight"),
        )
    )
    return weighed.join(small(terms), "term").groupBy("query_id", *DOCUMENT).agg(F.sum("weight").alias("score"))


def search(index: KeywordIndex, queries: DataFrame, depth: int) -> DataFrame:
    """Ranked shots of each query and lane, each on the keyframe where it matched.

    The best ``depth`` by (score descending, video, shot); the keyframe whose lines hold the most
    distinct query words, the earlier on a tie. Lines are read for the chosen documents only.
    """
    scored = score(index, queries)
    if depth < 1:
        scored, depth = scored.where(F.lit(False)), 1
    by = ["query_id", "lane"]
    # Scores are sums of doubles in no fixed order; the twelfth digit decides nothing.
    best = rank_rows(scored, by, [F.round("score", 12).desc(), F.col("video_id"), F.col("shot_id")], depth)
    words = query_terms(queries).groupBy("query_id").agg(F.collect_set("term").alias("asked"))  # the words of one query
    chosen = best.join(words, "query_id")
    # Documents chosen are at most ``depth`` a query and lane.
    most = BROADCAST_DOCUMENTS // (depth * MOST_LANES)
    asked = queries.select("query_id").distinct().limit(most + 1).count()
    held = index.lines.join(F.broadcast(chosen) if asked <= most else chosen, DOCUMENT)
    matches = held.groupBy("query_id", *DOCUMENT, "rank", "score", "keyframe_id").agg(
        F.sum(F.size(F.array_intersect("asked", F.array_distinct("words")))).alias("matches"), F.min("frame_index").alias("frame_index"), F.min("time_ms").alias("time_ms")
    )
    stands = rank_rows(matches, ["query_id", *DOCUMENT], [F.col("matches").desc(), F.col("frame_index"), F.col("keyframe_id")], 1, "_r").drop("_r")
    none = F.array().cast("array<struct<rank:int,keyframe_id:string,frame_index:bigint,time_ms:bigint,score:double>>")
    return stands.select("query_id", *DOCUMENT, "rank", "keyframe_id", "frame_index", "time_ms", "score", "matches", none.alias("others"))

"""The pN_ queries of this package, with the parameters of production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinequery.llm import encode, leaks, lookalike, nearest, runs, sentences, topn, vectors
from cinequery.sources.tables import table

#: Rank file and word pattern of the tokenizer byte_bpe_50k, if the package with public vocabularies is there.
TOKENIZER = "byte_bpe_50k.tiktoken"


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = lookalike.same_looking_pairs(table(spark, folder, "shot_lines"), "line_id", ["video_id", "shot_id", "lane"], "text")
    return pairs.select(F.col("key_a").alias("line_id_a"), F.col("key_b").alias("line_id_b"))


def p1_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Every line with the one form of all that look like it."""
    return lookalike.canonical_form(table(spark, folder, "shot_lines").select("line_id", "text"), "text").select("line_id", "canonical").distinct()


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    times = F.explode(F.array(*(F.struct(F.lit(e).alias("edge"), F.col(f"{e}_ms").alias("at")) for e in ("start", "end"))))
    edges = table(spark, folder, "asr").select("segment_id", "video_id", times.alias("_e")).select("segment_id", "video_id", "_e.edge", "_e.at")
    frames = table(spark, folder, "keyframes").where("indexed").select("video_id", "time_ms", "keyframe_id")
    found = nearest.nearest_in_time(edges, frames, "video_id", ["segment_id", "edge"], "at", "time_ms", "keyframe_id", 800)
    key = F.from_json("key", "array<string>")
    return found.select(key[0].cast("long").alias("segment_id"), key[1].alias("edge"), F.col("right_id").alias("keyframe_id"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    found = vectors.similar_vectors(table(spark, folder, "milvus_index"), "keyframe_id", "vector", 5, least=0.9)
    a, b = F.col("key_a"), F.col("key_b")
    return found.select(F.least(a, b).alias("keyframe_id_a"), F.greatest(a, b).alias("keyframe_id_b")).distinct()


def p3_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten keyframes most similar to each row whose id is divisible by 100, however similar, out of all."""
    index = table(spark, folder, "milvus_index")
    found = vectors.similar_vectors(index, "keyframe_id", "vector", 10, asks=F.col("id") % 100 == 0, probes=24, margin=1.0, degree=16, build_beam=16, beam=200, exact=True)
    return found.select(F.col("key_a").alias("keyframe_id"), F.col("key_b").alias("neighbour_id"), F.round("similarity", 6).alias("similarity"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _runs(spark, folder, 2).select("video_id", F.col("first_key").alias("first_keyframe_id"), F.col("last_key").alias("last_keyframe_id"))


def p4_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Every run, also of one keyframe, with its number of keyframes and duration."""
    return _runs(spark, folder, 1).select("video_id", "shot_id", F.col("first_key").alias("first_keyframe_id"), F.col("last_key").alias("last_keyframe_id"), "events", "duration")


def _runs(spark: SparkSession, folder: str, least: int) -> DataFrame:
    frames = table(spark, folder, "keyframes").where("rejected is null")
    return runs.collapse_runs(frames, ["video_id", "shot_id"], "frame_index", "keyframe_id", "time_ms", "dhash", 6, least)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    best = topn.top_n(table(spark, folder, "shot_hits"), ["query_id", "video_id"], "score", ["frame_index", "hit_id"], 5)
    return best.select("query_id", "video_id", "hit_id")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return encode.encode_corpus(table(spark, folder, "documents"), "doc_id", "text", public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_spans(spark, folder).select("doc_id", "item_id").distinct()


def p7_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Every quotation with its offsets."""
    return leaks.find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"), "doc_id", "text", "item_id", "text", 12)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.split_sentences(table(spark, folder, "documents"), "doc_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit()}

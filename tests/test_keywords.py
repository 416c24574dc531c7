import math

import numpy as np
import pytest

from cinequery.operators import bm25, documents
from cinequery.operators.engine import Refused, SearchEngine, box_frame, example_lane, keyword_lane, problems, query_frame, visual_lane

LINES = "lane string, video_id string, shot_id bigint, line_no bigint, text string, keyframe_id string, frame_index bigint, time_ms bigint"


def lines(spark, rows):
    return spark.createDataFrame([("ocr", v, s, i, t, f"{v}_{f:06d}", f, f * 40) for i, (v, s, f, t) in enumerate(rows)], LINES)


ROWS = [("V1", 0, 10, "gia vang"), ("V1", 0, 20, "Giá vàng tăng"), ("V1", 1, 30, "giá xăng"), ("V2", 0, 5, "thời tiết hôm nay"), ("V2", 0, 6, "--")]


def test_score_is_the_formula(spark):
    index = bm25.build(lines(spark, ROWS), 1.2, 0.75)
    got = {(r.video_id, r.shot_id): r.score for r in bm25.score(index, query_frame(spark, {1: "giá GIA vàng"})).collect()}
    docs = {("V1", 0): "gia vang gia vang tang".split(), ("V1", 1): "gia xang".split(), ("V2", 0): "thoi tiet hom nay".split()}
    mean = sum(map(len, docs.values())) / 3
    for key, words in docs.items():
        want = 0.0
        for w in ("gia", "vang"):
            n, tf = sum(w in d for d in docs.values()), words.count(w)
            if tf:
                want += math.log(1 + (3 - n + 0.5) / (n + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean))
        assert got.get(key, 0.0) == pytest.approx(want)


def test_standing_keyframe_and_depth(spark):
    index = bm25.build(lines(spark, ROWS))
    got = bm25.search(index, query_frame(spark, {1: "giá vàng tăng", 2: "giá vàng", 3: "không"}), 10).collect()
    first = {r.query_id: r.keyframe_id for r in got if r["rank"] == 1}
    assert first == {1: "V1_000020", 2: "V1_000010"}
    assert bm25.search(index, query_frame(spark, {1: "giá"}), 0).count() == 0


def test_index_round_trip(spark, tmp_path):
    index = bm25.build(lines(spark, ROWS))
    index.save(str(tmp_path / "i"))
    again = bm25.KeywordIndex.load(spark, str(tmp_path / "i"), 1.2, 0.75)
    asked = query_frame(spark, {1: "giá"})
    assert sorted(map(tuple, bm25.search(again, asked, 5).drop("others").collect())) == sorted(map(tuple, bm25.search(index, asked, 5).drop("others").collect()))


def test_engine_judges_queries_before_it_searches(spark):
    class Fixed:
        dim = 2

        def encode_texts(self, texts):
            return np.array([[0.1, 1.0] if t == "x" else [1.0, 0.0] for t in texts], np.float32)

    index = bm25.build(lines(spark, ROWS))
    vectors = spark.createDataFrame([(1, [1.0, 0.0], "V1_000010", "V1", 0, 10, 400), (2, [0.0, 1.0], "V2_000005", "V2", 0, 5, 200)], "id long, vector array<float>, keyframe_id string, video_id string, shot_id long, frame_index long, time_ms long")
    lanes = {"ocr": keyword_lane(index, "ocr"), "visual": visual_lane(vectors, Fixed), "example": example_lane(vectors)}
    boxes = box_frame(spark, {1: {"ocr": "  ", "visual": None}, 2: {"sound": "x"}, 3: {"ocr": "giá", "visual": "x"}, 4: {"ocr": "giá"}})
    assert {r.query_id: r.problem for r in problems(boxes, lanes, None).collect()}.keys() == {1, 2, 3}
    assert {r.query_id for r in problems(boxes, lanes, 60.0).collect()} == {1, 2}
    with pytest.raises(Refused, match="query 1.*query 2.*sound"):
        SearchEngine(lanes, 60.0).search(boxes)
    alone = SearchEngine(lanes).search(box_frame(spark, {7: {"ocr": "thời tiết", "visual": ""}, 8: {"example": "V1_000010"}})).collect()
    assert [r.video_id for r in alone if r.query_id == 7] == ["V2"]
    assert [r.keyframe_id for r in sorted(alone, key=lambda r: r.row) if r.query_id == 8] == ["V1_000010", "V2_000005"]
    both = SearchEngine(lanes, 60.0).search(box_frame(spark, {3: {"ocr": "giá", "visual": "x"}})).orderBy("row").collect()
    assert {(r.video_id, r.shot_id) for r in both} == {("V1", 0), ("V1", 1), ("V2", 0)} and both[0].video_id == "V1"
    said = visual_lane(vectors, Fixed, lambda t: {"áo đỏ": "x"}[t])(query_frame(spark, {1: "áo đỏ"}), 5).orderBy("rank").collect()
    assert said[0].keyframe_id == "V2_000005"


SHOTS = "video_id string, shot_id bigint, start_ms bigint, end_ms bigint"
KEYS = "video_id string, keyframe_id string, shot_id bigint, frame_index bigint, time_ms bigint, indexed boolean"


@pytest.fixture
def video(spark):
    shots = spark.createDataFrame([("V", 0, 0, 2000), ("V", 1, 2000, 5000), ("V", 2, 5000, 8000), ("V", 3, 8000, 9000)], SHOTS)
    frames = [(12, 0, True), (37, 0, True), (63, 1, True), (113, 1, True), (150, 2, False), (213, 3, True)]
    return shots, spark.createDataFrame([("V", f"V_{f:06d}", s, f, f * 40, i) for f, s, i in frames], KEYS)


def test_speech(spark, video):
    shots, keys = video
    rows = [(9, "V", 8500, 10**15, "long"), (10, "V", -(10**15), -5, "before"), (1, "V", 100, 600, "a"), (2, "V", 1900, 2600, "b"), (3, "V", 5500, 6000, "c"), (4, "V", 2000, 2000, "d"), (5, "V", 2010, 2400, "e")]
    segments = spark.createDataFrame(rows, "segment_id int, video_id string, start_ms bigint, end_ms bigint, text string")
    got = {(r.segment_id, r.shot_id): r.frame_index for r in documents.speech_lines(segments, shots, keys).collect()}
    assert got.pop((9, 3)) == 213
    assert got == {(1, 0): 12, (2, 0): 37, (2, 1): 63, (5, 1): 63}
    padded = {(r.segment_id, r.shot_id): r.heard for r in documents.speech_lines(segments, shots, keys, 50).collect()}
    assert padded[(4, 0)] == 2000 and padded[(5, 0)] == 2000
    for cell in (1, 700, 10_000_000):
        pairs = documents.overlapping(segments, shots, 50, cell).select("segment_id", "shot_id").collect()
        assert len(pairs) == len(set(pairs)) == documents.overlapping(segments, shots, 50).count()


def test_ocr_and_objects(spark, video):
    _, keys = video
    schema = "line_id long, video_id string, keyframe_id string, line_no bigint, text string, score double"
    readings = spark.createDataFrame(
        [(1, "V", "V_000012", 0, "Bến Thành", 0.8), (2, "V", "V_000037", 0, "ben  THANH", 0.8), (3, "V", "V_000037", 1, "BẾN THÀNH!", 0.9), (4, "V", "V_000063", 0, "...", 0.9), (5, "V", "V_000150", 0, "x", 0.9), (6, "V", "V_000999", 0, "y", 0.9)],
        schema,
    )
    assert [(r.text, r.frame_index) for r in documents.ocr_lines(readings, keys).collect()] == [("BẾN THÀNH!", 37)]
    labels = [("V_000012", "person")] * 3 + [("V_000012", "car")] + [("V_000037", "person")] + [("V_000037", "dog")] * 2 + [("V_000150", "cat")]
    seen = spark.createDataFrame([(i, "V", k, 0, t, None) for i, (k, t) in enumerate(labels)], schema)
    got = documents.object_lines(seen, keys)
    assert sorted((r.label, r["count"], r.frame_index) for r in got.collect()) == [("car", 1, 12), ("dog", 2, 37), ("person", 3, 12)]
    assert documents.repeated(got).count() == 6
    said = spark.createDataFrame([(1, "Nhớ  bấm theo dõi!"), (2, " hay\nquá "), (3, " ")], "segment_id int, text string")
    assert [r.text for r in documents.kept_segments(said, ["nhớ bấm"]).collect()] == ["hay quá"]

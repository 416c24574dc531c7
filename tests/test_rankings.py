import random
from collections import OrderedDict, deque

import pytest
from pyspark.sql import functions as F

from cinequery.operators import evaluate, fusion, hits

RANKED = "q int, rank int, video_id string, shot_id bigint, keyframe_id string, frame_index bigint, time_ms bigint, score double"


def ranked(spark, lists):
    rows = [(q, r, v, s, f"{v}_{r}", r, r * 40, 1.0 - r / 100) for q, found in enumerate(lists) for r, (v, s) in enumerate(found, 1)]
    return spark.createDataFrame(rows, RANKED)


def literal_widening(found, depth, cap):
    """The loop: double the limit until it covers the depth."""
    limit = depth
    while True:
        frames = found[:limit]
        shots = OrderedDict()
        for r, shot in enumerate(frames, 1):
            shots.setdefault(shot, []).append(r)
        if len(shots) >= depth or len(frames) < limit or limit >= cap:
            return [(shot, places[0], places[1:]) for shot, places in list(shots.items())[:depth]]
        limit = min(limit * 2, cap)


def test_group_by_shot(spark):
    got = hits.group_by_shot(ranked(spark, [[("A", 1), ("B", 5), ("A", 2), ("A", 1)]]), ["q"]).orderBy("rank").collect()
    assert [(r.video_id, r.shot_id, r.frame_index, [o.frame_index for o in r.others]) for r in got] == [("A", 1, 1, [4]), ("B", 5, 2, []), ("A", 2, 3, [])]


def test_ranks_over_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.choice([0] * 8 + [1, 2]), rng.choice([None, rng.random()]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "q int, score double, id int").repartition(3)
    got = {r.id: r.rank for r in hits.rank_all(df, ["q"], [F.col("score").desc_nulls_last(), F.col("id")]).collect()}
    for q in range(3):
        own = sorted((r for r in rows if r[0] == q), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        assert [got[r[2]] for r in own] == list(range(1, len(own) + 1))
    assert hits.rank_all(df.limit(0), ["q"], [F.col("id")]).count() == 0


def test_widening_equals_the_loop(spark):
    rng = random.Random(5)
    lists = [[("V", rng.randint(0, rng.randint(1, 8))) for _ in range(rng.randint(0, 30))] for _ in range(120)]
    lists.append([("V", s) for s in (0, 0, 0, 0, 1, 2, 3, 3)])
    for depth, cap in ((1, 8), (3, 8), (4, 16384)):
        got = hits.frame_lane(ranked(spark, lists).drop("rank"), ["q"], depth, cap=cap).collect()
        found = {}
        for r in sorted(got, key=lambda r: (r.q, r.rank)):
            found.setdefault(r.q, []).append((("V", r.shot_id), r.frame_index, [o.frame_index for o in r.others]))
        for q, rows in enumerate(lists):
            assert found.get(q, []) == literal_widening(rows, depth, cap), (q, depth, cap)


def test_lane_of_depth_zero_is_empty(spark):
    assert hits.frame_lane(ranked(spark, [[("A", 1)]]).drop("rank"), ["q"], 0).count() == 0


def rotated(videos, keep, per):
    """Rotation of queues."""
    out, queues = list(range(min(keep, len(videos)))), OrderedDict()
    for i in range(keep, len(videos)):
        queues.setdefault(videos[i], deque()).append(i)
    while queues:
        for v in list(queues):
            for _ in range(min(per, len(queues[v]))):
                out.append(queues[v].popleft())
            if not queues[v]:
                del queues[v]
    return out


def test_spread(spark):
    rng = random.Random(7)
    lists = [list("AAAAAB")] + [[rng.choice("ABCD") for _ in range(rng.randint(1, 14))] for _ in range(60)]
    df = ranked(spark, [[(v, i) for i, v in enumerate(found)] for found in lists])
    for keep, per in ((0, 2), (0, 1), (3, 2)):
        got = {}
        for r in hits.video_spread(df, ["q"], keep, per).orderBy("place").collect():
            got.setdefault(r.q, []).append(r.shot_id)
        assert all(got[q] == rotated(found, keep, per) for q, found in enumerate(lists))
    with pytest.raises(ValueError):
        hits.video_spread(df, ["q"], 0, 0)


def test_shape_puts_spares_last_and_cuts(spark):
    shots = hits.group_by_shot(ranked(spark, [[("A", 1), ("A", 1), ("B", 2), ("A", 1), ("B", 2)]]), ["q"])
    rows = hits.shape(shots, ["q"], 4).orderBy("row").collect()
    assert [r.frame_index for r in rows] == [1, 3, 2, 4]
    with pytest.raises(ValueError):
        hits.shape(shots, ["q"], 0)


def lane(spark, shots):
    return hits.group_by_shot(ranked(spark, [[("V", s) for s in shots]]), ["q"]).drop("q")


def test_fusion(spark):
    agree = fusion.fuse([lane(spark, [1, 2, 3]), lane(spark, [4, 2])], [], 60, 100).orderBy("rank").collect()
    assert [r.shot_id for r in agree][0] == 2
    # Equal ranks in swapped lanes tie exactly; then the better rank, then the shot.
    tie = fusion.fuse([lane(spark, [7, 5, 9]), lane(spark, [5, 7, 8])], [], 60, 100).orderBy("rank").collect()
    assert [r.shot_id for r in tie] == [5, 7, 8, 9] and tie[0].score == tie[1].score
    assert tie[0].frame_index == 1
    with pytest.raises(ValueError):
        fusion.fuse([lane(spark, [1])], [], None)
    with pytest.raises(ValueError, match="limit"):
        fusion.fuse([lane(spark, [1])], [], 60)


def test_recall(spark):
    rows = spark.createDataFrame([(1, 1, 0.0), (1, 3, 1.0), (2, 60, 0.5)], "q int, row int, row_score double")
    got = {r.q: r for r in evaluate.recall_at(rows, ["q"]).collect()}
    assert (got[1].r1, got[1].r5, got[1].mean) == (0.0, 1.0, 0.8)
    assert (got[2].r50, got[2].r100, got[2].mean) == (0.0, 0.5, 0.1)
    df = spark.sql("select array(1L, 50L) as p, array(struct(0L as low, 5L as high), struct(0L as low, 5L as high)) as t")
    assert df.select(evaluate.chain_score("p", "t")).first()[0] == 0.5

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinequery.llm import edges, nearest, runs, topn, vectors
from cinequery.llm.graph import Graph, unit

# -- problem 2


def brute_nearest(left, right, tolerance):
    out = set()
    for e, key, at in left:
        if e is None or at is None:
            continue
        found = [(abs(t - at), t, i) for v, t, i in right if v == e and t is not None and i is not None and abs(t - at) <= tolerance]
        if found:
            out.add((key, min(found)[2]))
    return out


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_nearest_equals_brute_force(spark, partitions):
    rng = random.Random(partitions)
    video = lambda: rng.choice(["hot"] * 4 + ["a", "b", "c", None])
    left = [(video(), i, rng.choice([None] + [rng.randint(0, 3000) for _ in range(9)])) for i in range(400)]
    right = [(video(), rng.choice([None] + [rng.randint(0, 3000)] * 9), f"k{i:04d}") for i in range(120)]
    left += left[:30]
    right += right[:20]
    a = spark.createDataFrame(left, "v string, n long, t long")
    b = spark.createDataFrame([(*r, 1) for r in right], "v string, m long, k string, t int")
    for tolerance in (0, 20, 400):
        got = [(int(r.key.strip('["]')), r.right_id) for r in nearest.nearest_in_time(a, b, "v", ["n"], "t", "m", "k", tolerance, partitions).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_nearest([(v, n, t) for v, n, t in left], right, tolerance)


def test_nearest_edges_of_tasks_without_right_records(spark):
    left = spark.createDataFrame([("v", i, i * 10) for i in range(200)], "v string, n long, t long")
    right = spark.createDataFrame([("v", 0, "first"), ("v", 1990, "last")], "v string, m long, k string")
    got = {int(r.key.strip('["]')): (r.right_id, r.gap) for r in nearest.nearest_in_time(left, right, "v", ["n"], "t", "m", "k", 10_000, 12).collect()}
    assert got == {i: ("first", i * 10) if i * 10 <= 995 else ("last", 1990 - i * 10) for i in range(200)}
    assert nearest.nearest_in_time(left.limit(0), right, "v", ["n"], "t", "m", "k", 5).count() == 0
    assert nearest.nearest_in_time(left, right.limit(0), "v", ["n"], "t", "m", "k", 5).count() == 0


def test_prefix_scan_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(edges, "BLOCK", 3)
    rng = random.Random(1)
    values = [rng.choice([None, i]) for i in range(40)]
    df = spark.createDataFrame(list(enumerate(values)), "task int, value int")
    for down in (False, True):
        got = {r.task: r.carried for r in edges.last_before(df, "task", "value", down).collect()}
        for i in range(40):
            others = [v for v in (values[i + 1 :] if down else values[:i][::-1]) if v is not None]
            assert got[i] == (others[0] if others else None)


# -- problem 3


def test_graph_finds_the_nearest():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 24))
    x = unit(np.concatenate([c + 0.6 * rng.normal(size=(60, 24)) for c in centres]))
    graph = Graph(x, 12, 12)
    node, near = graph.search(x, 6, 24, np.arange(len(x)))
    s = x @ x.T
    truth = np.argsort(-s, axis=1)[:, :6]
    assert np.mean([len(set(a) & set(b)) / 6 for a, b in zip(node, truth)]) > 0.9
    assert (near[:, 0] > 0.999).all()
    for n in (0, 1, 2, 5):
        found, _ = Graph(x[:n], 12, 12).search(x[:3], 4, 8)
        assert all(set(range(n)) == set(r[r >= 0]) for r in found) if 0 < n <= 4 else found.shape == (3, 4)


def brute_similar(rows, k, least):
    seen = {}
    for key, v in rows:
        if key is not None and v is not None and len(v) == 8 and np.isfinite(v).all() and np.linalg.norm(v) > 0:
            seen.setdefault(key, np.asarray(v) / np.linalg.norm(v))
    keys = sorted(seen)
    x = np.stack([seen[i] for i in keys])
    out = {}
    for i, key in enumerate(keys):
        s = np.round(x @ x[i], 5)
        order = [j for j in sorted(range(len(keys)), key=lambda j: (-s[j], keys[j])) if j != i and s[j] >= least][:k]
        out[key] = [keys[j] for j in order]
    return out


def test_similar_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 8))
    rows = [(f"k{i:04d}", (base[i % 60] + 0.15 * rng.normal(size=8)).tolist()) for i in range(600)]
    rows += [(f"same{i}", [float(x) for x in range(1, 9)]) for i in range(9)] + [("scaled", [2.0 * x for x in range(1, 9)])]
    rows += rows[:40] + [("null", None), ("zero", [0.0] * 8), ("short", [1.0]), ("nan", [float("nan")] * 8), ("inf", [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame([(k, v, 1) for k, v in rows], "k string, v array<double>, key int").repartition(5)
    for shard in (5000, 120):
        got = defaultdict(list)
        for r in vectors.similar_vectors(df, "k", "v", 4, least=0.8, shard_rows=shard, probes=6, margin=1.0, beam=32).orderBy(F.desc("similarity"), "key_b").collect():
            got[r.key_a].append(r.key_b)
        want = brute_similar(rows, 4, 0.8)
        pairs = {(a, b) for a, found in want.items() for b in found}
        hits = {(a, b) for a, found in got.items() for b in found}
        assert len(pairs & hits) / len(pairs) > 0.97 and not set(got) & {"null", "zero", "short", "nan", "inf", None}
        assert sorted(got["same0"])[:2] == ["same1", "same2"] and len(got["same0"]) == 4
    few = vectors.similar_vectors(df, "k", "v", 3, asks=F.col("k") == "k0000", probes=6, margin=1.0, beam=64).collect()
    assert len(few) == 3 and {r.key_a for r in few} == {"k0000"}


def test_similar_vectors_of_a_crowded_cell_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LEAST_SHARD", 20)
    rng = np.random.default_rng(5)
    rows = [(i, (np.array([1.0, 0, 0, 0]) + 0.05 * rng.normal(size=4)).tolist()) for i in range(300)] + [(1000 + i, rng.normal(size=4).tolist()) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = vectors.similar_vectors(df, "id", "v", 3, shard_rows=30, probes=50, margin=2.0, beam=24).collect()
    x = unit(np.array([v for _, v in rows]))
    s = x @ x.T
    np.fill_diagonal(s, -2)
    best = {(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in np.argsort(-s[i])[:3]}
    assert len({(r.key_a, r.key_b) for r in got} & best) / len(best) > 0.9
    for empty in (df.limit(0), df.where("id < 0"), spark.createDataFrame([(1, None)], "id long, v array<float>")):
        assert vectors.similar_vectors(empty, "id", "v", 3).count() == 0
    assert vectors.similar_vectors(df.limit(1), "id", "v", 3).count() == 0


def test_very_many_copies_of_a_vector(spark):
    rng = np.random.default_rng(9)
    rows = [(f"c{i:04d}", [0.5, 1.0, -1.0, 2.0]) for i in range(400)] + [(f"d{i:04d}", [0.5, 1.0, -1.0, 2.0 + 0.01 * i]) for i in range(5)]
    rows += [(f"x{i:04d}", rng.normal(size=4).tolist()) for i in range(800)]
    df = spark.createDataFrame(rows, "id string, v array<float>")
    got = defaultdict(set)
    for r in vectors.similar_vectors(df, "id", "v", 3, least=0.99, shard_rows=60, probes=8, margin=1.0, beam=24).collect():
        got[r.key_a].add(r.key_b)
    assert all(got[f"c{i:04d}"] == {"c0000", "c0001", "c0002"} for i in range(3, 400)) and got["c0001"] == {"c0000", "c0002", "c0003"}
    assert len(got["d0004"]) == 3 and all(b[0] in "cd" for b in got["d0004"])


def test_a_key_that_comes_very_often_has_neighbours(spark):
    rng = np.random.default_rng(13)
    rows = [(f"x{i:04d}", rng.normal(size=4).tolist()) for i in range(300)] + [("hot", [0.5, 1.0, -1.0, 2.0])] * 200
    rows += [(f"n{i}", [0.5, 1.0, -1.0, 2.0 + 0.001 * (i + 1)]) for i in range(4)]
    # As many keys with one vector as neighbours are asked for: too few to stand for each other.
    rows += [(f"t{i}", [-2.0, 1.0, 0.3, 0.1]) for i in range(3)] * 70 + [("u", [-2.0, 1.0, 0.3, 0.1001])]
    df = spark.createDataFrame(rows, "id string, v array<float>")
    got = defaultdict(set)
    for r in vectors.similar_vectors(df, "id", "v", 3, least=0.99, shard_rows=60, probes=8, margin=1.0, beam=24).collect():
        got[r.key_a].add(r.key_b)
    assert got["hot"] == {"n0", "n1", "n2"}
    assert all(got[f"t{i}"] == {"t0", "t1", "t2", "u"} - {f"t{i}"} for i in range(3))


def test_a_key_with_different_vectors_is_one_item(spark):
    rng = np.random.default_rng(17)
    rows = [(f"x{i:04d}", rng.normal(size=4).tolist()) for i in range(300)]
    rows += [("two", [1.0, 0.0, 0.0, 0.0]), ("two", [0.0, 1.0, 0.0, 0.0]), ("a", [1.0, 0.01, 0.0, 0.0]), ("b", [0.01, 1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id string, v array<float>")
    found = vectors.similar_vectors(df, "id", "v", 300, shard_rows=60, probes=50, margin=2.0, beam=64).where("key_a = 'two' and key_b in ('a', 'b')")
    assert sum(r.similarity > 0.99 for r in found.collect()) == 1


def test_a_key_asks_if_any_of_its_rows_does(spark):
    rng = np.random.default_rng(19)
    vector = [rng.normal(size=4).tolist() for _ in range(200)]
    rows = [(i + 1000 * (i % 100 == 0), f"k{i:04d}", v) for i, v in enumerate(vector)]
    for order in ([(7, "k0005", vector[5]), (900, "k0005", vector[5])], [(900, "k0005", vector[5]), (7, "k0005", vector[5])]):
        df = spark.createDataFrame([r for r in rows if r[1] != "k0005"] + order, "n long, id string, v array<float>").coalesce(1)
        for shard in (5000, 40):
            found = vectors.similar_vectors(df, "id", "v", 3, asks=F.col("n") % 100 == 0, shard_rows=shard, probes=8, margin=2.0, beam=64).collect()
            got = {r.key_b for r in found if r.key_a == "k0005"}
            s = unit(np.array(vector)) @ unit(np.array(vector))[5]
            assert got == {f"k{i:04d}" for i in np.argsort(-s)[1:4]}


# -- problem 4


def brute_runs(rows, least):
    kept = sorted({(v, s, f, k, t, int(h, 16)) for v, s, f, k, t, h in rows if None not in (v, s, f, k) and h and h != "zz"}, key=lambda r: r[:4])
    out, run = [], []
    for r in kept:
        if run and run[-1][:2] == r[:2] and bin(run[-1][5] ^ r[5]).count("1") <= 6:
            run.append(r)
        else:
            out.append(run)
            run = [r]
    out.append(run)
    return sorted((x[0][0], x[0][1], x[0][3], x[-1][3], len(x), x[-1][4] - x[0][4]) for x in out if len(x) >= least)


@pytest.mark.parametrize("partitions", [1, 4, 24])
def test_runs_equal_brute_force(spark, partitions):
    rng = random.Random(partitions)
    rows = []
    for v, s, n in [("hot", 0, 300), ("hot", 1, 3), ("a", 0, 40), ("b", 7, 1), ("c", 0, 12)]:
        h = rng.getrandbits(64)
        for i in range(n):
            if rng.random() < 0.12:
                h = rng.getrandbits(64)
            elif rng.random() < 0.5:
                h ^= 1 << rng.randrange(64)
            text = rng.choice([f"{h:016x}", f"{h:X}"]) if rng.random() < 0.95 else rng.choice([None, "", "zz"])
            rows.append((v, s, i * 5, f"{v}_{i:05d}", i * 200, text))
    rows += rows[::9] + [(None, 0, 1, "x", 1, "0"), ("a", None, 1, "x", 1, "0"), ("a", 0, None, "x", 1, "0")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1) for r in rows], "video_id string, shot_id long, f long, k string, t long, d string, n int")
    for least in (1, 2, 3):
        got = runs.collapse_runs(df, ["video_id", "shot_id"], "f", "k", "t", "d", 6, least, partitions).collect()
        assert sorted((r.video_id, r.shot_id, r.first_key, r.last_key, r.events, r.duration) for r in got) == brute_runs(rows, least)


def test_a_run_longer_than_any_task(spark):
    df = spark.range(500).select(F.lit("v").alias("v"), F.lit(0).alias("s"), F.col("id").alias("f"), F.format_string("%05d", "id").alias("k"), (F.col("id") * 40).alias("t"), F.lit("00ff").alias("d"))
    got = runs.collapse_runs(df, ["v", "s"], "f", "k", "t", "d", 0, 2, 8).collect()
    assert [(r.first_key, r.last_key, r.events, r.duration) for r in got] == [("00000", "00499", 500, 499 * 40)]
    assert runs.collapse_runs(df.limit(0), ["v", "s"], "f", "k", "t", "d").count() == 0


def test_a_run_that_returns_to_an_earlier_picture_is_a_new_one(spark):
    rows = [("v", 0, i, f"{i}", i, h) for i, h in enumerate(["0", "0", "ff", "ff", "0", "0"])]
    df = spark.createDataFrame(rows, "v string, s int, f long, k string, t long, d string")
    got = runs.collapse_runs(df, ["v", "s"], "f", "k", "t", "d", 6, 2).collect()
    assert sorted((r.first_key, r.last_key) for r in got) == [("0", "1"), ("2", "3"), ("4", "5")]


# -- problem 5


@pytest.mark.parametrize("share", [1, 8, 1024])
def test_top_n_equals_brute_force(spark, share):
    rng = random.Random(8)
    rows = []
    for i in range(3000):
        q = rng.choice([0] * 6 + list(range(1, 60)))
        rows.append((q, rng.choice(["a", "b", None]), rng.choice([None, float("nan"), 0.5, 0.5, 1.0, rng.random()]), rng.randint(0, 9), i, "x"))
    rows += rows[::7]
    df = spark.createDataFrame(rows, "q int, v string, score double, f int, id int, salt string")
    groups = defaultdict(set)
    for q, v, s, f, i, _ in rows:
        if v is not None and s is not None and s == s:
            groups[(q, v)].add((-s, f, i))
    want = sorted((*g, i) for g, found in groups.items() for _, _, i in sorted(found)[:5])
    got = topn.top_n(df, ["q", "v"], "score", ["f", "id"], 5, ["salt"], share)
    heavy = topn.heavy_ranges(df.where("v is not null and not isnan(score)"), ["q", "v"], share).orderBy("__first").collect()
    assert len(heavy) < max(share, 2)
    assert all(b["__first"] == a["__first"] + a["__salts"] for a, b in zip(heavy, heavy[1:])) and (share < 1024 or heavy)
    assert got.columns == ["q", "v", "f", "id", "score", "salt"]
    assert sorted((r.q, r.v, r.id) for r in got.collect()) == want


def test_top_n_of_nothing(spark):
    df = spark.createDataFrame([], "q int, score double, id int")
    assert topn.top_n(df, ["q"], "score", ["id"], 3).count() == 0
    with pytest.raises(ValueError):
        topn.top_n(df, ["q"], "score", ["id"], 0)

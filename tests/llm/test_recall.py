"""What the vector queries find, against brute force over whole tables."""

import os

import numpy as np
import pyarrow.parquet as pq
import pytest

from cinequery.llm import queries

ROOT = os.environ.get("TEST_DATA_ROOT", "/root/testdata")


def table(folder):
    """Keys, their vectors at unit length, and whether they ask."""
    rows = pq.read_table(f"{folder}/milvus_index.parquet", columns=["id", "keyframe_id", "vector"]).to_pydict()
    held, asks = {}, {}
    for i, key, vector in zip(rows["id"], rows["keyframe_id"], rows["vector"]):
        if key is not None and vector is not None and any(vector):
            held.setdefault(key, vector)
            asks[key] = asks.get(key, False) or i % 100 == 0
    points = np.array(list(held.values()), np.float64)
    return np.array(list(held)), points / np.linalg.norm(points, axis=1, keepdims=True), np.array([asks[k] for k in held])


def nearest(keys, points, which, k, least):
    """(key, its k most similar others with at least ``least``) by brute force."""
    small = points.astype(np.float32)
    for a in range(0, len(which), 512):
        rows = which[a : a + 512]
        close = small[rows] @ small.T
        close[np.arange(len(rows)), rows] = -9
        top = np.argpartition(-close, k + 5, axis=1)[:, : k + 5]
        for row, near in zip(rows, top):
            exact = points[near] @ points[row]
            order = np.lexsort((keys[near], -exact))[:k]
            yield keys[row], [keys[near[j]] for j in order if exact[j] >= least]


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_pairs(spark, size):
    folder = f"{ROOT}/{size}"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    keys, points, _ = table(folder)
    want = {(min(a, b), max(a, b)) for a, near in nearest(keys, points, np.arange(len(keys)), 5, 0.9) for b in near}
    got = {tuple(r) for r in queries.p3_found(spark, folder).select("keyframe_id_a", "keyframe_id_b").collect()}
    recall, precision = len(want & got) / len(want), len(want & got) / len(got)
    print(f"{size}: {len(want)} pairs, recall {recall:.4f}, precision {precision:.4f}")
    assert recall >= 0.98 and precision >= 0.995


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_search(spark, size):
    folder = f"{ROOT}/{size}"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    keys, points, asks = table(folder)
    want = {(a, b) for a, near in nearest(keys, points, np.flatnonzero(asks), 10, -1.0) for b in near}
    rows = queries.p3_search(spark, folder).collect()
    got = {(r.keyframe_id, r.neighbour_id) for r in rows}
    print(f"{size}: {len(want)} neighbours, recall {len(want & got) / len(want):.4f}")
    assert len({r.keyframe_id for r in rows}) == asks.sum() and len(want & got) / len(want) >= 0.95
    at = {k: i for i, k in enumerate(keys)}
    assert all(abs(points[at[r.keyframe_id]] @ points[at[r.neighbour_id]] - r.similarity) < 1e-6 for r in rows)

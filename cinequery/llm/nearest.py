"""Nearest record in time of the same entity (problem 2).

Left and right records are united, range-partitioned globally by (entity, time) and scanned in
place: forward for the last right record, backward for the next. What a task cannot know, the right
records just beyond its edges, comes from a parallel prefix scan over the tasks' edge records. An
entity, and even one of its moments, may span any number of tasks; no task holds more than its range.

Defined results: a left record with a null entity or time has no match; right records with a null
entity, time or id are left out. Of two equally near, the earlier; of several at one time, the
smallest id by code point. A distance equal to the tolerance counts. Copies of a left record (same
entity, time and key) give one row. Empty tables: no rows. Other columns of the inputs are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinequery.llm.edges import last_before, ordered_scan
from cinequery.sources.tables import materialize

_SCANNED = "role string, task int, entity string, at long, key string, right_id string, gap long, open_before boolean, open_after boolean"


def _same(entity: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Number of each row's entity, in order of appearance (rows are sorted)."""
    codes = pc.dictionary_encode(entity.combine_chunks() if isinstance(entity, pa.ChunkedArray) else entity)
    return codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _scanner(tolerance: int):
    def scan(task: int, t: pa.Table) -> Iterator[pa.RecordBatch]:
        entity, at = _same(t["entity"]), t["at"].to_numpy()
        left = t["is_left"].to_numpy(zero_copy_only=False).astype(bool)
        names, ids = t["entity"].combine_chunks(), t["id"].combine_chunks()
        n, place = len(at), np.arange(len(at))
        # Copies are neighbours: same entity, time, side and id.
        if n > 1:
            same_id = np.r_[False, pc.equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False).astype(bool)]
            here = np.r_[False, (entity[1:] == entity[:-1]) & (at[1:] == at[:-1]) & (left[1:] == left[:-1])]
        else:
            same_id = here = np.zeros(n, bool)
        copy = same_id & here
        right = ~left & ~here  # the first right record of a time has the smallest id
        before = np.maximum.accumulate(np.where(right, place, -1))
        after = np.minimum.accumulate(np.where(right, place, n)[::-1])[::-1]
        asks = np.flatnonzero(left & ~copy)
        b, a = before[asks], after[asks]
        has_b = (b >= 0) & (entity[np.maximum(b, 0)] == entity[asks])
        has_a = (a < n) & (entity[np.minimum(a, n - 1)] == entity[asks])
        far = np.iinfo(np.int64).max
        gap_b = np.where(has_b, at[asks] - at[np.maximum(b, 0)], far)
        gap_a = np.where(has_a, at[np.minimum(a, n - 1)] - at[asks], far)
        pick, gap = np.where(gap_b <= gap_a, b, a), np.minimum(gap_b, gap_a)
        # Open: beyond the task's edge there may be a nearer one of the same entity, within the tolerance.
        reach = np.minimum(gap, tolerance)
        open_b = ~has_b & (entity[asks] == entity[0]) & (at[asks] - at[0] <= reach)
        open_a = ~has_a & (entity[asks] == entity[-1]) & (at[-1] - at[asks] <= reach)
        matched = gap <= tolerance
        show = matched | open_b | open_a
        rows, chosen = asks[show], np.where(matched, pick, 0)[show]
        open_b, open_a, matched, gap = open_b[show], open_a[show], matched[show], gap[show]
        mask = lambda x: pa.array(~x)
        right_id = pc.if_else(pa.array(matched), ids.take(pa.array(chosen)), pa.scalar(None, ids.type))
        k = len(rows)
        if k:
            yield pa.record_batch(
                {
                    "role": pc.if_else(pa.array(open_b | open_a), "open", "done").cast(pa.string()),
                    "task": pa.array(np.full(k, task, np.int32)),
                    "entity": names.take(pa.array(rows)),
                    "at": pa.array(at[rows]),
                    "key": ids.take(pa.array(rows)),
                    "right_id": right_id,
                    "gap": pa.array(gap, mask=~matched),
                    "open_before": pa.array(open_b),
                    "open_after": pa.array(open_a),
                }
            )
        edge = np.flatnonzero(right)
        ends = [("first", edge[0]), ("last", edge[-1])] if len(edge) else [("none", 0)]
        yield pa.record_batch(
            {
                "role": pa.array([r for r, _ in ends]),
                "task": pa.array([task] * len(ends), pa.int32()),
                "entity": pa.array([names[int(i)].as_py() for _, i in ends]),
                "at": pa.array([int(at[i]) for _, i in ends], pa.int64()),
                "key": pa.array([None] * len(ends), pa.string()),
                "right_id": pa.array([ids[int(i)].as_py() for _, i in ends], pa.string()),
                "gap": pa.array([None] * len(ends), pa.int64()),
                "open_before": pa.array([False] * len(ends)),
                "open_after": pa.array([False] * len(ends)),
            }
        )

    return scan


def nearest_in_time(
    left: DataFrame, right: DataFrame, entity: str, left_key: Sequence[str], left_at: str, right_at: str, right_id: str, tolerance: int, partitions: int | None = None
) -> DataFrame:
    """(key, entity, at, right_id, gap): each left record with its nearest right record, if one is within ``tolerance``.

    ``key`` is the JSON array text of ``left_key``. Only those columns are read and shuffled.
    """
    if tolerance < 0:
        raise ValueError("tolerance must not be negative")
    key = F.to_json(F.array(*(F.col(c).cast("string") for c in left_key)))
    sides = [
        left.select(F.col(entity).cast("string").alias("entity"), F.col(left_at).cast("long").alias("at"), F.lit(True).alias("is_left"), key.alias("id")),
        right.select(F.col(entity).cast("string").alias("entity"), F.col(right_at).cast("long").alias("at"), F.lit(False).alias("is_left"), F.col(right_id).cast("string").alias("id")),
    ]
    known = "entity is not null and at is not null and id is not null"
    # Of the right records of one moment only the smallest id can be a match, so a moment is one row, however many it had.
    moments = sides[1].where(known).groupBy("entity", "at", "is_left").agg(F.min("id").alias("id"))
    both = sides[0].where(known).unionByName(moments)
    # By all columns: the left records of one moment may lie in several tasks, and only copies must meet.
    scanned = materialize(ordered_scan(both, ["entity", "at", "is_left", "id"], _scanner(tolerance), _SCANNED, partitions), "nearest")

    done = scanned.where("role = 'done'").select("key", "entity", "at", "right_id", "gap")
    # One or two edge rows a task: small by construction, whatever the data.
    edges = scanned.where("role in ('first', 'last', 'none')").groupBy("task").agg(
        *(F.max(F.when(F.col("role") == r, F.struct("entity", "at", "right_id"))).alias(r) for r in ("first", "last"))
    )
    before = last_before(edges, "task", "last").withColumnRenamed("carried", "b")
    after = last_before(edges, "task", "first", descending=True).withColumnRenamed("carried", "a")
    carried = before.join(after, "task")  # a row a task; Spark picks the join by its size
    asked = scanned.where("role = 'open'").join(carried, "task")
    gap_b = F.when(F.col("open_before") & (F.col("b.entity") == F.col("entity")), F.col("at") - F.col("b.at"))
    gap_a = F.when(F.col("open_after") & (F.col("a.entity") == F.col("entity")), F.col("a.at") - F.col("at"))
    # side: 0 before, 1 found in the task, 2 after. Where both of the task's sides are open nothing was found in it;
    # where one is, the found one lies on the other side, so 'earlier' follows from the open side.
    inner = F.when(F.col("gap").isNotNull(), F.struct(F.col("gap").alias("gap"), F.when(F.col("open_before"), 1).otherwise(0).alias("side"), F.col("right_id").alias("right_id")))
    outer_b = F.when(gap_b <= tolerance, F.struct(gap_b.alias("gap"), F.lit(0).alias("side"), F.col("b.right_id").alias("right_id")))
    outer_a = F.when(gap_a <= tolerance, F.struct(gap_a.alias("gap"), F.lit(2).alias("side"), F.col("a.right_id").alias("right_id")))
    best = F.array_min(F.array_compact(F.array(inner, outer_b, outer_a)))
    closed = asked.withColumn("_best", best).where("_best is not null").select("key", "entity", "at", F.col("_best.right_id").alias("right_id"), F.col("_best.gap").alias("gap"))
    return done.unionByName(closed)

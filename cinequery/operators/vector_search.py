"""Exact top-k over stored vectors, for many query vectors at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinequery.operators.hits import FRAME, MAX_LIMIT, rank_rows

#: Query vectors that go to the scan of the index at once; more go in several passes.
BROADCAST_VECTORS = 10_000
#: Rows after which a task hands on what it has scored.
OUTPUT_ROWS = 200_000


def usable_vectors(index: DataFrame) -> DataFrame:
    """Rows whose vector is neither null nor zero. A keyframe inserted again has the same vector; searches count it once."""
    return index.where(F.col("vector").isNotNull() & F.exists("vector", lambda x: x != 0))


def examples(index: DataFrame, count: int) -> DataFrame:
    """(query_id, query_vector): the first ``count`` usable vectors by id, to search by example. A local table."""
    first = usable_vectors(index).select("id", "vector").orderBy("id").limit(count).collect()
    kind = index.schema["vector"].dataType.simpleString()
    return index.sparkSession.createDataFrame([(i + 1, r.vector) for i, r in enumerate(first)], f"query_id int, query_vector {kind}")


def every_hundredth(index: DataFrame) -> DataFrame:
    """(query_id, query_vector): the usable vectors whose id is divisible by 100, as queries by their id."""
    return usable_vectors(index).where(F.col("id") % 100 == 0).dropDuplicates(["id"]).select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))


def _matrix(batch: pa.RecordBatch, width: int, unit: bool = False) -> tuple[pa.RecordBatch, np.ndarray]:
    """The rows whose vector has the wanted length, and their vectors; zero vectors are NaN. With ``unit``, at unit length."""
    column = batch.column("vector")
    fits = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), width), False).to_numpy(zero_copy_only=False))
    rows = batch.take(pa.array(fits))
    x = pc.list_flatten(rows.column("vector")).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return rows, np.divide(x, length if unit else 1.0, out=np.full_like(x, np.nan), where=length > 0)


def _scorer(vectors: np.ndarray, numbers: list, number_kind: pa.DataType, measure: str, keep: int | None):
    """Scores batches against all query vectors by one matrix product each.

    With ``keep``, a batch passes on only rows at or above its ``keep``-th best distinct score of a
    query, which the query's best ``keep`` frames always are, copies or not.
    """
    width = vectors.shape[1]
    if measure == "cosine":
        length = np.linalg.norm(vectors, axis=1, keepdims=True)
        vectors = np.divide(vectors, length, out=np.full_like(vectors, np.nan), where=length > 0)
    names, given = ["query_id", *FRAME, "score"], pa.array(numbers, number_kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = _matrix(batch, width, measure == "cosine")
            if not len(x):
                continue
            scores = x @ vectors.T
            asked: list[np.ndarray] = []
            chosen: list[np.ndarray] = []
            held = 0
            for q in range(len(numbers)):
                score = scores[:, q]
                good = np.isfinite(score)
                if keep is not None and good.sum() > keep:
                    rounded = np.round(np.where(good, score, -np.inf), 12)
                    distinct = np.unique(rounded[good])
                    good &= rounded >= distinct[max(0, len(distinct) - keep)]
                at = np.flatnonzero(good)
                asked.append(np.full(len(at), q)), chosen.append(at)
                held += len(at)
                if held > OUTPUT_ROWS or q == len(numbers) - 1:
                    of, at = np.concatenate(asked), np.concatenate(chosen)
                    yield pa.record_batch([given.take(pa.array(of)), *(rows.column(c).take(pa.array(at)) for c in FRAME), pa.array(scores[at, of])], names)
                    asked, chosen, held = [], [], 0

    return run


def _blocks(queries: DataFrame, most: int) -> Iterator[tuple[list, np.ndarray]]:
    """Numbers and vectors of the queries, ``most`` at a time."""
    numbers: list = []
    held: list = []
    for number, vector in queries.select("query_id", F.col("query_vector").cast("array<double>")).toLocalIterator():
        numbers.append(number), held.append(vector)
        if len(held) == most:
            yield numbers, np.array(held, np.float64)
            numbers, held = [], []
    if held:
        yield numbers, np.array(held, np.float64)


def scored_frames(index: DataFrame, queries: DataFrame, similarity: str = "cosine", keep: int | None = None, block: int = BROADCAST_VECTORS) -> DataFrame:
    """Every indexed frame scored against every row of ``queries(query_id, query_vector)``.

    The stated query set goes to the index, ``block`` vectors at a time; the index's rows stay where
    they are: one pass a block, a matrix product a batch, no shuffle. Rows whose vector is null, zero or of
    another length are left out. Queries have one length.
    """
    if similarity not in ("cosine", "dot"):
        raise ValueError("similarity is cosine or dot")
    kinds = {f.name: f.dataType.simpleString() for f in index.schema} | {"query_id": queries.schema["query_id"].dataType.simpleString()}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in ("query_id", *FRAME)), "score double"])
    rows, found = index.select(*FRAME, "vector"), None
    number_kind = pa.int64() if kinds["query_id"] == "bigint" else pa.int32()
    for numbers, vectors in _blocks(queries, block):
        one = rows.mapInArrow(_scorer(vectors, numbers, number_kind, similarity, keep), schema)
        found = one if found is None else found.unionAll(one)
    return index.sparkSession.createDataFrame([], schema) if found is None else found


def event_table(index: DataFrame, events: DataFrame, count: int) -> DataFrame:
    """Every frame with the dot products ``s1..sn`` of its vector and the events 1..n."""
    asked = {number: vector for number, vector in events.select("query_id", F.col("query_vector").cast("array<double>")).where(F.col("query_id").between(1, count)).collect()}
    kinds = {f.name: f.dataType.simpleString() for f in index.schema}
    names = [f"s{e}" for e in range(1, count + 1)]
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in FRAME), *(f"{c} double" for c in names)])
    if not asked:
        return index.sparkSession.createDataFrame([], schema)
    width = len(next(iter(asked.values())))
    vectors = np.array([asked.get(e, [np.nan] * width) for e in range(1, count + 1)], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = _matrix(batch, width)
            scores = x @ vectors.T
            good = np.isfinite(x).all(1)
            at = pa.array(np.flatnonzero(good))
            yield pa.record_batch([*(rows.column(c).take(at) for c in FRAME), *(pa.array(s, from_pandas=True) for s in scores[good].T)], [*FRAME, *names])

    return index.select(*FRAME, "vector").mapInArrow(run, schema)


def search(index: DataFrame, queries: DataFrame, limit: int, video_id: str | None = None) -> DataFrame:
    """Ranked frames by cosine, at most ``limit`` (and never over 16,384), ties by keyframe id."""
    if video_id is not None:
        index = index.where(F.col("video_id") == F.lit(video_id))
    limit = min(limit, MAX_LIMIT)
    return rank_rows(scored_frames(index, queries, keep=limit), ["query_id"], [F.round("score", 12).desc(), F.col("keyframe_id")], limit, copies=True)

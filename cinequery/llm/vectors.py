"""The k most similar vectors of each vector, by robust-pruned graphs over shards (problem 3).

A coarse quantiser (spherical k-means on a bounded sample, see ``SAMPLE``) gives cells of
neighbouring directions. Every vector is indexed in the shard of its nearest cell and asks that
shard and those of the next cells that lie close across the boundary. In each shard, one task builds
a robust-pruned directed graph over the shard's vectors and answers all queries sent to it by beam
search. A cell that the sample shows to be larger than ``2 * shard_rows`` is split into several shards by a hash,
and asked in all of them: that is the second level past ``MAX_CELLS`` cells, too. Finally the answers of a
vector's shards are merged. Vectors travel as 16-bit steps of their largest value; where that could decide
(a similarity within ``DOUBT`` of ``least``, or of the next one at the k-th place), all candidates of the vector are
scored again from the stored numbers, in double precision.

A task holds one shard: about ``shard_rows`` indexed vectors, which grow with the square root of the rows up to
``SHARD_BYTES``, and the queries that cells around send. There are as many tasks as shards, so no task grows
faster than that. Work grows as rows times log(shard), the quantiser as rows times cells, with cells and shard both
about the square root of the rows. More cells mean more boundaries, so the cells that a vector asks grow with the
logarithm of their number. What is broadcast is the table of cells: at most ``MAX_CELLS`` rows.

Defined results: similarity is the cosine. Rows with a null key, or a vector that is null, zero, not
finite or of another length than the first of the sample have no similarity and take no part. A key
that comes more than once is one item (with the vector first by its bytes, if they differ), and asks if any of its rows does.
Identical vectors are one node of the graph and come out as separate items; a vector with more
copies than a shard has rows is indexed by its first few copies, which are all that can matter. Equal similarities are
ordered by key. Fewer than k others: all that are found. Empty input: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cinequery.llm.graph import Graph, unit
from cinequery.sources.tables import materialize

#: Rows, at most, on which the quantiser is fitted. All rows are indexed.
SAMPLE = 20_000
MAX_CELLS = 8_192
LEAST_SHARD = 2_000
#: Bytes of the vectors that a shard indexes, at most, on average.
SHARD_BYTES = 128 << 20
#: Candidates beyond the k wanted (one of them may be the vector itself) that a shard looks at, and hands on.
SPARE, NEXT = 6, 2
#: Twice what the steps in which vectors travel can change a similarity by, and more.
DOUBT = 4e-5
#: Tasks that search shards; with more shards, tasks take several, one after the other.
MAX_TASKS = 20_000
#: Similarities to cells that a task works out at once.
CELL_BLOCK = 4_000_000


def _usable(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors of one length that have a direction, and these as they are stored."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    right = pc.fill_null(pc.equal(pc.list_value_length(column), width), False)
    places = np.flatnonzero(right.to_numpy(zero_copy_only=False))
    values = pc.list_flatten(column.take(pa.array(places))).to_numpy(zero_copy_only=False).reshape(-1, width)
    with np.errstate(invalid="ignore", over="ignore"):
        norm = np.einsum("ij,ij->i", values, values, dtype=np.float64)
    fine = np.isfinite(norm) & (norm > 0)
    return places[fine], values[fine]


def _pack(points: np.ndarray) -> pa.Array:
    """Vectors of one length as bytes."""
    rows = np.ascontiguousarray(points, np.float32)
    return pa.Array.from_buffers(pa.binary(rows.shape[1] * 4), len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())


def _bytes(column: pa.Array | pa.ChunkedArray, length: int) -> np.ndarray:
    """Binary values of one length as the rows of a matrix of bytes, without a copy of each."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.empty((0, length), np.uint8)
    _, offsets, data = column.buffers()
    first = int(np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset])
    return np.frombuffer(data, np.uint8)[first : first + len(column) * length].reshape(-1, length)


def _unpack(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """The stored numbers of packed vectors of one length."""
    return np.ascontiguousarray(_bytes(column, width * 4)).view(np.float32)


def _stepped(stored: np.ndarray) -> pa.Array:
    """Each vector as a scale and 16-bit integers: half the bytes to shuffle, and similarities right to about 0.00001."""
    points = unit(stored)
    scale = np.abs(points).max(1, keepdims=True).astype(np.float32)
    steps = np.rint(points / scale * 32767).astype(np.int16)
    rows = np.ascontiguousarray(np.concatenate([scale.view(np.uint8), np.ascontiguousarray(steps).view(np.uint8)], axis=1))
    return pa.Array.from_buffers(pa.binary(rows.shape[1]), len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())


def _unstepped(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Unit vectors out of their steps."""
    raw = _bytes(column, 4 + 2 * width)
    return unit(np.ascontiguousarray(raw[:, 4:]).view(np.int16)) if len(raw) else np.empty((0, width), np.float32)


def _packer(kind: str):
    """Usable vectors of any length, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for width in np.unique(lengths[lengths > 0]):
                places, points = _usable(batch.column(1), int(width))
                if len(places):
                    kept = batch.take(pa.array(places))
                    yield pa.record_batch({"key": kept.column(0), "vector": _pack(points), "asks": kept.column(2)})

    return run, f"key {kind}, vector binary, asks boolean"


def fit_cells(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centres of ``cells`` cells, at unit length, by spherical k-means."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), cells, replace=False)]
    for _ in range(rounds):
        own = (sample @ centres.T).argmax(1)
        sums = np.zeros(centres.shape, np.float64)
        np.add.at(sums, own, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centres).astype(np.float32)
    return centres


def _assigner(sent, width: int, probes: int, margin: float):
    def part(keys: pa.Array, raw: pa.Array, asks: np.ndarray, mix: np.ndarray) -> pa.RecordBatch:
        centres, first, salts, copied = sent.value
        stored = _unpack(raw, width)
        points, steps = unit(stored), _stepped(stored)
        depth = min(probes, len(centres))
        at = np.arange(len(points))
        close = points @ centres.T
        near = np.argpartition(-close, depth - 1, axis=1)[:, :depth] if depth < len(centres) else np.broadcast_to(np.arange(depth), (len(points), depth))
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(close, near, 1), axis=1), 1)
        home = near[:, 0]
        salt = mix % salts[home]
        shard = first[home] + salt
        alone = np.zeros(len(points), bool)
        if copied:  # a vector with very many copies has a negative shard and asks nowhere
            number = np.array([copied.get(x, -1) for x in raw.to_pylist()])
            alone = number >= 0
            shard = np.where(alone, -1 - number, shard)
        rows, shards, owns = [at], [shard], [np.ones(len(at), bool)]
        for d in range(depth):
            cell = near[:, d]
            gap = (close[at, home] - close[at, cell]) / np.maximum(np.linalg.norm(centres[home] - centres[cell], axis=1), 1e-9)
            sent_to = asks & ~alone & (gap <= margin)
            for s in range(int(salts[cell].max(initial=1))):
                use = np.flatnonzero(sent_to & (s < salts[cell]) & ((d > 0) | (s != salt)))
                if len(use):
                    rows.append(use), shards.append(first[cell[use]] + s), owns.append(np.zeros(len(use), bool))
        r, own = np.concatenate(rows), np.concatenate(owns)
        return pa.record_batch(
            {
                "shard": pa.array(np.concatenate(shards).astype(np.int32)),
                "own": pa.array(own),
                "asks": pa.array(asks[r] | ~own),
                "key": keys.take(pa.array(r)),
                "vector": steps.take(pa.array(r)),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(128, CELL_BLOCK // len(sent.value[0]))
        for batch in batches:
            asks = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            mix = batch.column(3).to_numpy()
            for i in range(0, batch.num_rows, step):
                yield part(batch.column(0).slice(i, step), batch.column(1).slice(i, step), asks[i : i + step], mix[i : i + step])

    return run


def _reindexer(sent, width: int):
    """Packed vectors to their home shards, as rows that ask nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, first, salts, _ = sent.value
        for batch in batches:
            home = (_unstepped(batch.column(1), width) @ centres.T).argmax(1) if batch.num_rows else np.array([], int)
            n = batch.num_rows
            yield pa.record_batch(
                {
                    "shard": pa.array((first[home] + np.arange(n) % salts[home]).astype(np.int32)),
                    "own": pa.array(np.ones(n, bool)),
                    "asks": pa.array(np.zeros(n, bool)),
                    "key": batch.column(0),
                    "vector": batch.column(1),
                }
            )

    return run


def _searcher(width: int, k: int, least: float, degree: int, build_beam: int, beam: int):
    def ragged(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and the positions first[i] .. first[i] + count[i] - 1 of each row."""
        row = np.repeat(np.arange(len(count)), count)
        return row, np.repeat(first, count) + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)

    def members(group: np.ndarray, rank: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((rank, group))
        count = np.bincount(group, minlength=groups)
        return order, np.cumsum(count) - count, count

    low = least - DOUBT

    def run(t: pa.Table) -> pa.Table:
        # A key is here once: at home, or sent to ask.
        t = t.sort_by("key")
        keys = t["key"].combine_chunks()
        points = _unstepped(t["vector"], width)
        own, asks = (t[c].to_numpy().astype(bool) for c in ("own", "asks"))
        rank = np.arange(len(keys))  # rows are sorted by key
        # Identical vectors are one node. Of its members, only the first k + 1 and a few in reserve can be among anyone's k best.
        mine = np.flatnonzero(own)
        raw = np.ascontiguousarray(points).view(f"V{width * 4}").ravel()
        _, first_of, group = np.unique(raw, return_index=True, return_inverse=True)
        indexed = np.unique(group[mine])
        node_of = np.full(len(first_of), -1)
        node_of[indexed] = np.arange(len(indexed))
        nodes = points[first_of[indexed]]
        order_n, start_n, count_n = members(node_of[group[mine]], rank[mine], len(indexed))
        count_n = np.minimum(count_n, k + 1 + NEXT)
        who = np.unique(group[asks])
        empty = pa.table({"a": pa.array([], keys.type), "b": pa.array([], keys.type), "similarity": pa.array([], pa.float64())})
        if not len(indexed) or not len(who):
            return empty
        graph = Graph(nodes, degree, build_beam)
        at_home = node_of[who] >= 0
        hits = []
        for where, starts in ((at_home, node_of[who]), (~at_home, None)):
            q = np.flatnonzero(where)
            if len(q):
                node, near = graph.search(points[first_of[who[q]]], k + SPARE, beam, None if starts is None else starts[q])
                i, j = np.nonzero((node >= 0) & (near >= low - 1e-4))
                hits.append((q[i], node[i, j]))
        q, n = (np.concatenate(x) for x in zip(*hits))
        # Row by row, so that a pair has the same similarity to the last bit in every shard.
        exact = (points[first_of[who[q]]].astype(np.float64) * nodes[n].astype(np.float64)).sum(1)
        q, n, exact = q[exact >= low], n[exact >= low], exact[exact >= low]
        # Queries' members times the nodes' first members.
        asking = np.flatnonzero(asks)
        slot = np.full(len(first_of), -1)
        slot[who] = np.arange(len(who))
        order_q, start_q, count_q = members(slot[group[asking]], rank[asking], len(who))
        hit, a = ragged(start_q[q], count_q[q])
        a = asking[order_q[a]]
        row, b = ragged(start_n[n[hit]], count_n[n[hit]])
        a, b, near = a[row], mine[order_n[b]], exact[hit][row]
        keep = a != b
        a, b, near = a[keep], b[keep], near[keep]
        order = np.lexsort((b, -near, a))
        a, b, near = a[order], b[order], near[order]
        begin = np.r_[0, np.flatnonzero(a[1:] != a[:-1]) + 1] if len(a) else np.array([], int)
        place = np.arange(len(a)) - np.repeat(begin, np.diff(np.r_[begin, len(a)]))
        a, b, near = a[place < k + NEXT], b[place < k + NEXT], near[place < k + NEXT]
        return pa.table({"a": keys.take(pa.array(a)), "b": keys.take(pa.array(b)), "similarity": pa.array(near)})

    return run


def _by_shard(search):
    """One shard after the other: its rows follow one another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            number = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(number)]
            for a, b in zip(cuts, cuts[1:]):
                if held and held[0].column(0)[0].as_py() != int(number[a]):
                    yield from search(pa.Table.from_batches(held)).to_batches()
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from search(pa.Table.from_batches(held)).to_batches()

    return run


def similar_vectors(
    rows: DataFrame,
    key: str,
    vector: str,
    k: int,
    least: float = -1.0,
    asks: Column | None = None,
    probes: int | None = None,
    margin: float = 0.08,
    degree: int = 14,
    build_beam: int = 14,
    beam: int = 16,
    shard_rows: int | None = None,
    exact: bool = False,
) -> DataFrame:
    """(key_a, key_b, similarity): for each ``key_a`` that ``asks``, its ``k`` most similar others with at least ``least``.

    ``probes`` cells are asked at most, as far as the boundary to the vector's own cell lies within
    ``margin``; without a number, 3 and a third of the binary logarithm of the cells. ``degree``, ``build_beam`` and ``beam`` trade time for recall.
    With ``exact``, every similarity is worked out from the stored numbers, else those are that are in doubt.
    """
    if k < 1 or probes is not None and probes < 1 or degree < 1 or beam < 1:
        raise ValueError("k, probes, degree and beam must be at least 1")
    spark = rows.sparkSession
    kind = rows.schema[key].dataType.simpleString()
    usable = rows.select(F.col(key).alias("key"), F.col(vector).cast("array<float>").alias("vector"), (F.lit(True) if asks is None else F.coalesce(asks, F.lit(False))).alias("asks")).where(
        "key is not null and vector is not null"
    )
    mix = F.pmod(F.xxhash64("key"), F.lit(1_000_000)).cast("int")
    total = usable.select("key").distinct().count()
    output = f"key_a {kind}, key_b {kind}, similarity double"
    share = min(1_000_000, math.ceil(1_000_000 * SAMPLE / max(total, 1)))
    # A key that comes again and again is one row before anything is sampled, counted or sent to a shard.
    pack, packed_kind = _packer(kind)
    merged = [F.min("vector").alias("vector"), F.max("asks").alias("asks")]
    drawn = usable.where(mix < share).mapInArrow(pack, packed_kind).groupBy("key", F.length("vector").alias("n")).agg(*merged)
    taken = drawn.select("n", "vector").limit(SAMPLE).toArrow() if total else None
    if taken is None or not taken.num_rows:
        return spark.createDataFrame([], output)
    lengths = taken["n"].to_numpy()
    length = int(np.bincount(lengths).argmax())
    width = length // 4
    drawn_packed = taken["vector"].filter(pa.array(lengths == length))
    sample = unit(_unpack(drawn_packed, width))
    items = usable.mapInArrow(pack, packed_kind).where(F.length("vector") == length).groupBy("key").agg(*merged)
    shard = shard_rows or min(max(LEAST_SHARD, int(4 * math.sqrt(total))), max(1, SHARD_BYTES // length))
    cells = max(1, min(MAX_CELLS, total // shard, len(sample)))
    centres = fit_cells(sample, cells)
    probes = probes or 3 + math.ceil(math.log2(cells) / 3)
    held = np.bincount((sample @ centres.T).argmax(1), minlength=cells) * (total / len(sample))
    salts = np.maximum(1, np.ceil(held / (2 * shard))).astype(np.int64)
    first = np.cumsum(salts) - salts
    # Vectors of which there must be more copies than a shard has rows, by the sample. Each of its copies has a key
    # of its own, so with more than k of them there are k others for all.
    packed, times = np.unique(np.array(drawn_packed.to_pylist(), object), return_counts=True)
    copied = {v: i for i, v in enumerate(packed[(times >= max(3, k + 1)) & (times * (total / len(sample)) > shard)])}
    sent = spark.sparkContext.broadcast((centres, first, salts, copied))

    kinds = f"shard int, own boolean, asks boolean, key {kind}, vector binary"
    spread = items.select("key", "vector", "asks", mix.alias("mix")).mapInArrow(_assigner(sent, width, probes, margin), kinds)
    same = None
    if copied:
        # Whoever has k copies has these, first by key, as its k most similar; and for all others only the
        # first k + 1 copies and a few in reserve can matter. So these few stand for all in the index, and the rest never meet.
        copies = spread.where("shard < 0").select("shard", "key", "vector", "asks")
        lead = Window.partitionBy("shard").orderBy("key")
        heads = copies.withColumn("_r", F.dense_rank().over(lead)).where(F.col("_r") <= k + 1 + NEXT).dropDuplicates(["shard", "_r"])
        heads = materialize(heads, "copies")
        listed = heads.groupBy("shard").agg(F.array_sort(F.collect_list("key")).alias("_heads"))  # a few keys a vector
        others = F.slice(F.array_except("_heads", F.array("key")), 1, k + NEXT)
        same = copies.where("asks").join(F.broadcast(listed), "shard").select(F.col("key").alias("a"), F.explode(others).alias("b"), F.lit(1.0).alias("similarity"))
        alone = spark.sparkContext.broadcast((centres, first, salts, {}))
        spread = spread.where("shard >= 0").unionByName(heads.select("key", "vector").mapInArrow(_reindexer(alone, width), kinds))
    shards = int(first[-1] + salts[-1])
    tasks = min(shards, MAX_TASKS)
    placed = spread.repartitionById(tasks, "shard")
    placed = placed if shards <= tasks else placed.sortWithinPartitions("shard")
    found = placed.mapInArrow(_by_shard(_searcher(width, k, least, degree, build_beam, beam)), f"a {kind}, b {kind}, similarity double")
    if same is not None:
        found = found.unionByName(same.where(F.col("similarity") >= least))
    best = Window.partitionBy("a").orderBy(F.col("similarity").desc(), "b")
    # A key is one row with one home, so no pair comes twice.
    # Written once: what is sure and what is in doubt both come from it, and the search is the dear part.
    found = materialize(found, "candidates")
    ranked = found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + NEXT)
    # Doubtful is a vector whose k-th and next are too close to call, or that has one at the threshold. The others are as they will be.
    next_one = F.lead("similarity").over(best)
    close = (F.abs(F.col("similarity") - least) <= DOUBT) | (F.col("_r") >= k) & (F.col("similarity") - next_one <= DOUBT)
    judged = ranked.withColumn("_doubt", F.max(F.coalesce(close, F.lit(False))).over(Window.partitionBy("a")) | F.lit(exact))
    sure = judged.where("not _doubt").where((F.col("_r") <= k) & (F.col("similarity") >= least)).select("a", "b", "similarity")
    pairs = judged.where("_doubt").select("a", "b")
    # Both joins find the vectors where the merging of their keys has put them.
    both = pairs.join(items.select(F.col("key").alias("a"), F.col("vector").alias("va")), "a").join(items.select(F.col("key").alias("b"), F.col("vector").alias("vb")), "b")
    scored = both.mapInArrow(_exactly(width), f"a {kind}, b {kind}, similarity double").where(F.col("similarity") >= least)
    again = scored.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).select("a", "b", "similarity")
    return sure.unionByName(again).select(F.col("a").alias("key_a"), F.col("b").alias("key_b"), "similarity")


def _exactly(width: int):
    """Cosines of pairs of stored vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (_unpack(batch.column(c), width) for c in ("va", "vb"))
            norms = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64) * np.einsum("ij,ij->i", y, y, dtype=np.float64))
            yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b"), "similarity": pa.array(np.einsum("ij,ij->i", x, y, dtype=np.float64) / norms)})

    return run

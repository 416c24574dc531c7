"""Runs of identical or nearly identical consecutive events (problem 4).

Events are range-partitioned by (entity, position). In each task, hashes become canonical events: two
hashes that stand side by side somewhere in an entity and differ in at most ``max_distance`` bits
belong to one, and so do chains of these. Canonical events are Unicode code points, an entity's events
a string, and a regular expression with a back-reference matches the stretches in which one code point
repeats. As canonical events chain (a like b and b like c make a and c one), neighbours inside a match
are checked bit by bit and a match is parted where they differ. Spans map back to events and times. Runs
that touch a task's edge are joined with the neighbouring task's.

"Nearly" is chained: an event belongs to the run when it differs from the event *before it* in at
most ``max_distance`` bits.

Defined results: events with a null in an entity column, the position or the key, or without a
usable hash (null, empty, not hexadecimal, more than 64 bits) take no part and break no run. Hashes
count without regard to letter case and dropped leading zeros. Copies of an event (same entity,
position and key) are one event. Events at one position stand in the order of their key. Empty
input: no rows. Null times: the duration is null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cinequery.llm.edges import ordered_scan
from cinequery.sources.tables import materialize

#: Code points of canonical events, from here on and as many; an entity that has more reuses them, which the check of neighbours parts again.
FIRST_SYMBOL, SYMBOLS = 0x10000, 0x100000
#: Stands between entities; no match goes over it.
_BETWEEN = ord("\n")
_REPEATED = re.compile(r"([^\n])\1*")
_FIELDS = "first_key string, last_key string, first_at long, last_at long, first_hash long, last_hash long, n long"
_SCANNED = f"role string, task int, place int, entity string, {_FIELDS}"


def hash_bits(text: Column) -> Column:
    """The 64 bits of up to 16 hexadecimal digits as BIGINT; null where it is none."""
    clean = F.lower(F.trim(text))
    whole = F.lpad(clean, 16, "0")
    half = lambda start: F.conv(F.substring(whole, start, 8), 16, 10).cast("long")
    return F.when(clean.rlike("^[0-9a-f]{1,16}$"), F.shiftleft(half(1), 32).bitwiseOR(half(9)))


def _canonical(entity: np.ndarray, bits: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Number of each event's canonical event within its entity. ``near``: whether an event is like the one before it."""
    n = len(bits)
    by_hash = np.lexsort((bits, entity))
    fresh = np.r_[True, (entity[by_hash][1:] != entity[by_hash][:-1]) | (bits[by_hash][1:] != bits[by_hash][:-1])]
    kind = np.empty(n, np.int64)
    kind[by_hash] = np.cumsum(fresh) - 1  # the different hashes of an entity, which follow one another
    a, b = kind[:-1][near[1:]], kind[1:][near[1:]]
    different = a != b
    a, b = a[different], b[different]
    label = np.arange(int(fresh.sum()))
    while len(a):
        # Of two that are alike the greater label gives way; pointers are then followed to their ends.
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low != high
        a, b, low, high = a[apart], b[apart], low[apart], high[apart]
        np.minimum.at(label, high, low)
        while (label != label[label]).any():
            label = label[label]
    return label[kind] - label[kind][np.searchsorted(entity, entity)]


def _spans(entity: np.ndarray, canonical: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last event of each match, by the string of code points."""
    n = len(entity)
    gaps = np.cumsum(np.r_[False, entity[1:] != entity[:-1]])  # separators before each event
    text = np.full(n + int(gaps[-1]), _BETWEEN, np.int64)
    text[np.arange(n) + gaps] = FIRST_SYMBOL + canonical % SYMBOLS
    string = text.astype("<u4").tobytes().decode("utf-32-le")
    spans = np.array([m.span() for m in _REPEATED.finditer(string)], np.int64).reshape(-1, 2)
    event_at = np.zeros(len(text), np.int64)
    event_at[np.arange(n) + gaps] = np.arange(n)
    return event_at[spans[:, 0]], event_at[spans[:, 1] - 1]


def _scanner(max_distance: int, min_events: int):
    def scan(task: int, t: pa.Table) -> Iterator[pa.RecordBatch]:
        columns = {c: t[c].combine_chunks() for c in t.column_names}
        n = t.num_rows
        if n > 1:
            same = lambda c: pc.equal(columns[c][1:], columns[c][:-1]).to_numpy(zero_copy_only=False).astype(bool)
            entity_on, place_on = same("entity"), same("position")
            first_copy = np.r_[True, ~(entity_on & place_on & same("key"))]
            if not first_copy.all():
                columns = {c: v.filter(pa.array(first_copy)) for c, v in columns.items()}
                n = len(columns["key"])
        bits = columns["hash"].to_numpy(zero_copy_only=False).view(np.uint64)
        entity = pc.dictionary_encode(columns["entity"]).indices.to_numpy(zero_copy_only=False).astype(np.int64)
        near = np.r_[False, (entity[1:] == entity[:-1]) & (np.bitwise_count(bits[1:] ^ bits[:-1]) <= max_distance)]
        start, stop = _spans(entity, _canonical(entity, bits, near))
        # A match is parted where neighbours are not alike after all.
        joined = np.zeros(n, bool)
        for a, b in zip(start[stop > start].tolist(), stop[stop > start].tolist()):
            joined[a + 1 : b + 1] = True
        start = np.flatnonzero(~(joined & near))
        stop = np.r_[start[1:] - 1, n - 1]
        edge = (start == 0) | (stop == n - 1)
        show = edge | (stop - start + 1 >= min_events)
        start, stop, edge = start[show], stop[show], edge[show]
        take = lambda c, i: columns[c].take(pa.array(i))
        k = len(start)
        yield pa.record_batch(
            {
                "role": pc.if_else(pa.array(edge), "edge", "done"),
                "task": pa.array(np.full(k, task, np.int32)),
                "place": pa.array(np.where(start == 0, 0, 1).astype(np.int32)),
                "entity": take("entity", start),
                "first_key": take("key", start),
                "last_key": take("key", stop),
                "first_at": take("at", start),
                "last_at": take("at", stop),
                "first_hash": take("hash", start),
                "last_hash": take("hash", stop),
                "n": pa.array(stop - start + 1),
            }
        )

    return scan


def collapse_runs(
    events: DataFrame, entity: Sequence[str], position: str, key: str, at: str, hash_text: str, max_distance: int = 6, min_events: int = 1, partitions: int | None = None
) -> DataFrame:
    """(entity columns, first_key, last_key, events, first_at, last_at, duration): one row a run of at least ``min_events``."""
    if not 0 <= max_distance <= 64 or min_events < 1:
        raise ValueError("max_distance must be 0 to 64 and min_events at least 1")
    usable = F.col("hash").isNotNull() & F.col("position").isNotNull() & F.col("key").isNotNull()
    for c in entity:
        usable &= F.col(f"_{c}").isNotNull()
    kept = events.select(
        *(F.col(c).alias(f"_{c}") for c in entity), F.col(position).alias("position"), F.col(key).cast("string").alias("key"), F.col(at).cast("long").alias("at"), hash_bits(F.col(hash_text)).alias("hash")
    ).where(usable)
    names = [f"_{c}" for c in entity]
    kinds = {c: kept.schema[f"_{c}"].dataType.simpleString() for c in entity}
    flat = kept.select(F.to_json(F.struct(*names)).alias("entity"), "position", "key", "at", "hash")
    scanned = materialize(ordered_scan(flat, ["entity", "position", "key"], _scanner(max_distance, min_events), _SCANNED, partitions), "runs")

    fields = ["entity", "first_key", "last_key", "first_at", "last_at", "n"]
    done = scanned.where("role = 'done'").select(*fields)
    # At most two edge runs a task, and those of an entity are all that can be one run.
    line = Window.partitionBy("entity").orderBy("task", "place")
    linked = (F.lag("task").over(line) != F.col("task")) & (F.bit_count(F.lag("last_hash").over(line).bitwiseXOR(F.col("first_hash"))) <= max_distance)
    edges = scanned.where("role = 'edge'").withColumn("_new", F.when(F.coalesce(linked, F.lit(False)), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(line))
    at_place = F.struct("task", "place")
    joined = edges.groupBy("entity", "_run").agg(
        *(F.min_by(c, at_place).alias(c) for c in ("first_key", "first_at")),
        *(F.max_by(c, at_place).alias(c) for c in ("last_key", "last_at")),
        F.sum("n").alias("n"),
    )
    runs = done.unionByName(joined.select(*fields)).where(F.col("n") >= min_events)
    parsed = F.from_json("entity", ", ".join(f"`_{c}` {k}" for c, k in kinds.items()))
    return runs.withColumn("_e", parsed).select(
        *(F.col("_e")[f"_{c}"].alias(c) for c in entity), "first_key", "last_key", F.col("n").alias("events"), "first_at", "last_at", (F.col("last_at") - F.col("first_at")).alias("duration")
    )

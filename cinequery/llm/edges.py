"""Shared part of the operators that scan a globally ordered table task by task.

Rows are range-partitioned by entity and position, so an entity may span any number of tasks. Each
task scans its rows once and reports, beside its finished results, what lies at its two edges. The
edge rows, a handful a task, are then combined by a prefix scan in task order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Tasks whose edge rows one step of the prefix scan takes.
BLOCK = 256
#: Rows that a task of a scan holds at once, on average.
TASK_ROWS = 500_000


def ordered_scan(rows: DataFrame, order: Sequence[str], scan: Callable[[int, pa.Table], Iterator[pa.RecordBatch]], schema: str, partitions: int | None = None) -> DataFrame:
    """Apply ``scan(task, table)`` to each task's rows, range-partitioned and sorted by ``order``.

    Only rows equal in all of ``order`` must share a task. The rows are counted first, so that there are tasks
    enough for each to hold ``TASK_ROWS``, whatever the session's setting. Tasks follow one another in
    the order of the rows, also where adaptive execution joins neighbouring ones.
    """
    columns = rows.columns
    if partitions is None:
        partitions = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // TASK_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            held.clear()
            assert table.column_names == columns
            yield from scan(TaskContext.get().partitionId(), table)

    return rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order).mapInArrow(run, schema)


def last_before(edges: DataFrame, task: str, value: str, descending: bool = False) -> DataFrame:
    """(task, carried): for each row the last non-null ``value`` of the tasks before it (after it, if ``descending``).

    A parallel prefix scan in two steps: blocks of tasks are scanned side by side, the blocks'
    totals (one row for ``BLOCK * TASK_ROWS`` rows of the table, so few) are scanned in one task, and
    each task takes its own block's value or else the total of the blocks before.
    """
    position = -F.col(task) if descending else F.col(task)
    edges = edges.select(task, value, position.alias("_at")).withColumn("_block", F.floor(F.col("_at") / BLOCK))
    inside = Window.partitionBy("_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    scanned = edges.withColumn("_local", F.last(value, ignorenulls=True).over(inside))
    totals = edges.groupBy("_block").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_at"))).alias("_total"))
    over = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_block", F.last("_total", ignorenulls=True).over(over).alias("_before"))
    return scanned.join(before, "_block", "left").select(task, F.coalesce("_local", "_before").alias("carried"))

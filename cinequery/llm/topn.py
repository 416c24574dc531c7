"""Top N items of every group, with groups of any size (problem 5).

Exact counts split the groups. A group is heavy when it holds more than a ``SHARE``-th of all rows, so
there are fewer than ``SHARE`` heavy groups, whatever the data and its size: their list is small by
construction. A heavy group is cut into salted ranges of about that many rows each; ranges are numbered through
all heavy groups, so no range lies in two groups and no sampling pass is needed to lay them out. Rows are
sorted range by range, by any number of tasks, and each range hands on its best N; a window over
these few gives the group's. Light groups go through an ordinary window, and both are united.

The table is read twice: for the counts, and for the rows. The first window sorts by range or light
group, keeps N before and after its exchange, and is shared by both branches. Nothing is dropped: a row
leaves the plan only when N better rows of its group are known.

Defined results: rows with a null in a group column or a null or NaN score are left out (they have
no place in an order by score). Rows equal in all order columns are one record delivered more than
once and come out once. Fewer than N rows: all of them. Empty input: no rows. Extra columns ride
along only when named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A group with more than this part of all rows is heavy. There are fewer heavy groups than this.
SHARE = 1_024


def _best(rows: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    # Copies of a record tie in all order columns, so dense_rank counts them once.
    return rows.withColumn("__rank", F.dense_rank().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__rank") <= n)


def heavy_ranges(rows: DataFrame, group: Sequence[str], share: int = SHARE) -> DataFrame:
    """(group, __first, __salts): the heavy groups, each with its first range and its number of ranges."""
    counts = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("__rows"))
    part = counts.agg(F.coalesce(F.sum("__rows"), F.lit(0)) / share).scalar()
    heavy = counts.withColumn("__part", part).where(F.col("__rows") > F.col("__part"))
    salted = heavy.withColumn("__salts", F.ceil(F.col("__rows") / F.col("__part")).cast("long"))
    line = Window.orderBy(*group).rowsBetween(Window.unboundedPreceding, -1)  # fewer than ``share`` rows
    return salted.select(*group, F.coalesce(F.sum("__salts").over(line), F.lit(0).cast("long")).alias("__first"), "__salts")


def top_n(rows: DataFrame, group: Sequence[str], score: str, ties: Sequence[str], n: int, keep: Sequence[str] = (), share: int = SHARE) -> DataFrame:
    """The ``n`` rows of each ``group`` first by ``score`` descending, then ``ties`` ascending.

    The last of ``ties`` identifies a record. Result columns: group, ties, score and ``keep``.
    """
    if n < 1 or share < 1:
        raise ValueError("n and share must be at least 1")
    wanted = list(dict.fromkeys([*group, *ties, score, *keep]))
    usable = F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))
    for c in group:
        usable &= F.col(c).isNotNull()
    rows = rows.select(*wanted).where(usable)
    order = [F.col(score).desc(), *(F.col(c).asc_nulls_last() for c in ties)]

    heavy = F.broadcast(heavy_ranges(rows, group, share))  # fewer than ``share`` rows
    marked = rows.join(heavy, list(group), "left")
    salt = F.pmod(F.xxhash64(*(F.col(c).cast("string") for c in ties)), F.col("__salts"))
    # Range -1 holds the light groups, side by side.
    placed = marked.withColumn("__range", F.coalesce(F.col("__first") + salt, F.lit(-1).cast("long"))).drop("__first", "__salts")
    first = _best(placed, ["__range", *group], order, n).dropDuplicates(["__range", *group, *ties, score])
    # A condition on the rank stays above the window, so both branches are read from one exchange.
    part = F.when(F.col("__rank") <= n, F.col("__range"))
    light = first.where(part == -1).select(*wanted)
    hot = _best(first.where(part >= 0).drop("__rank"), group, order, n)
    return light.unionByName(hot.select(*wanted))
